"""Schemas (DDL) of the match record, the three feeds and the event indexes. All fields are nullable."""

PLAYER = "struct<id:string,name:string,org:string,orgCode:string,position:int>"
COMPETITOR = ("struct<type:string,id:string,name:string,org:string,orgCode:string,irm:string,"
              f"players:array<{PLAYER}>>")
TEAM = "struct<name:string,org:string,orgCode:string>"
SUB_MATCH = ("struct<order:int,documentCode:string,description:string,overallScore:string,resultStatus:string,"
             f"gameScores:array<string>,competitors:array<{COMPETITOR}>,winnerOrg:string>")

MATCH_FIELDS = {
    "matchType": "string", "id": "string", "eventId": "string", "documentCode": "string", "source": "string",
    "subEventType": "string", "categoryName": "string", "discipline": "string", "gender": "string",
    "roundLabel": "string", "roundKey": "string", "matchNumber": "bigint", "description": "string",
    "venue": "string", "table": "string", "startDateLocal": "string", "startDateUtc": "string",
    "searchDateTokens": "array<string>", "overallScore": "string", "resultStatus": "string",
    "isParaClass": "boolean", "teams": f"array<{TEAM}>", "competitors": f"array<{COMPETITOR}>",
    "gameScores": "array<string>", "singles": f"array<{SUB_MATCH}>",
}
MATCH_COLUMNS = list(MATCH_FIELDS)
MATCH = ", ".join(f"`{name}` {kind}" for name, kind in MATCH_FIELDS.items())

# Raw competitors carry two spellings of every key, both misspelt by the feed.
_RAW_PLAYER = "struct<playerId:string,playerName:string,playerOrgCode:string,playerPosition:int>"
_RAW_COMPETITOR = (
    "struct<competitorType:string,competitor_type:string,competitiorId:string,competitior_id:string,"
    "competitiorName:string,competitior_name:string,competitiorOrg:string,competitior_org:string,irm:string,"
    f"players:array<{_RAW_PLAYER}>>"
)
# One nested key comes in two capitalisations. Column names ignore case, so the nested result stays JSON text and is
# parsed once per spelling.
RAW_RESULT = (
    "documentCode string, subEventDescription string, overallScores string, resultStatus string, "
    f"gameScores string, resultsGameScores string, competitiors array<{_RAW_COMPETITOR}>"
)
RAW_RESULT_CAPITAL = f"Competitiors array<{_RAW_COMPETITOR}>"
CARD = (
    "struct<eventId:string,documentCode:string,subEventName:string,subEventDescription:string,venueName:string,"
    "tableName:string,tableNumber:string,overallScores:string,resultStatus:string,gameScores:string,"
    "resultsGameScores:string,matchStartTimeUTC:string,matchDateTime:struct<startDateLocal:string,"
    f"startDateUTC:string>,competitiors:array<{_RAW_COMPETITOR}>,teamParentData:struct<extended_info:struct<"
    "matches:array<struct<value:string,match_result:string,matchResult:string>>>>>"
)
FEED_ITEM_DDL = f"fullResults string, match_card {CARD}"

# An archive file holds raw feed items or normalised matches, so one row has room for both.
ARCHIVE_ROW = f"{MATCH}, {FEED_ITEM_DDL}"

_MEMBER = "struct<Reg:string,Desc:string,Org:string,OrgDesc:string>"
SIDE = ("struct<Org:string,OrgDesc:string,Desc:string,Reg:string,Res:string,Win:boolean,"
        f"Splits:array<struct<Res:string>>,Members:array<{_MEMBER}>>")
DAILY_ITEM = (
    "Key string, Desc string, Venue string, LocDesc string, Loc string, Status string, IsTeam boolean, "
    f"Home {SIDE}, Away {SIDE}, SubMatches array<struct<Home:{SIDE},Away:{SIDE}>>"
)
DAILY_META = (
    "champDesc string, champ string, isFinished boolean, dates array<struct<raw:string>>, "
    "events array<struct<Key:string,Desc:string>>"
)

_OPPONENT = ("struct<Unit:string,Organization:string,Date:string,Time:string,Result:string,"
             "Description:struct<TeamName:string,IfId:string>>")
STANDINGS_BLOCK = (
    "MessagePayload struct<Competition:struct<ExtendedInfos:struct<SportDescription:struct<EventName:string>,"
    "VenueDescription:struct<VenueName:string>>,Result:array<struct<Competitor:struct<Organization:string,"
    f"Description:struct<TeamName:string,IfId:string>,Opponent:array<{_OPPONENT}>>>>>>"
)

ARCHIVE_INDEX = ("pooled boolean, archived boolean, forced boolean, canAutoArchive boolean, source string, "
                 "title string, eventName string, startDate string, endDate string, lastFetchedAt string, "
                 "archivedAt string")
DATE_INDEX = ("event string, eventName string, title string, startDate string, endDate string, source string, "
              "updatedAt string")
SEARCH_INDEX = ("event string, eventName string, startDate string, endDate string, dateLabel string, "
                "archived boolean, status string, source string, series string, verifiedAt string")
CALENDAR_ROW = (
    "EventCode string, EventId string, EventName string, EventDateChangeId string, ShowInCalendar boolean, "
    "StartDateTime string, EndDateTime string, FromStartDate string, FromEndDate string"
)
