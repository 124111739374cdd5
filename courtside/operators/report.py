"""Report texts. A report is a table of lines: one row per line, ordered by its match and its place in the match.

The text of one event can be as large as the event, so no task builds it: ``write_report`` sorts the lines by range
and writes them, and the files in name order are the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.labels import (
    category_en, category_ja, category_sort_key, drop_prefix_for_domestic, round_en, round_ja, round_sort_value,
)
from courtside.functions.names import Names, player_identity
from courtside.functions.scores import (
    is_mixed_team, score_text, score_winner, side_values, sub_match_sides, team_game_totals, tie_left_index,
)
from courtside.functions.text import blank_to_null, first_text, let, text, trim
from courtside.operators.ordered import Scope, number_rows, range_chunks, run_ids
from courtside.operators.staged import written
from courtside.operators.stages import NO_NUMBER

_WIDE = "　"


SORT_ORDER = ["sort_category", "sort_round", "sort_number", "sort_text", "seq"]


def sort_matches(matches: DataFrame, scope: Sequence[str] = ("event",), width: int = 4096,
                 ranged: bool = False) -> tuple[DataFrame, Scope]:
    """O1: sort columns and the scope that orders matches by them. ``stage_number`` must be present.

    Chunks are category, round and ``width`` consecutive match numbers. Where one round may hold very many matches
    without a number, ``ranged`` cuts by sampled ranges instead.
    """
    number = F.coalesce(F.col("matchNumber"), F.lit(NO_NUMBER))
    keyed = matches.withColumns({
        "sort_category": category_sort_key(F.col("categoryName")),
        "sort_round": round_sort_value(F.col("roundKey"), F.col("roundLabel"), F.col("stage_number")),
        "sort_number": number,
        "sort_text": F.collate(text(F.col("description")), "UNICODE"),
        "sort_chunk": F.floor(number / F.lit(width)).cast("bigint"),
    })
    if ranged:
        return range_chunks(keyed, scope, SORT_ORDER), Scope(list(scope), ["range_chunk"], SORT_ORDER)
    return keyed, Scope(list(scope), ["sort_category", "sort_round", "sort_chunk"], SORT_ORDER)


# ---- list and text ---------------------------------------------------------------------

def _brackets(name: Column, org: Column, opening: str, closing: str) -> Column:
    return F.when(org != "", F.concat(name, F.lit(opening), org, F.lit(closing))).otherwise(name)


def _listed(c: Column, name, org) -> Column:
    """(name, org) of the named players of a side."""
    return F.filter(F.transform(F.coalesce(c["players"], F.array()), lambda p: F.struct(
        name(p["name"]).alias("name"), org(p).alias("org"))), lambda p: p["name"] != "")


def _orgs(players: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(players, lambda p: p["org"]), lambda o: o != ""))


def _joined(players: Column, joiner: str) -> Column:
    return F.array_join(F.transform(players, lambda p: p["name"]), joiner)


def competitor_label(c: Column, names: Names) -> Column:
    """Players joined, their distinct organisations in brackets."""
    players = _listed(c, names.player, lambda p: names.org(first_text(p["org"], c["org"]),
                                                           first_text(p["orgCode"], c["orgCode"])))
    own = _brackets(names.player(c["name"]), names.org(c["org"], c["orgCode"]), "（", "）")
    return F.when(c.isNull(), "").otherwise(let(players, lambda ps: F.when(
        F.size(ps) > 0, _brackets(_joined(ps, "／"), F.array_join(_orgs(ps), "／"), "（", "）")).otherwise(own)))


def competitor_label_en(c: Column) -> Column:
    """Pairs of two organisations label each player."""
    players = _listed(c, trim, lambda p: trim(first_text(p["org"], c["org"], p["orgCode"], c["orgCode"])))
    own = trim(c["name"])
    alone = F.when(own == "", "").otherwise(_brackets(own, trim(first_text(c["org"], c["orgCode"])), " (", ")"))

    def show(ps):
        each = F.array_join(F.transform(ps, lambda p: _brackets(p["name"], p["org"], " (", ")")), " / ")
        return let(_orgs(ps), lambda orgs: F.when((F.size(ps) >= 2) & (F.size(orgs) > 1), each)
                   .when(F.size(ps) >= 1, _brackets(_joined(ps, " / "), F.array_join(orgs, ""), " (", ")"))
                   .otherwise(alone))

    return F.when(c.isNull(), "").otherwise(let(players, show))


def sub_match_label(c: Column, names: Names | None, joiner: str) -> Column:
    """A rubber's side without organisations; ``names`` None is the English form."""
    show = trim if names is None else names.player
    players = F.filter(F.transform(F.coalesce(c["players"], F.array()), lambda p: show(p["name"])), lambda n: n != "")
    return F.when(c.isNull(), "").otherwise(let(players, lambda ps: F.when(
        F.size(ps) > 0, F.array_join(ps, joiner)).otherwise(show(c["name"]))))


def _team_side(i: int) -> Column:
    t = F.get("teams", F.lit(i))
    return F.when(t.isNull(), "TBD").otherwise(F.concat(
        F.coalesce(t["name"], F.lit("null")), F.lit(" ("), F.coalesce(t["org"], F.lit("null")), F.lit(")")))


def list_line(number: Column) -> Column:
    """R1: "n. description | left score right"."""
    plain = Names()
    individual = F.col("matchType") == "individual"

    def side(i):
        return F.when(individual, F.coalesce(blank_to_null(competitor_label(F.get("competitors", F.lit(i)), plain)),
                                             F.lit("TBD"))).otherwise(_team_side(i))

    return list_text(number, F.coalesce("description", F.lit("null")), side(0), F.col("overallScore"), side(1))


def list_text(number: Column, description: Column, left: Column, score: Column, right: Column) -> Column:
    return trim(F.concat(number.cast("string"), F.lit(". "), description, F.lit(" | "), left, F.lit(" "), text(score),
                         F.lit(" "), right))


def block_lines(number: Column, description: Column, left: Column, score: Column, right: Column,
                details: Column) -> Column:
    """R2: header line, score line, detail lines."""
    return F.concat(
        F.array(F.concat(F.lit("["), number.cast("string"), F.lit("] "), description),
                F.concat(left, F.lit(" "), F.coalesce(first_text(score), F.lit("-")), F.lit(" "), right)), details)


def _named(c: Column) -> Column:
    return F.concat(F.coalesce(first_text(c["name"]), F.lit("TBD")), F.lit(" ("),
                    F.coalesce(first_text(c["org"]), F.lit("-")), F.lit(")"))


def games_text(games: Column) -> Column:
    return F.when(F.size(games) > 0, F.array_join(games, ", ")).otherwise("-")


def text_lines(number: Column) -> Column:
    """R2 over the columns of a match row."""
    individual = F.col("matchType") == "individual"

    def rubber(s):
        return F.concat(
            text(s["order"]), F.lit(". "), _named(F.get(s["competitors"], F.lit(0))), F.lit(" vs "),
            _named(F.get(s["competitors"], F.lit(1))), F.lit(" | "), F.coalesce(first_text(s["overallScore"]), F.lit("-")),
            F.lit(" | "), games_text(s["gameScores"]))

    details = F.when(individual, F.array(F.concat(F.lit("games: "), games_text(F.col("gameScores"))))).otherwise(
        F.transform("singles", rubber))
    left, right = (F.when(individual, _named(F.get("competitors", F.lit(i)))).otherwise(_team_side(i)) for i in (0, 1))
    return block_lines(number, F.coalesce("description", F.lit("null")), left, F.col("overallScore"), right, details)


def numbered_lines(rows: DataFrame, scope: Scope, lines, blank_between: bool, keep: Sequence[str]) -> DataFrame:
    """Numbers rows in their scope and spreads ``lines(number)`` (an array) to (keep, row_no, line_no, line)."""
    numbered = number_rows(rows, scope, "row_no")
    content = lines(F.col("row_no"))
    if blank_between:
        content = F.when(F.col("row_no") > 1, F.concat(F.array(F.lit("")), content)).otherwise(content)
    return numbered.select(*keep, "row_no", F.posexplode(content).alias("line_no", "line"))


def payload_order(matches: DataFrame, width: int = 65536) -> tuple[DataFrame, Scope]:
    return (matches.withColumn("__seq_chunk", F.floor(F.col("seq") / F.lit(width)).cast("bigint")),
            Scope(["event"], ["__seq_chunk"], ["seq"]))


def report_list(matches: DataFrame) -> DataFrame:
    rows, scope = payload_order(matches)
    return numbered_lines(rows, scope, lambda n: F.array(list_line(n)), False, ["event"])


def report_text(matches: DataFrame) -> DataFrame:
    rows, scope = payload_order(matches)
    return numbered_lines(rows, scope, text_lines, True, ["event"])


# ---- pending pairs ---------------------------------------------------------------------

def _side_player(c: Column) -> Column:
    """First player of a side, else the side itself, as (id, name)."""
    def read(side):
        first = F.get(F.filter(F.coalesce(side["players"], F.array()), lambda p: p.isNotNull()), F.lit(0))
        return let(first, lambda p: F.when(p.isNotNull(), F.struct(p["id"].alias("id"), p["name"].alias("name")))
                   .when(trim(side["name"]) != "", F.struct(side["id"].alias("id"), trim(side["name"]).alias("name"))))

    # a side and its first player are picked once, not once for each of their fields
    return let(c, read)


def _typed_side(sides: Column, kind: str, fallback: int) -> Column:
    marked = F.get(F.filter(sides, lambda c: F.coalesce(c["type"] == kind, F.lit(False))), F.lit(0))
    return F.coalesce(marked, F.get(sides, F.lit(fallback)))


def with_pending(rows: DataFrame, out: str = "pending") -> DataFrame:
    """U4: pairs still to come in a tie, shown from its left side; null when none can be told.

    Standard order: rubbers four and five cross the first two, less what is played; an empty rest stays empty.
    Otherwise the doubles-first order: each doubles partner not used in rubber three meets the other rubber's opponent.
    Reads ``singles``, ``left_org``, ``right_org``, ``home_org``, ``away_org`` and ``left_index``.
    """
    def keyed(s):
        sides = s["competitors"]
        two = F.struct(_side_player(_typed_side(sides, "H", 0)).alias("h"), _side_player(_typed_side(sides, "A", 1)).alias("a"))
        return let(two, lambda p: F.when(p["h"].isNotNull() & p["a"].isNotNull(), F.struct(
            text(p["h"]["name"]).alias("h"), text(p["a"]["name"]).alias("a"),
            player_identity(p["h"]).alias("hk"), player_identity(p["a"]).alias("ak"))))

    played = F.filter(F.transform("singles", keyed), lambda p: p.isNotNull())
    staged = rows.withColumn("__played", F.when(F.size("singles") >= 3, played))
    staged = staged.withColumns({"__keys": F.transform("__played", lambda p: F.struct(p["hk"].alias("hk"), p["ak"].alias("ak"))),
                                 **{f"__r{i}": F.get("__played", F.lit(i)) for i in range(3)}})
    r1, r2, r3 = (F.col(f"__r{i}") for i in range(3))
    valid = ((F.size("__played") >= 3) & (r1["hk"] != r2["hk"]) & (r1["ak"] != r2["ak"])
             & (r3["hk"] != r1["hk"]) & (r3["hk"] != r2["hk"]) & (r3["ak"] != r1["ak"]) & (r3["ak"] != r2["ak"]))
    turned = F.coalesce((F.col("left_org") != "") & (F.col("left_org") == F.col("away_org"))
                        & (F.col("right_org") == F.col("home_org"))
                        & ~((F.col("left_org") == F.col("home_org")) & (F.col("right_org") == F.col("away_org"))), F.lit(False))

    def crossed(x, y):
        key = F.struct(x["hk"].alias("hk"), y["ak"].alias("ak"))
        pair = F.when(F.col("__turned"), _pair(y["a"], x["h"])).otherwise(_pair(x["h"], y["a"]))
        return F.when(F.array_contains("__keys", key), F.array().cast(PAIRS)).otherwise(F.array(pair))

    staged = staged.withColumn("__turned", turned).withColumn("__valid", F.coalesce(valid, F.lit(False)))
    standard = F.concat(crossed(r1, r2), crossed(r2, r1))
    pairs = F.when(F.col("__valid"), standard).when(F.size("singles") >= 3, _doubles_first(F.col("singles"), F.col("left_index")))
    return staged.withColumn(out, pairs).drop("__played", "__keys", "__r0", "__r1", "__r2", "__turned", "__valid")


PAIRS = "array<struct<left:string,right:string>>"


def _pair(left: Column, right: Column) -> Column:
    return F.struct(left.alias("left"), right.alias("right"))


def _doubles_first(singles: Column, left_index: Column) -> Column:
    def side(rubber, left):
        return F.get(F.get(singles, F.lit(rubber))["competitors"], left_index if left else 1 - left_index)

    def partners(left):
        return F.filter(F.coalesce(side(0, left)["players"], F.array()), lambda p: p.isNotNull())

    known = F.struct(*[_side_player(side(r, x)).alias(f"{'lr'[not x]}{r}") for r in (1, 2) for x in (True, False)],
                     partners(True).alias("pl"), partners(False).alias("pr"))

    def show(k):
        def rest(players, third):
            def other(key):
                return F.get(F.filter(players, lambda p: player_identity(p) != key), F.lit(0))

            return F.when((F.size(players) >= 2) & third.isNotNull(), let(player_identity(third), other))

        two = F.struct(rest(k["pl"], k["l2"]).alias("l"), rest(k["pr"], k["r2"]).alias("r"))
        return let(two, lambda t: F.when(
            t["l"].isNotNull() & t["r"].isNotNull() & k["l1"].isNotNull() & k["r1"].isNotNull(),
            F.array(_pair(text(t["l"]["name"]), text(k["r1"]["name"])), _pair(text(k["l1"]["name"]), text(t["r"]["name"])))))

    return let(known, show)


# ---- native and English reports --------------------------------------------------------

def with_display(matches: DataFrame) -> DataFrame:
    """Winner and side shown left, organisations of both shown sides, and the same for every rubber."""
    shown = matches.withColumn("winner", score_winner(F.col("overallScore"))).withColumn(
        "left_index", F.when(F.col("winner") == 1, 1).otherwise(0)).withColumns({
            "left_org": F.get("teams", F.col("left_index"))["org"],
            "right_org": F.get("teams", 1 - F.col("left_index"))["org"],
            "mixed_team": is_mixed_team(F.col("matchType"), F.col("discipline"), F.col("gender")),
        })
    return shown.withColumn("shown", F.transform("singles", lambda s: F.struct(
        s.alias("s"), score_winner(s["overallScore"]).alias("winner"),
        sub_match_sides(s["competitors"], F.col("left_org"), F.col("right_org")).alias("sides"))))


def _team_score() -> Column:
    score = F.coalesce(first_text(F.col("overallScore")), F.lit("-"))
    return let(F.split(score, "-"), lambda parts: F.when(F.col("left_index") == 1, F.concat(
        F.coalesce(F.get(parts, F.lit(1)), F.lit("undefined")), F.lit("-"), F.get(parts, F.lit(0)))).otherwise(score))


def _middle(opening: str, closing: str) -> Column:
    totals = let(team_game_totals(F.col("singles"), F.col("left_org"), F.col("right_org")),
                 lambda t: F.concat(F.lit(opening), t["left"].cast("string"), F.lit("-"), t["right"].cast("string"),
                                    F.lit(closing)))
    return F.when(F.col("mixed_team"), totals).otherwise(_team_score())


def _with_pending(rows: DataFrame) -> DataFrame:
    """Pending pairs of team ties, none for mixed teams."""
    wanted = (F.col("discipline") == "teams") & ~F.coalesce(F.col("gender") == "mixed", F.lit(False))
    staged = rows.withColumns({"home_org": F.get("teams", F.lit(0))["org"], "away_org": F.get("teams", F.lit(1))["org"],
                               "__all": F.col("singles"), "singles": F.when(wanted, F.col("singles"))})
    return with_pending(staged).withColumns({
        "pending": F.coalesce("pending", F.array().cast(PAIRS)), "singles": F.col("__all")}).drop("__all")


def _sides(label) -> list[Column]:
    return [label(F.get("competitors", at)) for at in (F.col("left_index"), 1 - F.col("left_index"))]


def _score(lang: str, omit_sets: bool) -> Column:
    return score_text(F.col("overallScore"), F.col("gameScores"), F.col("resultStatus"), F.col("left_index"), lang,
                      omit_sets)


def _rubber_parts(at: Column, to: Column, r: Column, label, lang: str, omit_sets: bool) -> Column:
    s = r["s"]
    return F.struct(
        label(F.get(s["competitors"], at)).alias("a"), label(F.get(s["competitors"], to)).alias("b"),
        score_text(s["overallScore"], s["gameScores"], s["resultStatus"], at, lang,
                   F.lit(True) if omit_sets else F.col("mixed_team")).alias("score"),
        (r["winner"] == at).alias("left_won"), (r["winner"] == to).alias("right_won"),
        side_values(s["overallScore"], at).alias("sets"))


def with_ja_lines(matches: DataFrame, names: Names, omit_sets: bool) -> DataFrame:
    """``lines`` of every match without its header. Built column by column, so no expression nests another."""
    sides = _sides(lambda c: competitor_label(c, names))
    rows = _with_pending(with_display(matches)).withColumns({
        "a": sides[0], "b": sides[1], "score": _score("ja", omit_sets),
        "rubbers": F.transform("shown", lambda r: _rubber_parts(
            r["sides"]["at"], r["sides"]["to"], r, lambda c: sub_match_label(c, names, "／"), "ja", omit_sets)),
        "home": names.team(F.get("teams", F.col("left_index"))), "away": names.team(F.get("teams", 1 - F.col("left_index"))),
        "middle": _middle("【", "】"),
    })
    pair = F.concat(F.col("a"), F.lit(f"\n{_WIDE}"), F.col("score"), F.lit(f"\n{_WIDE}{_WIDE}"), F.col("b"))
    single = F.when(F.col("discipline").isin("doubles", "mixed"), pair).otherwise(F.concat_ws(_WIDE, "a", "score", "b"))

    def rubber(r):
        mixed = F.col("mixed_team")
        return F.concat(
            F.when(mixed, F.concat(F.lit("【"), r["sets"]["left"].cast("string"), F.lit("】")))
             .when(r["left_won"], "○").otherwise(_WIDE),
            F.concat_ws(_WIDE, r["a"], r["score"], r["b"]),
            F.when(mixed, F.concat(F.lit("【"), r["sets"]["right"].cast("string"), F.lit("】")))
             .when(r["right_won"], "○").otherwise(""))

    tie = F.concat(
        F.array(F.concat(F.lit(_WIDE), F.concat_ws(_WIDE, "home", "middle", "away"))),
        F.transform("rubbers", rubber),
        F.transform("pending", lambda p: F.concat(F.lit(_WIDE), names.player(p["left"]), F.lit(f"{_WIDE}-{_WIDE}"),
                                                  names.player(p["right"]))))
    return rows.withColumn("lines", F.when(F.col("matchType") == "individual", F.array(single)).otherwise(tie))


def _decided(a: Column, score: Column, b: Column, decided: Column) -> Column:
    return F.when(decided, F.concat(a, F.lit(" d. "), b, F.lit(" "), score)).otherwise(
        F.concat(a, F.lit(" "), score, F.lit(" "), b))


def with_en_lines(matches: DataFrame, omit_sets: bool) -> DataFrame:
    """``lines`` of every match without its header; a decided rubber shows its winner left."""
    sides = _sides(competitor_label_en)

    def parts(r):
        return let(F.coalesce(r["winner"], r["sides"]["at"]), lambda at: _rubber_parts(
            at, F.when(at == 0, 1).otherwise(0), r, lambda c: sub_match_label(c, None, " / "), "en", omit_sets))

    def team(at):
        return let(F.get("teams", at), lambda t: text(trim(first_text(t["org"], t["orgCode"], t["name"]))))

    rows = _with_pending(with_display(matches)).withColumns({
        "a": sides[0], "b": sides[1], "score": _score("en", omit_sets), "rubbers": F.transform("shown", parts),
        "home": team(F.col("left_index")), "away": team(1 - F.col("left_index")), "middle": _middle("", ""),
    })
    single = _decided(F.col("a"), F.col("score"), F.col("b"), F.col("winner").isNotNull())
    tie = F.concat(
        F.array(F.concat(F.lit("  "), F.concat_ws(" ", "home", "middle", "away"))),
        F.transform("rubbers", lambda r: F.concat(F.lit("  "), _decided(
            r["a"], r["score"], r["b"], r["left_won"].isNotNull()))),
        F.transform("pending", lambda p: F.concat(F.lit("  "), p["left"], F.lit(" - "), p["right"])))
    return rows.withColumn("lines", F.when(F.col("matchType") == "individual", F.array(single)).otherwise(tie))


def header_ja(rules) -> Column:
    label = round_ja(F.col("roundKey"), F.col("roundLabel"), F.col("stage_number"), F.col("round_translated"), rules)
    shown = drop_prefix_for_domestic(text(F.coalesce(blank_to_null(label), F.col("roundLabel"))), F.col("source"))
    return F.concat(F.lit("▼"), category_ja(F.col("categoryName"), F.col("gender"), F.col("discipline")), trim(shown))


def header_en() -> Column:
    parts = F.array(trim(category_en(F.col("categoryName"), F.col("gender"), F.col("discipline"))),
                    trim(round_en(F.col("roundKey"), F.col("roundLabel"))))
    return F.concat(F.lit("▼"), F.array_join(F.filter(parts, lambda p: p != ""), " "))


def block_report(rows: DataFrame, scope: Scope, block: Column, header: str, lines: str,
                 keep: Sequence[str]) -> DataFrame:
    """Header line at the start of each run of equal ``block``, blank line between runs, lines of every row.

    Rows come out as (keep, block_no, row_no, line_no, line).
    """
    numbered = run_ids(rows, scope, block, "block_no", starts="__starts", rows="row_no")
    none = F.array().cast("array<string>")
    blank = F.when(F.col("block_no") > 1, F.array(F.lit(""))).otherwise(none)
    opening = F.when(F.col("__starts"), F.concat(blank, F.array(header))).otherwise(none)
    return numbered.select(*keep, "block_no", "row_no", F.posexplode(F.concat(opening, F.col(lines))).alias(
        "line_no", "line"))


def _blocks(rows: DataFrame, header: Column, ranged: bool) -> DataFrame:
    keyed, scope = sort_matches(rows.withColumn("header", header), ranged=ranged)
    # a tie is a block of its own; individual matches run on while category and round stay the same
    block = F.struct("categoryName", "roundKey", "roundLabel",
                     F.when(F.col("matchType") != "individual", F.col("seq")).alias("tie"))
    # only texts and sort columns travel: the nested match stays behind. The two readers of the runs, chunk ends and
    # rows, would each make the matches and their sort columns anew
    slim = written(keyed.select(*dict.fromkeys([*scope.parts, *scope.order]), block.alias("block"), "header", "lines"))
    return block_report(slim, scope, F.col("block"), "header", "lines", ["event"])


def report_ja(matches: DataFrame, rules, omit_sets: bool = False, translated: bool = True,
              ranged: bool = False) -> DataFrame:
    """R3. ``matches`` carry ``stage_number`` and the columns of ``translate_matches``, which are read only when
    ``translated``."""
    names = Names(F.col("player_names"), F.col("team_names")) if translated else Names()
    return _blocks(with_ja_lines(matches, names, omit_sets), header_ja(rules), ranged)


def report_en(matches: DataFrame, omit_sets: bool = False, ranged: bool = False) -> DataFrame:
    """R4. ``matches`` carry ``stage_number``."""
    return _blocks(with_en_lines(matches, omit_sets), header_en(), ranged)


def to_json_rows(df: DataFrame, columns: Sequence[str], pretty: bool = False, out: str = "line") -> Column:
    """M4: a row as JSON text with its null fields."""
    options = {"ignoreNullFields": "false", **({"pretty": "true"} if pretty else {})}
    return F.to_json(F.struct(*[F.col(c) for c in columns]), options).alias(out)


def write_report(lines: DataFrame, path: str, scope: Sequence[str] = ("event",)) -> None:
    """Writes report lines in order; the text files of a scope in name order are its report."""
    ordered = [*scope, "row_no", "line_no"]
    (lines.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
     .select(*scope, F.col("line").alias("value")).write.mode("overwrite").partitionBy(*scope).text(path))


# ---- flat tables -----------------------------------------------------------------------

def explode_sub_matches(matches: DataFrame, keep: Sequence[str] = ("event", "seq")) -> DataFrame:
    """M3: one row per (match, rubber, side, player); outer at every level, so nothing is lost."""
    rubbers = matches.select(*keep, F.posexplode_outer("singles").alias("rubber_no", "rubber"))
    sides = rubbers.select(*keep, "rubber_no", "rubber.overallScore", "rubber.gameScores", "rubber.winnerOrg",
                           F.posexplode_outer("rubber.competitors").alias("side_no", "side"))
    return sides.select(*keep, "rubber_no", "overallScore", "gameScores", "winnerOrg", "side_no", "side.name", "side.org",
                        F.posexplode_outer("side.players").alias("player_no", "player"))


def nested_counts(matches: DataFrame) -> DataFrame:
    """M2 on matches: numbers of rubbers, sides, players and games; an absent list counts 0."""
    def size(c):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")

    sides = F.flatten(F.transform("singles", lambda s: F.coalesce(s["competitors"], F.array())))
    return matches.withColumns({
        "rubbers": size(F.col("singles")), "sides": size(F.col("competitors")) + size(sides),
        "players": F.aggregate(F.concat(F.coalesce("competitors", F.array()), F.coalesce(sides, F.array())),
                               F.lit(0).cast("bigint"), lambda a, c: a + size(c["players"])),
        "games": size(F.col("gameScores")) + F.aggregate(F.coalesce("singles", F.array()), F.lit(0).cast("bigint"),
                                                         lambda a, s: a + size(s["gameScores"])),
    })
