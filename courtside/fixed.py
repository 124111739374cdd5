"""Word lists, lookup tables, patterns and labels that results depend on."""

# --- fixed values: source identifiers and their spellings -------------------------------
DEFAULT_SOURCE = "wtt"
DOMESTIC_SOURCE = "zennihon"
DEFAULT_SOURCE_ALIASES = ["wtt", "world table tennis"]
DOMESTIC_SOURCE_ALIASES = ["zennihon", "all japan", "alljapan", "all japan championships", "jtta"]
DOMESTIC_SOURCE_NATIVE = "全日本"
CALENDAR_SOURCE = "calendar"
LEGACY_FEED_SOURCES = ["bornan", "ittf", "ittf_results", "ittf-results", "ittf-legacy"]
LEGACY_URL_SOURCES = ["bornan", "ittf", "ittf_results", "ittf-results"]
EVENT_ALIASES = {"3487": "34031", "5524": "3500"}
MIN_INDEXED_EVENT = 2500
MIN_REMOTE_NAMED_EVENT = 3000

# --- fixed values: gender words ---------------------------------------------------------
GENDER_WORDS = {
    "women": ["women", "womens", "female", "girls", "girl"],
    "men": ["men", "mens", "male", "boys", "boy"],
    "mixed": ["mixed", "mix"],
}
# Tried in this order; "womens team" also holds "mens team".
GENDER_PHRASES = [
    ("women", ["womens team", "women team", "womens single", "women single",
               "womens doubles", "women doubles", "womens mixed"]),
    ("women", ["girls team", "girls single", "girls doubles"]),
    ("men", ["mens team", "men team", "mens single", "men single",
             "mens doubles", "men doubles", "mens mixed"]),
    ("men", ["boys team", "boys single", "boys doubles"]),
    ("mixed", ["mixed"]),
]

# --- fixed values: round names ----------------------------------------------------------
# Matched by containment on the space-free label, in this order.
ROUND_PHRASES_JA = [
    ("quarterfinal", ["準々決勝", "準準決勝"]),
    ("semifinal", ["準決勝"]),
    ("final", ["決勝"]),
    ("qualifying_round_1", ["予選1回戦", "予選１回戦", "予選第1回戦", "予選第１回戦"]),
    ("qualifying_round_2", ["予選2回戦", "予選２回戦", "予選第2回戦", "予選第２回戦"]),
    ("qualifying_round_3", ["予選3回戦", "予選３回戦", "予選第3回戦", "予選第３回戦"]),
    ("round_of_128", ["ベスト128", "128強"]),
    ("round_of_64", ["ベスト64", "64強"]),
    ("round_of_32", ["ベスト32", "32強"]),
    ("round_of_16", ["ベスト16", "16強"]),
    ("qualifying", ["予選"]),
    ("group", ["グループ", "予選リーグ"]),
    ("preliminary_round", ["予備ラウンド"]),
]
# Matched by equality on the normalised label.
ROUND_NAMES_EN = {
    "quarterfinal": ["quarterfinal", "quarterfinals", "quarter final", "quarter finals", "qf"],
    "semifinal": ["semifinal", "semifinals", "semi final", "semi finals", "sf"],
    "qualifying_round_1": ["qualifying round 1", "qr1"],
    "qualifying_round_2": ["qualifying round 2", "qr2"],
    "qualifying_round_3": ["qualifying round 3", "qr3"],
    "round_of_128": ["round of 128", "r128", "best 128"],
    "round_of_64": ["round of 64", "r64", "best 64"],
    "round_of_16": ["round of 16", "r16", "best 16"],
    "round_of_32": ["round of 32", "r32", "best 32"],
    "final": ["final", "finals", "f"],
    "group": ["group", "pool"],
}
KNOCKOUT_LADDER = ["round_of_128", "round_of_64", "round_of_32", "round_of_16",
                   "quarterfinal", "semifinal", "final"]
DIRECT_ROUND_PHRASES = ["Preliminary Round", "Round of 16", "Round of 32", "Round of 64", "Round of 128",
                        "Quarterfinals?", "Semifinals?", "Finals?",
                        "Gold Medal(?: Team)? Match", "Bronze Medal(?: Team)? Match"]
DAILY_ROUND_CODES = {"R64": "Round of 64", "R32": "Round of 32", "8FNL": "Round of 16",
                     "QFNL": "Quarterfinals", "SFNL": "Semifinals", "FNL-": "Finals"}
ROUND_KEY_LABELS_EN = {
    "final": "Final", "semifinal": "Semifinals", "quarterfinal": "Quarterfinals",
    "bronze_medal_match": "Bronze Medal Match", "preliminary_round": "Preliminary Round",
    "round_of_128": "Round of 128", "round_of_64": "Round of 64", "round_of_32": "Round of 32",
    "round_of_16": "Round of 16", "round_of_8": "Quarterfinals", "group": "Group",
}
ROUND_LABELS_EN = {
    "final": "Final", "finals": "Final",
    "semifinal": "Semifinals", "semifinals": "Semifinals", "semi final": "Semifinals",
    "semi finals": "Semifinals", "semi-final": "Semifinals", "semi-finals": "Semifinals",
    "quarterfinal": "Quarterfinals", "quarterfinals": "Quarterfinals", "quarter final": "Quarterfinals",
    "quarter finals": "Quarterfinals", "quarter-final": "Quarterfinals", "quarter-finals": "Quarterfinals",
    "bronze medal match": "Bronze Medal Match", "preliminary round": "Preliminary Round", "group": "Group",
}

# --- fixed values: label rules when the rules file is missing or a field is blank --------
KNOCKOUT_PREFIX = "決勝トーナメント"
GROUP_PREFIX = "グループ"
PRELIMINARY_LABEL = "予備ラウンド"
STAGE_DISPLAY = {"stage_1a": "Stage1A", "stage_1a_group": "Stage1Aグループ",
                 "stage_1b": "Stage1B", "stage_1b_group": "Stage1Bグループ"}
ROUND_FALLBACKS = {
    "quarterfinal": "決勝トーナメント準々決勝", "semifinal": "決勝トーナメント準決勝",
    "final": "決勝トーナメント決勝", "round_of_128": "決勝トーナメント1回戦",
    "round_of_64": "決勝トーナメント2回戦", "round_of_16": "決勝トーナメント1回戦",
    "round_of_32": "決勝トーナメント2回戦",
}
BRONZE_LABEL_JA = "3位決定戦"

# --- fixed values: categories -----------------------------------------------------------
CANONICAL_CATEGORIES = {
    "junior boys singles": "Junior Boys Singles", "junior girls singles": "Junior Girls Singles",
    "men teams": "Men Teams", "women teams": "Women Teams",
    "mixed teams": "Mixed Teams", "mixed team": "Mixed Teams",
    "men singles": "Men Singles", "women singles": "Women Singles",
    "men doubles": "Men Doubles", "women doubles": "Women Doubles",
    "mixed doubles": "Mixed Doubles", "mixed mixed": "Mixed Doubles",
}
GENERIC_CATEGORIES = ["men teams", "mens teams", "women teams", "womens teams", "mixed teams", "mixed team",
                      "men singles", "women singles", "men doubles", "women doubles",
                      "mixed doubles", "mixed mixed"]
CATEGORY_LABELS_JA = {
    "junior boys singles": "ジュニア男子", "junior girls singles": "ジュニア女子",
    "men teams": "男子団体", "mens teams": "男子団体", "women teams": "女子団体", "womens teams": "女子団体",
    "mixed teams": "混合団体", "mixed team": "混合団体",
    "men singles": "男子シングルス", "mens singles": "男子シングルス",
    "women singles": "女子シングルス", "womens singles": "女子シングルス",
    "men doubles": "男子ダブルス", "mens doubles": "男子ダブルス",
    "women doubles": "女子ダブルス", "womens doubles": "女子ダブルス",
    "mixed doubles": "混合ダブルス", "mixed mixed": "混合ダブルス",
}
CATEGORY_LABELS_EN = {
    "junior boys singles": "Junior Boys' Singles", "junior girls singles": "Junior Girls' Singles",
    "men teams": "Men's Teams", "mens teams": "Men's Teams",
    "women teams": "Women's Teams", "womens teams": "Women's Teams",
    "mixed teams": "Mixed Teams", "mixed team": "Mixed Teams",
    "men singles": "Men's Singles", "mens singles": "Men's Singles",
    "women singles": "Women's Singles", "womens singles": "Women's Singles",
    "men doubles": "Men's Doubles", "mens doubles": "Men's Doubles",
    "women doubles": "Women's Doubles", "womens doubles": "Women's Doubles",
    "mixed doubles": "Mixed Doubles", "mixed mixed": "Mixed Doubles",
}
DIVISION_JA = {"boys": "男子", "girls": "女子", "mixed": "混合"}
EVENT_TYPE_JA = {"singles": "シングルス", "doubles": "ダブルス", "teams": "団体"}
DOMESTIC_KINDS = {
    "MS": ("Men Singles", "singles", "men"), "WS": ("Women Singles", "singles", "women"),
    "MD": ("Men Doubles", "doubles", "men"), "WD": ("Women Doubles", "doubles", "women"),
    "XD": ("Mixed Doubles", "mixed", "mixed"),
    "JB": ("Junior Boys Singles", "singles", "men"), "JG": ("Junior Girls Singles", "singles", "women"),
}
# (discipline order, age, division order) used by the match sort.
SENIOR_SORT = {
    "men singles": (0, 0), "mens singles": (0, 0), "women singles": (0, 1), "womens singles": (0, 1),
    "men teams": (1, 0), "mens teams": (1, 0), "women teams": (1, 1), "womens teams": (1, 1),
    "mixed teams": (1, 2), "mixed team": (1, 2),
    "men doubles": (1, 0), "mens doubles": (1, 0), "women doubles": (1, 1), "womens doubles": (1, 1),
    "mixed doubles": (1, 2), "mixed mixed": (1, 2),
}

# --- fixed values: event series and bodies, tried in this order --------------------------
SERIES_KEYWORDS = [
    ("World Championships", r"world table tennis championships finals|world team table tennis championships finals"),
    ("Youth", r"youth"),
    ("Smash", r"smash"),
    ("Champions", r"\bchampions\b"),
    ("Star Contender", r"star contender"),
    ("Contender", r"contender"),
    ("Feeder", r"feeder"),
    ("Finals", r"finals"),
]
SERIES_OTHER = "Other"
BODY_DEFAULT = "WTT"
BODY_FEDERATION = "ITTF"
BODY_FEDERATION_WORDS = r"ittf|para|championships|international open|africa cup"
HOSTED_NAME = r"\bwtt\b|world (team )?table tennis championships finals"
RESULTS_PREFERRED_NAME = (r"^ittf\b|\bworld (team )?table tennis championships\b|\bworld para\b|"
                          r"special event qualifier|youth championships?|youth cup|para (future|open|event)")
TRANSIENT_ERRORS = ["non-JSON response", "HTML response", "invalid JSON", "empty response", "Timed out fetching",
                    "fetch failed", "ECONNRESET", "ETIMEDOUT", "EAI_AGAIN"]

# --- fixed values: special results ------------------------------------------------------
WALKOVER_PATTERN = r"\bw\s*[-/]\s*l\b|\bl\s*[-/]\s*w\b|w\s*/\s*o|walkover|wo\b"
RETIRED_PATTERN = r"\bret\b|retired|棄権|\bins\b|injury|inj\."
SPECIAL_RESULTS = {"ja": ("不戦勝", "棄権"), "en": ("W/O", "RET")}
