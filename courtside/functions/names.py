"""Names of players, teams and organisations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtside.functions.text import SPACE, blank_to_null, collapse, let, text, trim

_NATIVE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々ヶ]+"


def name_candidates(c: Column) -> Column:
    """The spellings under which a dictionary may hold a name, best first."""
    none = F.array().cast("array<string>")

    def pair(a, b):
        return F.concat_ws(" ", a, b)

    def spelled(raw, collapsed, parts):
        n = F.size(parts)
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        family = F.get(parts, n - 1)
        two = F.when(n == 2, F.array(pair(second, first), pair(F.upper(second), first), pair(first, F.upper(second)))
                     ).otherwise(none)
        more = let(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), " "), lambda given: F.array(
            pair(family, given), pair(F.upper(family), given), pair(given, F.upper(family))))
        return F.array_distinct(F.concat(F.array(raw, collapsed), two, F.when(n >= 2, more).otherwise(none)))

    # the text is cleaned and cut once, not once for each part of each spelling
    return let(trim(c), lambda raw: F.when(raw == "", none).otherwise(let(collapse(raw), lambda collapsed: let(
        F.filter(F.split(collapsed, " "), lambda p: p != ""), lambda parts: spelled(raw, collapsed, parts)))))


def compact_name(c: Column) -> Column:
    """A two-part name in Han or kana loses the space between its parts."""
    raw = trim(c)
    return F.when(raw.rlike(f"^{_NATIVE} {_NATIVE}$"), F.replace(raw, F.lit(" "), F.lit(""))).otherwise(raw)


def player_identity(player: Column) -> Column:
    """Id when there is one, else the collapsed lower-case name. Null player gives blank."""
    pid = trim(player["id"])
    return (F.when(player.isNull(), "")
            .when(pid != "", F.concat(F.lit("id:"), pid))
            .otherwise(F.concat(F.lit("name:"), F.lower(trim(collapse(player["name"]))))))


class Names:
    """Translations of one match, as two ``map<raw name, translated>`` columns (see ``lookup.translate_matches``)."""

    def __init__(self, players: Column | None = None, teams: Column | None = None):
        self._players, self._teams = players, teams

    def player(self, name: Column) -> Column:
        own = compact_name(name)
        if self._players is None:
            return own
        return F.coalesce(F.try_element_at(self._players, text(name)), own)

    def team_hit(self, key: Column) -> Column:
        if self._teams is None:
            return F.lit(None).cast("string")
        return blank_to_null(F.try_element_at(self._teams, text(key)))

    def team(self, team: Column) -> Column:
        """Name, name without its trailing number, code, organisation; else the name itself."""
        name = text(team["name"])
        if self._teams is None:
            return name
        return F.coalesce(self.team_hit(name), self.team_hit(F.regexp_replace(name, SPACE + r"+\d+$", "")),
                          self.team_hit(team["orgCode"]), self.team_hit(team["org"]), name)

    def org(self, org: Column, code: Column) -> Column:
        """Code first, then the text, then an ``A/B`` text part by part."""
        raw = trim(org)
        if self._teams is None:
            return raw
        parts = F.array_join(F.transform(F.split(raw, "/"), lambda p: F.coalesce(self.team_hit(p), p)), "/")
        return F.coalesce(self.team_hit(trim(code)), F.when(raw == "", ""), self.team_hit(raw),
                          F.when(raw.contains("/"), parts), raw)
