"""Invented rows in the shapes of FIXTURES.md."""

import json
import os


def write(path, value):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf8") as f:
        f.write(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return str(path)


def side(name, org, players=(), kind=None):
    return {"competitorType": kind, "competitiorId": name[:2], "competitiorName": name, "competitiorOrg": org,
            "players": [{"playerId": f"p{i}", "playerName": p, "playerOrgCode": org, "playerPosition": i + 1}
                        for i, p in enumerate(players)]}


def single_item(code, description, score="3-1", games="11-7,7-11,11-5,11-8", category="Men's Singles", **more):
    return {"id": "i" + code, "eventId": "9001", "documentCode": code, "subEventType": category, **more.pop("item", {}),
            "match_card": {"subEventDescription": description, "overallScores": score, "resultStatus": "OFFICIAL",
                           "gameScores": games, "competitiors": [side("Ann Lee", "AAA", ["Ann Lee"]), side("Bo Kim", "BBB", ["Bo Kim"])],
                           **more}}


def rubber(home, away, score="3-0", capital=False, kind="match_result"):
    sides = [{"competitior_name": home, "competitiorOrg": "AAA", "players": [{"playerName": home, "playerId": home}]},
             {"competitior_name": away, "competitiorOrg": "BBB", "players": [{"playerName": away, "playerId": away}]}]
    return {"value": "v1", kind: {"documentCode": "R-" + home, "overallScores": score, "gameScores": "11-1,11-2,11-3",
                                  ("Competitiors" if capital else "competitiors"): sides}}


def team_item(code, description, rubbers, category="Women's Teams", score="3-0"):
    return {"documentCode": code, "match_card": {
        "eventId": "9001", "subEventName": category, "subEventDescription": description, "overallScores": score,
        "venueName": "Hall", "tableNumber": "T1", "matchDateTime": {"startDateLocal": "03/05/2026 14:30:00"},
        "competitiors": [side("Alphas 1", "AAA"), side("Betas", "BBB")],
        "teamParentData": {"extended_info": {"matches": rubbers}}}, "fullResults": "F"}


def match(seq, **fields):
    from courtside.schema import MATCH_COLUMNS

    row = dict.fromkeys(MATCH_COLUMNS)
    row.update(matchType="individual", competitors=[], teams=[], singles=[], gameScores=[], categoryName="Men Singles",
               gender="men", discipline="singles", isParaClass=False)
    row.update(fields)
    return {"event": fields.get("event", "1"), "seq": seq, **{k: v for k, v in row.items() if k != "event"}}


def matches(spark, rows):
    from courtside.schema import MATCH, MATCH_COLUMNS

    text = [(r["event"], r["seq"], json.dumps({k: r[k] for k in MATCH_COLUMNS}, ensure_ascii=False)) for r in rows]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(text, "event string, seq bigint, j string")
    return df.select("event", "seq", F.from_json("j", MATCH).alias("m")).select("event", "seq", "m.*")


def person(name, org, code=None, pid=None):
    return {"id": pid, "name": name, "org": org, "orgCode": code, "position": 1}


def competitor(*people, kind=None, org=None):
    return {"type": kind, "id": None, "name": " / ".join(p["name"] for p in people), "org": org or people[0]["org"],
            "orgCode": people[0]["orgCode"], "irm": None, "players": list(people)}


def page(category, round_label, code, number, left, right, score="3-1", games="11-7<br>9-11<br>11-5<br>11-8", winner="Alpha One"):
    def block(entries):
        return "<dl>" + "".join(f'<dt><a href="#">{n}</a><dd>{c}' for n, c in entries) + "</dl>"

    return (f'<table class="game"><tr><td colspan="5">{category} {round_label}: <a href="show.cgi?{code}">試合番号 {number}</a></td></tr>'
            f'<tr><td rowspan="2">1</td> <td rowspan="2">{block(left)}</td><td>x</td><th>{score}</th> '
            f'<td rowspan="2">{block(right)}</td> <td rowspan="2">2</td></tr>'
            f'<tr><td align="center">{games}</td></tr><tr><td colspan="5">勝者: {winner}</td></tr></table>')
