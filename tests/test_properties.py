"""Operators against plain Python on small tables; a third and more of the rows share one key."""

import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import anchored, html_pages, merge, stages
from courtside.operators.ordered import Scope, neighbours, number_rows, run_ids


def events(seed, n=300, keys=5, values=3):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 3 + [f"k{i}" for i in range(keys)]), i, r.randrange(0, 500), r.choice([None, *"abc"[:values]]))
            for i in range(n)]


def frame(spark, rows, seed):
    shuffled = rows[:]
    random.Random(seed + 1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, id int, n int, v string")
    return df.repartition(1 + seed % 4).withColumn("chunk", F.floor(F.col("n") / (7 * (seed + 1))))


def scoped(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        out.setdefault(row[0], []).append(row)
    return out


SCOPE = Scope(["k"], ["chunk"], ["n", "id"])


@pytest.mark.parametrize("seed", [0, 1, 5])
def test_ordered_columns(spark, seed):
    rows = events(seed)
    df = frame(spark, rows, seed)
    want = {}
    for group in scoped(rows).values():
        run = 0
        for i, row in enumerate(group):
            opens = i == 0 or group[i - 1][3] != row[3]
            run += opens
            before = next((g[3] for g in reversed(group[:i]) if g[3] is not None), None)
            after = next((g[3] for g in group[i + 1:] if g[3] is not None), None)
            want[row[1]] = (i + 1, run, opens, before, after)
    numbered = {r["id"]: r["no"] for r in number_rows(df, SCOPE, "no").collect()}
    runs = {r["id"]: (r["row"], r["run"], r["opens"]) for r in run_ids(df, SCOPE, F.col("v"), "run", "opens", "row").collect()}
    near = {r["id"]: (r["b"], r["a"]) for r in neighbours(df, SCOPE, F.col("v"), "b", "a").collect()}
    assert len(numbered) == len(runs) == len(near) == len(rows)
    for i, (no, run, opens, before, after) in want.items():
        assert numbered[i] == no and runs[i] == (no, run, opens) and near[i] == (before, after)


@pytest.mark.parametrize("seed", [0, 3])
def test_fold_keeps_what_a_loop_keeps(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "a", "b", "c", "d"]), i, r.random() < 0.5, r.random() < (0.02 if seed else 0.3)) for i in range(400)]
    # "hot" never meets a scored and started row, so that its two other classes keep replacing each other
    rows = [(k, i, z, s and (k != "hot" or z)) for k, i, z, s in rows]
    want = {}
    for k, i, zero, started in rows:
        e = want.get(k)
        if e is None or (e[2] and not zero) or (not e[3] and started):
            want[k] = (k, i, zero, started)
    df = spark.createDataFrame(rows, "k string, i int, zero boolean, started boolean").repartition(4)
    got = merge.dedupe_fold(df, ["k"], ["i"], F.col("zero"), F.col("started")).collect()
    assert {g["k"]: g["i"] for g in got} == {k: v[1] for k, v in want.items()} and len(got) == len(want)


@pytest.mark.parametrize("per_chunk,fan,levels", [(2, 64, 2), (5, 64, 2), (64, 64, 2), (1, 2, 3), (2, 3, 2), (1, 4, 0)])
def test_anchored_windows(spark, monkeypatch, per_chunk, fan, levels):
    monkeypatch.setattr(anchored, "FAN", fan)
    monkeypatch.setattr(anchored, "LEVELS", levels)
    r = random.Random(per_chunk)
    rows = [(r.choice(["hot", "hot", "a", "b", None]), i, r.randrange(0, 6000)) for i in range(500)]
    length, maximum = 100, 3
    want, state = {}, {}
    for k, i, t in sorted(rows, key=lambda x: (x[2], x[1])):
        start, count = state.get(k, (None, 0))
        if start is None or t - start >= length:
            start, count = t, 0
        state[k] = (start, count + 1)
        want[i] = (start * 1_000_000, count + 1, count + 1 > maximum)
    df = spark.createDataFrame(rows, "k string, i int, t int").repartition(3).select("k", "i", F.timestamp_seconds("t").alias("ts"))
    got = anchored.anchored_window_count(df, "k", "ts", "i", length, maximum, per_chunk).collect()
    assert {g["i"]: (g["window_start"], g["window_count"], g["over_limit"]) for g in got} == want


def test_steps_of_a_hot_key_are_few_at_the_top(spark):
    """Steps compose: a key of 20,000 events in 1,250 chunks is a handful of steps two levels up, and each group is its own."""
    r = random.Random(8)
    second = 1_000_000
    times = sorted({r.randrange(0, 1_000_000) * second for _ in range(20_000)})
    length, width = 100 * second, 800 * second
    base = spark.createDataFrame([("khot", t // width, t, t) for t in times], anchored._STEP)
    steps = base.repartition("__key", "__chunk").sortWithinPartitions("__key", "__chunk", "entry").mapInPandas(anchored._steps(length), anchored._STEP)
    seen, start = {}, None
    for t in times:
        seen.setdefault(t // width, start)
        if start is None or t - start >= length:
            start = t
    got = anchored._entered(steps, length, 2).collect()
    assert {g["__chunk"]: g["opened"] for g in got} == seen and len(got) == len(seen)
    top = steps
    for _ in range(2):
        top = (top.withColumn("__chunk", F.floor(F.col("__chunk") / anchored.FAN).cast("bigint")).repartition("__key", "__chunk")
               .sortWithinPartitions("__key", "__chunk", "entry").mapInPandas(anchored._steps(length), anchored._STEP))
    assert top.count() <= 8 < steps.count()


@pytest.mark.parametrize("width", [1, 8, 64])
def test_uncovered(spark, width):
    r = random.Random(width)
    singles = [(r.choice("aab"), r.randrange(0, 300), i) for i in range(200)]
    ranges = [(r.choice("aab"), lo, lo + r.randrange(-2, 20)) for lo in (r.randrange(0, 300) for _ in range(12))]
    want = {i for k, n, i in singles if not any(k == rk and lo <= n <= hi for rk, lo, hi in ranges)}
    got = html_pages.uncovered(spark.createDataFrame(singles, "k string, n int, i int"), spark.createDataFrame(ranges, "k string, lo int, hi int"),
                               ["k"], "n", "lo", "hi", width)
    assert {g["i"] for g in got.collect()} == want


def test_merge_versions_by_hand(spark):
    ddl = "k string, seq bigint, n int, tag string"
    new = spark.createDataFrame([("a", 0, 1, "new"), ("b", 1, 2, "new"), (None, 2, 0, "new"), ("d", 3, 0, "new")], ddl)
    old = spark.createDataFrame([("a", 0, 1, "old"), ("b", 1, 3, "old"), ("c", 2, 0, "old"), (None, 3, 0, "old"), ("", 4, 0, "old")], ddl)
    got = merge.merge_versions(new, old, [], F.col("k"), "seq", [F.col("n").desc()]).orderBy("merged_seq").collect()
    assert [(g["k"], g["tag"]) for g in got] == [("a", "new"), ("b", "old"), ("c", "old"), (None, "old"), ("", "old"), (None, "new"), ("d", "new")]


def test_codes_with_and_without_dashes(spark):
    rows = spark.createDataFrame([("X--", 0), ("X", 1), (None, 2), (None, 3)], "code string, seq int")
    from courtside.functions.text import norm_code

    got = merge.dedupe_first(rows, [], norm_code(F.col("code")), ["seq"]).collect()
    assert sorted(g["seq"] for g in got) == [0, 2, 3]


def test_upsert_null_wins(spark):
    current = spark.createDataFrame([("1", "2026-01-01", "A"), ("2", "2026-02-01", "B")], "event string, startDate string, title string")
    updates = spark.createDataFrame([("1", None, "Z", 0, ["startDate"]), ("3", "2026-03-01", None, 1, ["startDate"]), ("2", None, "C", 2, ["title"]),
                                     ("2", None, "D", 3, ["title"])], "event string, startDate string, title string, seq int, present array<string>")
    got = {r["event"]: (r["startDate"], r["title"]) for r in merge.upsert(current, updates, "event", "seq").collect()}
    assert got == {"1": (None, "A"), "2": ("2026-02-01", "D"), "3": ("2026-03-01", None)}


def test_stage_numbers_skip_absent(spark):
    rows = spark.createDataFrame([("e", k) for k in ("round_of_32", "quarterfinal", "final", "group 1", "final")], "event string, roundKey string")
    got = {(r["roundKey"], r["stage_number"]) for r in stages.number_knockout_rounds(rows, ["event"]).collect()}
    assert got == {("round_of_32", 1), ("quarterfinal", 2), ("final", 3), ("group 1", None)}


def test_finished_needs_every_category(spark):
    from tests import fixtures as fx

    rows = [fx.match(0, event="1", categoryName="A", roundKey="final", resultStatus="OFFICIAL"), fx.match(1, event="1", categoryName="B", roundKey="semifinal"),
            fx.match(0, event="2", categoryName="A", roundLabel="Final", resultStatus="official"), fx.match(0, event="3", categoryName=" ")]
    got = {r["event"]: r["finished"] for r in stages.matches_finished(fx.matches(spark, rows)).collect()}
    assert got == {"1": False, "2": True, "3": False}


@pytest.mark.parametrize("settings", [
    {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
     "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096"},
    {"spark.sql.adaptive.autoBroadcastJoinThreshold": "100m"}], ids=["split", "broadcast"])
def test_a_chunk_of_windows_stays_whole(spark, settings):
    """However adaptive execution runs the joins below, all rows of a key's chunk meet in one task."""
    n = 20_000
    df = spark.range(0, n, 1, 6).select("id", F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(-1).alias("k"), F.timestamp_seconds(F.col("id") * 7919 % n).alias("ts"))
    want, state = {}, {}
    for i in sorted(range(n), key=lambda i: i * 7919 % n):
        k, t = i % 7 if i % 50 == 0 else -1, i * 7919 % n
        start, count = state.get(k, (None, 0))
        if start is None or t - start >= 100:
            start, count = t, 0
        state[k] = (start, count + 1)
        want[i] = (start * 1_000_000, count + 1)
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = anchored.anchored_window_count(df, "k", "ts", "id", 100, 3, 64).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {g["id"]: (g["window_start"], g["window_count"]) for g in got} == want
