"""Every operator bound to the driver tables. Each entry is (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.tables import LADDER, ORDER_MATCHES_SQL, cents, day, nation_orders, new_folder, order_matches, spread_table, table
from courtside.functions import dates, html, labels, names, scores, text
from courtside.functions.names import Names
from courtside.operators import facets, filters, html_pages, lookup, merge, report, search, stages
from courtside.operators import index as ix
from courtside.operators.anchored import anchored_window_count
from courtside.operators.normalize import standings_pairs
from courtside.operators.ordered import Scope, number_rows, run_ids
from courtside.operators.trigrams import TrigramIndex
from courtside.plans import jobs
from courtside.sources import files
from courtside.sources.index import LabelRules

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


_LADDER_SQL = "('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW')"


# ---- stages, gaps, runs ----------------------------------------------------------------

@query("""
WITH base AS (
  SELECT CAST(c_nationkey AS BIGINT) AS event, o_orderpriority AS stage, o_orderkey AS number, o_orderstatus, c_name,
         DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY o_orderpriority) AS stage_number
  FROM orders JOIN customer ON o_custkey = c_custkey),
kept AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event ORDER BY stage_number, number) AS row_no
         FROM base WHERE o_orderstatus = 'F')
SELECT event, CAST(row_no AS BIGINT) AS row_no,
       row_no || '. ' || stage || ' | ' || c_name || ' ' || stage_number || '-' || event || ' ' || number AS line
FROM kept""")
def q_match_query(spark, sf_dir):
    rows = nation_orders(spark, sf_dir, F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("number"),
                         "o_orderstatus", "c_name")
    numbered = stages.number_present_stages(rows, ["event"], "stage", LADDER)
    kept = filters.filter_code(numbered, "F", "o_orderstatus").withColumn("chunk", F.floor(F.col("number") / 65536))
    placed = number_rows(kept, Scope(["event"], ["stage_number", "chunk"], ["stage_number", "number"]), "row_no")
    score = F.concat_ws("-", F.col("stage_number").cast("string"), F.col("event").cast("string"))
    line = report.list_text(F.col("row_no"), F.col("stage"), F.col("c_name"), score, F.col("number").cast("string"))
    return placed.select("event", F.col("row_no").cast("bigint").alias("row_no"), line.alias("line"))


@query("""
SELECT o_orderkey, o_custkey,
       CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS stage_number
FROM orders""")
def q_stage_numbers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    numbered = stages.number_present_stages(orders, ["o_custkey"], "o_orderpriority", LADDER)
    return numbered.select("o_orderkey", "o_custkey", F.col("stage_number").cast("bigint").alias("stage_number"))


@query("""
WITH base AS (
  SELECT event_id, user_id, ts, CASE WHEN event_type IN ('signup','error','purchase') THEN event_type END AS label,
         CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 END AS n FROM events),
near AS (
  SELECT *, LAST_VALUE(label IGNORE NULLS) OVER p AS pl, LAST_VALUE(n IGNORE NULLS) OVER p AS pn,
         FIRST_VALUE(label IGNORE NULLS) OVER f AS nl, FIRST_VALUE(n IGNORE NULLS) OVER f AS nn
  FROM base WINDOW
    p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN label IS NOT NULL THEN label WHEN pl IS NULL THEN nl WHEN nl IS NULL THEN pl
                      WHEN pl = nl THEN nl WHEN nn = pn + 1 THEN pl END AS filled FROM near""")
def q_fill_labels(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").withColumn(
        "day", F.date_trunc("day", F.col("ts")))
    label = F.when(F.col("event_type").isin("signup", "error", "purchase"), F.col("event_type"))
    number = text.look_up({"signup": "1", "error": "2", "purchase": "3"}, F.col("event_type")).cast("int")
    filled = stages.fill_between_labels(events, Scope(["user_id"], ["day"], ["ts", "event_id"]), label, number, "filled")
    return filled.select("event_id", "filled")


@query("""
WITH flagged AS (
  SELECT *, CASE WHEN LAG(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, SUM(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM flagged)
SELECT user_id, CAST(run AS BIGINT) AS run_no, event_type, COUNT(*) AS length, MIN(event_id) AS first_event
FROM numbered GROUP BY ALL""")
def q_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").withColumn(
        "day", F.date_trunc("day", F.col("ts")))
    runs = run_ids(events, Scope(["user_id"], ["day"], ["ts", "event_id"]), F.col("event_type"), "run_no")
    return runs.groupBy("user_id", F.col("run_no").cast("bigint").alias("run_no"), "event_type").agg(
        F.count(F.lit(1)).alias("length"), F.min("event_id").alias("first_event"))


@query("""
WITH RECURSIVE ordered AS (
  SELECT event_id, user_id, epoch_us(ts) AS t_us, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
walk AS (
  SELECT event_id, user_id, t_us, rn, t_us AS window_start, CAST(1 AS BIGINT) AS window_count FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.event_id, o.user_id, o.t_us, o.rn,
         CASE WHEN o.t_us - w.window_start >= 21600000000 THEN o.t_us ELSE w.window_start END,
         CASE WHEN o.t_us - w.window_start >= 21600000000 THEN 1 ELSE w.window_count + 1 END
  FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT event_id, user_id, window_start, window_count, window_count > 3 AS over_limit FROM walk""")
def q_anchored_window(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    counted = anchored_window_count(events, "user_id", "ts", "event_id", 6 * 3600, 3, lengths_per_chunk=16)
    return counted.select("event_id", "user_id", "window_start", "window_count", "over_limit")


# ---- dedupe and merge ------------------------------------------------------------------

@query("""
WITH keyed AS (SELECT doc_id, lang, source, CASE WHEN source = 'src0' THEN NULL ELSE md5(text) END AS k FROM documents)
SELECT doc_id, lang, source FROM keyed
QUALIFY k IS NULL OR ROW_NUMBER() OVER (PARTITION BY k ORDER BY doc_id) = 1""")
def q_dedupe_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.when(F.col("source") != "src0", F.md5("text")).alias("k"))
    return merge.dedupe_first(docs, [], F.col("k"), ["doc_id"]).select("doc_id", "lang", "source")


@query("""
SELECT lang, source, MIN(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang, source""")
def q_dedupe_last(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return merge.dedupe_last(docs, ["lang", "source"], "doc_id")


@query("""
SELECT doc_id, lang, source, n_chars FROM documents
QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1""")
def q_dedupe_best(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return merge.pick_first(docs, ["lang", "source"], [F.col("n_chars").desc(), F.col("doc_id")])


_FOLD_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
               "l_tax", "l_linestatus", "l_shipdate"]


@query(f"""
WITH folded AS (
  SELECT l_orderkey, list_reduce(list(struct_pack(z := l_discount = 0, s := l_returnflag <> 'N', ln := l_linenumber,
           pk := l_partkey, sk := l_suppkey, q := l_quantity, p := l_extendedprice) ORDER BY {', '.join(_FOLD_ORDER)}),
         lambda e, c: CASE WHEN (e.z AND NOT c.z) OR (NOT e.s AND c.s) THEN c ELSE e END) AS r
  FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(r.ln AS BIGINT) AS line_no, r.pk AS part, r.sk AS supp, CAST(r.q AS BIGINT) AS quantity,
       CAST(round(r.p * 100) AS BIGINT) AS price FROM folded""")
def q_dedupe_fold(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    kept = merge.dedupe_fold(lines, ["l_orderkey"], _FOLD_ORDER, F.col("l_discount") == 0, F.col("l_returnflag") != "N")
    return kept.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line_no"), F.col("l_partkey").alias("part"),
                       F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("bigint").alias("quantity"),
                       cents("l_extendedprice").alias("price"))


@query("""
WITH fresh AS (
  SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderkey END AS k, o_orderkey AS seq, 'new' AS version,
         CAST(month(o_orderdate) % 3 AS BIGINT) AS nested FROM orders WHERE o_orderstatus <> 'P'),
old AS (
  SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderkey END AS k, o_orderkey AS seq, 'old' AS version,
         CAST(year(o_orderdate) % 3 AS BIGINT) AS nested FROM orders WHERE o_orderstatus <> 'O'),
joined AS (
  SELECT f.seq AS fs, o.seq AS os, f.nested AS fn, o.nested AS onn,
         f.k IS NOT NULL AND (o.k IS NULL OR f.nested >= o.nested) AS take FROM
  (SELECT * FROM fresh WHERE k IS NOT NULL) f FULL JOIN (SELECT * FROM old WHERE k IS NOT NULL) o ON f.k = o.k)
SELECT CASE WHEN take THEN fs ELSE os END AS o_orderkey, CASE WHEN take THEN 'new' ELSE 'old' END AS version,
       CASE WHEN take THEN fn ELSE onn END AS nested, CAST(CASE WHEN os IS NULL THEN 1 ELSE 0 END AS BIGINT) AS place,
       COALESCE(os, fs) AS place_seq FROM joined
UNION ALL SELECT seq, version, nested, CAST(1 AS BIGINT), seq FROM fresh WHERE k IS NULL
UNION ALL SELECT seq, version, nested, CAST(0 AS BIGINT), seq FROM old WHERE k IS NULL""")
def q_merge_versions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    key = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderkey").cast("string"))

    def version(df, name, part):
        return df.select(F.col("o_orderkey").alias("seq"), key.alias("k"), F.lit(name).alias("version"),
                         (part % 3).cast("bigint").alias("nested"))

    new = version(orders.filter("o_orderstatus <> 'P'"), "new", F.month("o_orderdate"))
    old = version(orders.filter("o_orderstatus <> 'O'"), "old", F.year("o_orderdate"))
    merged = merge.merge_versions(new, old, [], F.col("k"), "seq", [F.col("nested").desc()])
    return merged.select(F.col("seq").alias("o_orderkey"), "version", "nested",
                         F.col("merged_seq.origin").cast("bigint").alias("place"), F.col("merged_seq.seq").alias("place_seq"))


@query("""
WITH extra AS (SELECT l_orderkey, CAST(round(SUM(round(l_extendedprice * 100))) AS BIGINT) AS amount, COUNT(*) AS n
               FROM lineitem GROUP BY l_orderkey),
own AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderstatus FROM orders)
SELECT COALESCE(o_orderkey, l_orderkey) AS k,
       CASE WHEN o_orderkey IS NULL OR (l_orderkey IS NOT NULL AND o_orderstatus <> 'F'
                 AND (o_orderstatus = 'P' OR own.amount < extra.amount)) THEN 'extra' ELSE 'own' END AS origin,
       CASE WHEN o_orderkey IS NULL OR (l_orderkey IS NOT NULL AND o_orderstatus <> 'F'
                 AND (o_orderstatus = 'P' OR own.amount < extra.amount)) THEN extra.amount ELSE own.amount END AS amount
FROM own FULL JOIN extra ON o_orderkey = l_orderkey""")
def q_merge_supplemental(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderkey").alias("seq"), F.lit("own").alias("origin"),
        cents("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    extra = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("amount")).select(
        F.col("l_orderkey").cast("string").alias("k"), F.col("l_orderkey").alias("seq"), F.lit("extra").alias("origin"),
        "amount", F.lit("").alias("status"))

    def replaces(p, s):
        return F.when(p["status"] == "F", False).when(p["status"] == "P", True).otherwise(p["amount"] < s["amount"])

    merged = merge.merge_by_rule(own, extra, [], "k", "seq", replaces)
    return merged.select(F.col("k").cast("bigint").alias("k"), "origin", "amount")


@query("""
WITH upd AS (SELECT c_custkey, c_mktsegment IN ('BUILDING','MACHINERY') AS has_seg, c_nationkey < 10 AS has_nation,
                    c_nationkey FROM customer),
cur AS (SELECT * FROM customer WHERE c_acctbal >= 0)
SELECT COALESCE(cur.c_custkey, upd.c_custkey) AS c_custkey,
       CASE WHEN upd.has_seg THEN NULL ELSE cur.c_mktsegment END AS segment,
       COALESCE(CASE WHEN upd.has_nation THEN upd.c_nationkey + 100 ELSE cur.c_nationkey END, -1)::BIGINT AS nation
FROM cur FULL JOIN (SELECT * FROM upd WHERE has_seg OR has_nation) upd ON cur.c_custkey = upd.c_custkey""")
def q_upsert_index(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    current = customer.filter("c_acctbal >= 0").select("c_custkey", F.col("c_mktsegment").alias("segment"),
                                                       F.col("c_nationkey").cast("bigint").alias("nation"))
    blank = customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        "c_custkey", F.lit(None).cast("string").alias("segment"), F.lit(-5).cast("bigint").alias("nation"),
        F.lit(1).alias("seq"), F.array(F.lit("segment")).alias("present"))
    moved = customer.filter("c_nationkey < 10")

    def nation(seq, extra):
        return moved.select("c_custkey", F.lit("x").alias("segment"), (F.col("c_nationkey") + extra).cast("bigint").alias("nation"),
                            F.lit(seq).alias("seq"), F.array(F.lit("nation")).alias("present"))

    updates = blank.unionByName(nation(2, 50)).unionByName(nation(3, 100))
    return merge.upsert(current, updates, "c_custkey", "seq").withColumn("nation", F.coalesce("nation", F.lit(-1)))


@query("""
WITH a AS (SELECT CAST(c_nationkey AS VARCHAR) AS k, MIN(c_name) AS nm, CASE WHEN COUNT(*) > 60 THEN 'calendar' ELSE 'feed' END AS src
           FROM customer GROUP BY 1),
s AS (SELECT CAST(s_nationkey AS VARCHAR) AS k, MAX(s_name) AS nm, CASE WHEN MIN(s_acctbal) < 0 THEN 'listed' END AS src
      FROM supplier GROUP BY 1),
d AS (SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS nm FROM nation WHERE n_regionkey < 3)
SELECT COALESCE(a.k, s.k, d.k) AS event, COALESCE(d.nm, s.nm, a.nm) AS eventName,
       COALESCE(CASE WHEN a.src <> 'calendar' THEN a.src END, s.src, a.src) AS source
FROM a FULL JOIN s ON a.k = s.k FULL JOIN d ON COALESCE(a.k, s.k) = d.k""")
def q_three_way_index(spark, sf_dir):
    archive = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("event")).agg(
        F.min("c_name").alias("eventName"), F.when(F.count(F.lit(1)) > 60, "calendar").otherwise("feed").alias("source"))
    listed = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("event")).agg(
        F.max("s_name").alias("eventName"), F.when(F.min("s_acctbal") < 0, "listed").alias("source"))
    dated = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(
        F.col("n_nationkey").cast("string").alias("event"), F.col("n_name").alias("eventName"))
    return ix.merge_event_indexes(archive, listed, dated, "event", ["eventName", "source"])


@query("""
SELECT CAST(c_nationkey AS VARCHAR) AS event FROM customer UNION SELECT CAST(s_suppkey AS VARCHAR) FROM supplier
UNION SELECT n_name FROM nation""")
def q_union_keys(spark, sf_dir):
    return facets.union_keys([
        table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("event")),
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("event")),
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("event"))], "event")


@query("""
SELECT CAST(o_custkey AS BIGINT) AS event, CAST(o_orderkey AS VARCHAR) AS code, o_orderkey AS position FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def q_missing_codes(spark, sf_dir):
    minimal = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" --")).alias("raw"),
        F.col("o_orderkey").alias("seq"), "o_orderpriority")
    primary = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit("-")).alias("raw"))
    known = primary.join(minimal.select("event", F.col("seq").cast("string").alias("own")),
                         text.norm_code(F.col("raw")) == F.col("own")).select("event", "raw")
    code = F.regexp_replace(text.norm_code(F.col("raw")), " +$", "")
    wanted = F.col("o_orderpriority").rlike("URGENT|HIGH")
    return merge.missing_codes(minimal, known, ["event"], code, wanted, "seq")


@query("""
WITH spans AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS lo FROM events WHERE event_type = 'purchase')
SELECT event_id, e.user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day
FROM events e WHERE event_type <> 'purchase' AND NOT EXISTS (
  SELECT 1 FROM spans s WHERE s.user_id = e.user_id
    AND date_diff('day', DATE '2024-01-01', CAST(e.ts AS DATE)) BETWEEN s.lo AND s.lo + 2)""")
def q_uncovered(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.datediff(
        F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("day"))
    singles = events.filter("event_type <> 'purchase'").select("event_id", "user_id", "day")
    spans = events.filter("event_type = 'purchase'").select("user_id", F.col("day").alias("low"), (F.col("day") + 2).alias("high"))
    return html_pages.uncovered(singles, spans, ["user_id"], "day", "low", "high", width=8)


@query("""
WITH old AS (SELECT l_orderkey, MAX(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' AND price IS NOT NULL THEN price
       ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS price
FROM orders LEFT JOIN old ON o_orderkey = l_orderkey""")
def q_enrich(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", cents("o_totalprice").alias("price"))
    old = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(cents("l_extendedprice")).alias("price"))
    return merge.enrich_missing(orders, old, ["o_orderkey"], F.col("o_orderstatus") == "P", {"price": F.col("old.price")})


@query("""
WITH paged AS (
  SELECT 0 AS page, * FROM orders WHERE o_orderstatus IN ('F','O') UNION ALL
  SELECT 1, * FROM orders WHERE o_orderstatus IN ('O','P') UNION ALL
  SELECT 2, * FROM orders WHERE o_orderstatus IN ('P','F'))
SELECT o_orderkey, CAST(MIN(page) AS BIGINT) AS page FROM paged GROUP BY o_orderkey""")
def q_union_pages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    pages = [orders.filter(F.col("o_orderstatus").isin(*s)) for s in ("FO", "OP", "PF")]
    kept = merge.dedupe_first(merge.union_pages(pages), [], F.col("o_orderkey").cast("string"), ["page", "o_orderkey"])
    return kept.select("o_orderkey", F.col("page").cast("bigint").alias("page"))


@query(f"""
WITH sides AS (
  SELECT *, unnest([0, 1]) AS team_pos FROM lineitem),
cand AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_tax,
         l_linestatus, l_shipdate, team_pos,
         CASE WHEN team_pos = 0 THEN l_returnflag ELSE l_linestatus END AS team,
         CASE WHEN team_pos = 0 THEN l_linestatus ELSE l_returnflag END AS opponent,
         CASE WHEN team_pos = 0 THEN l_discount = 0 ELSE l_tax = 0 END AS z, l_quantity > 25 AS s FROM sides),
folded AS (
  SELECT l_orderkey, list_reduce(list(struct_pack(z := z, s := s, team := team, opponent := opponent, ln := l_linenumber)
           ORDER BY {', '.join(_FOLD_ORDER)}, team_pos),
         lambda e, c: CASE WHEN (e.z AND NOT c.z) OR (NOT e.s AND c.s) THEN c ELSE e END) AS r
  FROM cand GROUP BY l_orderkey)
SELECT l_orderkey AS unit, r.team AS team, r.opponent AS opponent, CAST(r.ln AS BIGINT) AS line_no FROM folded""")
def q_standings_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")

    def side(own, other, zero):
        return F.struct(F.col(own).alias("org"), F.array(F.struct(
            F.col(other).alias("org"), zero.alias("zero"), (F.col("l_quantity") > 25).alias("started"))).alias("opponents"))

    blocks = lines.withColumn("result", F.array(side("l_returnflag", "l_linestatus", F.col("l_discount") == 0),
                                                side("l_linestatus", "l_returnflag", F.col("l_tax") == 0)))
    pairs = standings_pairs(blocks, ["l_orderkey"], _FOLD_ORDER, F.col("result"), F.col("team.opponents"))
    kept = merge.dedupe_fold(pairs, ["l_orderkey"], [*_FOLD_ORDER, "team_pos", "opponent_pos"], F.col("opponent.zero"),
                             F.col("opponent.started"))
    return kept.select(F.col("l_orderkey").alias("unit"), F.col("team.org").alias("team"),
                       F.col("opponent.org").alias("opponent"), F.col("l_linenumber").cast("bigint").alias("line_no"))


# ---- lookups ---------------------------------------------------------------------------

@query("""
WITH dict AS (
  SELECT upper(c_name) || ' ' || c_mktsegment AS k, 'T-' || c_custkey AS v FROM customer WHERE c_nationkey < 12 UNION ALL
  SELECT c_name || ' ' || c_mktsegment, 'B-' || c_custkey FROM customer WHERE c_acctbal > 5000),
cand AS (
  SELECT c_custkey, p.pos, p.k FROM (
    SELECT c_custkey, unnest([struct_pack(pos := 1, k := c_mktsegment || ' ' || c_name), struct_pack(pos := 2, k := c_name || ' ' || c_mktsegment),
             struct_pack(pos := 3, k := upper(c_name) || ' ' || c_mktsegment), struct_pack(pos := 4, k := c_mktsegment || ' ' || upper(c_name))]) AS p
    FROM customer))
SELECT c.c_custkey, COALESCE(h.v, c.c_mktsegment || ' ' || c.c_name) AS translated
FROM customer c LEFT JOIN (SELECT c_custkey, arg_min(v, pos) AS v FROM cand JOIN dict USING (k) GROUP BY c_custkey) h
  ON c.c_custkey = h.c_custkey""")
def q_translate_names(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    people = customer.select("c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"))

    def entry(rows, key, prefix):
        return rows.select(F.lit("players").alias("kind"), key.alias("key"),
                           F.concat(F.lit(prefix), F.col("c_custkey").cast("string")).alias("value"))

    dictionary = entry(customer.filter("c_nationkey < 12"), F.concat_ws(" ", F.upper("c_name"), "c_mktsegment"), "T-").unionByName(
        entry(customer.filter("c_acctbal > 5000"), F.concat_ws(" ", "c_name", "c_mktsegment"), "B-"))
    return lookup.translate_names(people, "name", dictionary, "translated").select("c_custkey", "translated")


@query("""
WITH dict AS (SELECT n_name AS k, 'N' || n_nationkey AS v FROM nation WHERE n_regionkey < 3
              UNION ALL SELECT 'BUILDING/NATION_4', 'whole' UNION ALL SELECT 'AUTOMOBILE', 'cars'),
rows AS (SELECT c_custkey, c_mktsegment || '/' || n_name AS org, c_mktsegment AS seg, n_name,
                CASE WHEN c_acctbal < 1000 THEN n_name ELSE '' END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, COALESCE(dc.v, dorg.v, COALESCE(ds.v, seg) || '/' || COALESCE(dn.v, n_name)) AS org
FROM rows LEFT JOIN dict dc ON dc.k = code LEFT JOIN dict dorg ON dorg.k = org LEFT JOIN dict ds ON ds.k = seg
LEFT JOIN dict dn ON dn.k = n_name""")
def q_translate_orgs(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey", F.concat_ws("/", "c_mktsegment", "n_name").alias("org_raw"),
        F.when(F.col("c_acctbal") < 1000, F.col("n_name")).otherwise("").alias("code"))
    named = nation.filter("n_regionkey < 3").select(
        F.lit("teams").alias("kind"), F.col("n_name").alias("key"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("value"))
    fixed = spark.createDataFrame([("teams", "BUILDING/NATION_4", "whole"), ("teams", "AUTOMOBILE", "cars")],
                                  "kind string, key string, value string")
    return lookup.translate_orgs(rows, "org_raw", "code", named.unionByName(fixed), "org").select("c_custkey", "org")


@query("""
WITH d AS (SELECT p_size, arg_max(p_name || '#' || p_partkey, p_partkey) AS description FROM part GROUP BY p_size)
SELECT l_returnflag, description, COUNT(*) AS n FROM lineitem LEFT JOIN d ON p_size = CAST(l_quantity AS INTEGER) GROUP BY ALL""")
def q_event_desc(spark, sf_dir):
    described = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("k"), F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("description"), "p_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("k"))
    return lookup.lookup_descriptions(lines, ["k"], described, "p_partkey").groupBy("l_returnflag", "description").agg(
        F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'main-' || c_nationkey ELSE CAST(o_custkey AS VARCHAR) END AS resolved
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def q_alias(spark, sf_dir):
    aliases = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("alias"),
        F.concat(F.lit("main-"), F.col("c_nationkey").cast("string")).alias("canonical"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("event"))
    return ix.resolve_event_alias(orders, "event", aliases, "resolved").select("o_orderkey", "resolved")


@query("""
WITH named AS (
  SELECT o_custkey, o_orderkey, COALESCE(NULLIF(trim(CASE WHEN o_orderstatus = 'F' THEN ' ' ELSE o_orderstatus END), ''), '') AS nm
  FROM orders),
f AS (SELECT o_custkey, arg_min(nm, o_orderkey) FILTER (nm <> '') AS nm FROM named GROUP BY o_custkey)
SELECT c_custkey, COALESCE(CASE WHEN c_custkey < 3000 THEN CASE WHEN c_acctbal < 0 THEN c_mktsegment END END, f.nm,
       CASE WHEN c_acctbal < 0 THEN c_mktsegment END, '') AS name
FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def q_event_name(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderstatus")).alias("a"),
        F.lit(None).cast("string").alias("b"))
    first = ix.first_name(orders, ["o_custkey"], ["a", "b"], "o_orderkey")
    customer = table(spark, sf_dir, "customer").join(first.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    stored = F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment"))
    return customer.select("c_custkey", ix.resolved_name(F.col("c_custkey").cast("string"), stored, F.lit(""), F.col("name")).alias("name"))


# ---- facets and filters ----------------------------------------------------------------

@query("""
WITH listed AS (SELECT DISTINCT p_brand, p_name FROM part),
ours AS (SELECT DISTINCT p_brand, l_linestatus || ' ' || l_linenumber || ' ' || p_type AS p_name FROM part JOIN lineitem ON l_partkey = p_partkey
         UNION SELECT p_brand, p_name FROM part WHERE p_partkey % 2 = 0)
SELECT p_brand, p_name, 'left' AS side FROM listed EXCEPT SELECT p_brand, p_name, 'left' FROM ours
UNION ALL (SELECT p_brand, p_name, 'right' FROM ours EXCEPT SELECT p_brand, p_name, 'right' FROM listed)""")
def q_category_align(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    shipped = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", F.col("l_linenumber").cast("string").alias("l"))
    shipped = part.join(shipped, part.p_partkey == shipped.l_partkey).select("p_brand", F.concat_ws(" ", "l_linestatus", "l", "p_type").alias("p_name"))
    even = part.withColumn("p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))).select("p_brand", "p_name").na.drop()
    return facets.set_diff(part, shipped.unionByName(even), ["p_brand", "p_name"])


@query("""
WITH rep AS (
  SELECT p_brand, p_type, COUNT(*) AS matches, COUNT(DISTINCT p_name) AS rounds, BOOL_OR(p_size <= 12) AS k,
         BOOL_OR(p_size BETWEEN 13 AND 25) AS g, BOOL_OR(p_size BETWEEN 26 AND 48) AS q, BOOL_OR(p_size > 48) AS o
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT l.p_brand, l.p_type, COALESCE(matches, 0) AS matches, COALESCE(rounds, 0) AS rounds,
       concat_ws(',', CASE WHEN g AND k THEN 'group_and_knockout_mixed' END, CASE WHEN o THEN 'unknown_round_bucket' END,
                 CASE WHEN matches IS NULL THEN 'listed_but_no_matches' END) AS suspicious
FROM (SELECT DISTINCT p_brand, p_type FROM part) l LEFT JOIN rep ON rep.p_brand = l.p_brand AND rep.p_type = l.p_type""")
def q_category_report(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    size = F.col("p_size")
    bucket = F.when(size <= 12, "knockout").when(size <= 25, "group").when(size <= 48, "qualifying").otherwise("other")
    rep = facets.category_report(rows, ["p_brand"], "p_type", F.col("p_name"), bucket)
    checked = facets.suspicious_categories(part.select("p_brand", "p_type").distinct(), rep, ["p_brand", "p_type"])
    return checked.select("p_brand", "p_type", "matches", "rounds", F.array_join("suspicious", ",").alias("suspicious"))


@query("""
WITH c AS (SELECT c_nationkey, o_orderpriority, BOOL_OR(o_orderstatus = 'F' AND o_totalprice > 490000) AS ok
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT CAST(c_nationkey AS BIGINT) AS event, BOOL_AND(ok) AS finished FROM c GROUP BY 1""")
def q_group_finished(spark, sf_dir):
    rows = nation_orders(spark, sf_dir, "o_orderpriority", "o_orderstatus", "o_totalprice")
    ok = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 490000)
    return stages.event_finished(rows, ["event"], F.col("o_orderpriority"), ok)


_PART_CATEGORY_SQL = """
p AS (SELECT p_partkey AS seq, p_brand AS event, p_name,
  CASE p_type WHEN 'ECONOMY' THEN 'Men Singles' WHEN 'PROMO' THEN 'U' || p_size || ' Boys'' Doubles'
       WHEN 'LARGE' THEN 'Women''s Teams' WHEN 'SMALL' THEN 'U' || p_size || ' Girls Singles' WHEN 'STANDARD' THEN '' ELSE p_name END AS cat,
  CASE WHEN p_size % 2 = 0 THEN 'men' ELSE 'women' END AS gender, CASE WHEN p_size < 25 THEN 'singles' ELSE 'doubles' END AS disc,
  p_type, p_size FROM part)"""


def _part_matches(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_type")
    age = size.cast("string")
    category = (F.when(kind == "ECONOMY", "Men Singles").when(kind == "PROMO", F.concat(F.lit("U"), age, F.lit(" Boys' Doubles")))
                .when(kind == "LARGE", "Women's Teams").when(kind == "SMALL", F.concat(F.lit("U"), age, F.lit(" Girls Singles")))
                .when(kind == "STANDARD", "").otherwise(F.col("p_name")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_brand").alias("event"), category.alias("categoryName"),
        F.when(size % 2 == 0, "men").otherwise("women").alias("gender"),
        F.when(size < 25, "singles").otherwise("doubles").alias("discipline"), (kind == "MEDIUM").alias("isParaClass"),
        "p_name", "p_size", "p_type")


@query(f"""
WITH {_PART_CATEGORY_SQL},
v AS (SELECT *, CASE WHEN cat <> '' THEN cat ELSE gender || ' ' || disc END AS value FROM p WHERE p_type <> 'MEDIUM'),
f AS (SELECT event, value, MIN(seq) AS first_seq FROM v GROUP BY 1, 2)
SELECT f.event, f.value, f.first_seq,
  CASE v.p_type WHEN 'ECONOMY' THEN '男子シングルス' WHEN 'LARGE' THEN '女子団体' WHEN 'PROMO' THEN 'U' || p_size || '男子ダブルス'
    WHEN 'SMALL' THEN 'U' || p_size || '女子シングルス'
    ELSE CASE gender WHEN 'men' THEN '男子' ELSE '女子' END || CASE disc WHEN 'singles' THEN 'シングルス' ELSE 'ダブルス' END END AS label,
  CAST(CASE WHEN v.p_type IN ('PROMO','SMALL') THEN 0 ELSE 1 END AS BIGINT) AS tier,
  CAST(CASE v.p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'SMALL' THEN 0
       ELSE CASE disc WHEN 'singles' THEN 0 ELSE 2 END END AS BIGINT) AS kind,
  CAST(CASE WHEN v.p_type IN ('PROMO','SMALL') THEN -p_size ELSE 0 END AS BIGINT) AS age
FROM f JOIN v ON v.seq = f.first_seq""")
def q_category_options(spark, sf_dir):
    options = facets.category_options(_part_matches(spark, sf_dir), ["event"])
    return options.select("event", "value", "label", "first_seq",
                          *[F.col(f"sort_key.{c}").cast("bigint").alias(c) for c in ("tier", "kind", "age")])


@query("""
WITH base AS (SELECT CAST(c_nationkey AS VARCHAR) AS event, o_orderkey AS seq, o_orderpriority AS pr, o_orderstatus AS st
              FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT *, CASE left(pr, 1) WHEN '1' THEN 'Round of 16' WHEN '2' THEN 'Finals' WHEN '3' THEN 'Group B' WHEN '4' THEN 'Round 2'
        ELSE 'Stage 1A' END AS value FROM base),
f AS (SELECT event, value, MIN(seq) AS first_seq FROM k GROUP BY 1, 2),
n AS (SELECT event, value, ROW_NUMBER() OVER (PARTITION BY event ORDER BY CASE value WHEN 'Finals' THEN 2 ELSE 1 END) AS no
      FROM f WHERE value IN ('Round of 16', 'Finals'))
SELECT f.event, f.value, f.first_seq,
  CASE f.value WHEN 'Group B' THEN 'Group B' WHEN 'Round 2' THEN 'Round 2' WHEN 'Stage 1A' THEN 'Stage1A'
       ELSE '決勝トーナメント' || no || '回戦' END AS label,
  CAST(CASE f.value WHEN 'Group B' THEN 2 WHEN 'Round 2' THEN 100 WHEN 'Stage 1A' THEN 999 ELSE 100 + no END AS BIGINT) AS sort_value
FROM f LEFT JOIN n ON n.event = f.event AND n.value = f.value""")
def q_round_options(spark, sf_dir):
    step = F.substring("o_orderpriority", 1, 1)
    label = text.look_up({"1": "Round of 16", "2": "Finals", "3": "Group B", "4": "Round 2", "5": "Stage 1A"}, step)
    rows = nation_orders(spark, sf_dir, "o_orderkey", "o_orderpriority", light=False).select(
        F.col("event").cast("string").alias("event"), F.col("o_orderkey").alias("seq"), label.alias("roundLabel"),
        F.lit(None).cast("string").alias("source"))
    rows = rows.withColumn("roundKey", labels.norm_round(F.col("roundLabel")))
    return facets.round_options(rows, ["event"], LabelRules())


@query("""
SELECT CAST(c_nationkey AS VARCHAR) AS event, COUNT(*) AS fetched, COUNT(*) FILTER (o_orderstatus = 'F') AS returned
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def q_result_summary(spark, sf_dir):
    rows = nation_orders(spark, sf_dir, "o_orderstatus").withColumn("event", F.col("event").cast("string"))
    return facets.result_summary(rows, filters.filter_code(rows, "F", "o_orderstatus"), ["event"])


@query("""
SELECT CAST(c_nationkey AS BIGINT) AS event, o_orderpriority AS round, MIN(o_orderkey) AS first_seq
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def q_available_rounds(spark, sf_dir):
    rows = nation_orders(spark, sf_dir, "o_orderkey", "o_orderpriority")
    return facets.available_rounds(rows, ["event"], "o_orderpriority", "o_orderkey")


@query(f"""
WITH {_PART_CATEGORY_SQL},
b AS (SELECT *, event || '/' || p_size AS scope FROM p WHERE p_type <> 'MEDIUM'),
h AS (SELECT *, cat IN ('Men Singles') AS hit, BOOL_OR(cat IN ('Men Singles')) OVER (PARTITION BY event, p_size) AS any_hit FROM b)
SELECT seq, event FROM h WHERE hit OR NOT any_hit""")
def q_filter_category(spark, sf_dir):
    rows = filters.drop_excluded(_part_matches(spark, sf_dir))
    return filters.filter_category(rows, ["event", "p_size"], "men singles").select("seq", "event")


@query(f"""
WITH {_PART_CATEGORY_SQL} SELECT seq FROM p WHERE p_type = 'LARGE' AND gender = 'women' AND disc = 'doubles'""")
def q_filter_exact(spark, sf_dir):
    rows = filters.filter_category(_part_matches(spark, sf_dir), ["event"], "womens teams", generic=False)
    return filters.filter_discipline(filters.filter_gender(rows, "girls"), "Double").select("seq")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'round_of_32' WHEN '2' THEN 'quarterfinal'
             WHEN '3' THEN 'final' WHEN '4' THEN 'stage_1a_group' ELSE 'preliminary_round' END AS k FROM orders),
n AS (SELECT *, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY CASE k WHEN 'round_of_32' THEN 1 WHEN 'quarterfinal' THEN 2
             WHEN 'final' THEN 3 ELSE 9 END) AS no FROM r)
SELECT o_orderkey, k FROM n WHERE (k IN ('round_of_32','quarterfinal','final') AND no = 2) OR k = 'stage_1a_group'""")
def q_filter_rounds(spark, sf_dir):
    key = text.look_up({"1": "round_of_32", "2": "quarterfinal", "3": "final", "4": "stage_1a_group", "5": "preliminary_round"},
                       F.substring("o_orderpriority", 1, 1))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", key.alias("k"))
    return filters.filter_rounds(rows, ["o_custkey"], ["第２回戦", "Group"], "k").select("o_orderkey", "k")


@query("""
SELECT p_partkey FROM part WHERE p_type <> 'PROMO' AND p_brand = 'Brand#7' AND (p_type LIKE '%R%' OR p_type LIKE '%M%')
UNION ALL SELECT o_orderkey + 1000000000 FROM orders WHERE lower(o_orderpriority) = '2-high' AND o_orderdate < '1997-06-15'""")
def q_filters(spark, sf_dir):
    parts = filters.drop_excluded(table(spark, sf_dir, "part"), F.col("p_type") == "PROMO")
    parts = filters.filter_code(parts, "Brand#7", "p_brand")
    code = F.regexp_replace("p_type", "R", "QF")
    kept = parts.filter(text.knockout_code(code) | text.knockout_code(F.regexp_replace("p_type", "M", "SF"))).select("p_partkey")
    orders = table(spark, sf_dir, "orders").withColumns({"d": F.lit(None).cast("string"), "c": F.col("o_orderpriority")})
    scoped = filters.facet_scope(orders, gender=" 2-HIGH ", columns=("c", "o_orderpriority", "d"), excluded=F.lit(False))
    early = scoped.filter(dates.ended_before(day("o_orderdate"), F.lit("1997-06-15")))
    return kept.unionByName(early.select((F.col("o_orderkey") + 1000000000).alias("p_partkey")))


@query(f"""
WITH {_PART_CATEGORY_SQL} SELECT seq FROM p WHERE p_type = 'PROMO' AND p_size = 17""")
def q_facet_scope(spark, sf_dir):
    return filters.facet_scope(_part_matches(spark, sf_dir), category="u17  BOYS Doubles").select("seq")


@query("""
SELECT o_orderkey, o_custkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3""")
def q_limit_rows(spark, sf_dir):
    return filters.limit_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], 3)


# ---- search ----------------------------------------------------------------------------

_ASCII = "trim(regexp_replace(regexp_replace(lower({0}), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = ("list_transform(string_split({0}, ' '), lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') "
           "THEN CASE WHEN ltrim(w, '0') = '' THEN '0' ELSE ltrim(w, '0') END ELSE w END)")


@query(f"""
WITH d AS (SELECT doc_id, {_TOKENS.format(_ASCII.format('text'))} AS w FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS event FROM d
WHERE (list_contains(w, 'the') AND list_contains(w, 'whst')) OR contains(array_to_string(w, ' '), 'whst the') ORDER BY doc_id LIMIT 50""")
def q_event_search(spark, sf_dir):
    none = F.lit(None).cast("string")
    events = spread_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("event"), F.col("text").alias("eventName"), none.alias("startDate"),
        none.alias("endDate"), F.lit("").alias("dateLabel"))
    return jobs.event_search(events, "Whst, the").select("event")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS event, strftime(o_orderdate, '%Y-%m-%d') AS startDate FROM orders
WHERE strftime(o_orderdate, '%Y %-m') = '1997 3' OR strftime(o_orderdate + INTERVAL 5 DAY, '%Y %-m') = '1997 3'
ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def q_event_search_dates(spark, sf_dir):
    start, end = day("o_orderdate"), F.date_format(F.date_add("o_orderdate", 5), "yyyy-MM-dd")
    events = spread_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("event"), F.lit("Open").alias("eventName"), start.alias("startDate"),
        end.alias("endDate"), dates.date_range_label(start, end).alias("dateLabel"))
    return jobs.event_search(events, "1997-03").select("event", "startDate")


@query("""
SELECT p_partkey FROM part
WHERE contains(trim(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), 'bolt brand 1')""")
def q_search_contains(spark, sf_dir):
    searched = text.norm_search(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return filters.filter_contains(table(spark, sf_dir, "part"), "Bolt, BRAND#1", searched).select("p_partkey")


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || ' ' || p_type || ' ' || p_name
                                  ELSE p_name || ' ' || p_brand || ' ' || p_type END AS t FROM part)
SELECT p_partkey FROM p WHERE contains(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), 'brand 1')""")
def q_indexed_contains(spark, sf_dir):
    """All parts indexed, then the large ones upserted with another text."""
    parts, index = table(spark, sf_dir, "part"), TrigramIndex(new_folder(spark, "parts"), 16, "bigint")
    index.write(parts, F.col("p_partkey"), text.norm_search(F.concat_ws(" ", "p_name", "p_brand", "p_type")))
    index.upsert(parts.filter("p_size > 25"), F.col("p_partkey"), text.norm_search(F.concat_ws(" ", "p_brand", "p_type", "p_name")))
    return search.find_contains(spark, index, "BRAND#1").select(F.col("key").alias("p_partkey"))


@query(f"""
WITH d AS (SELECT doc_id, {_TOKENS.format(_ASCII.format('text'))} AS w FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS event FROM d
WHERE (list_contains(w, 'the') AND list_contains(w, 'whst')) OR contains(array_to_string(w, ' '), 'whst the')""")
def q_indexed_events(spark, sf_dir):
    events = spread_table(spark, sf_dir, "documents").withColumn("event", F.col("doc_id").cast("string"))
    index = TrigramIndex(new_folder(spark, "events")).write(
        events, F.col("event"), search.event_haystack(F.col("event"), F.col("text"), F.array().cast("array<string>")))
    return search.find_events(spark, index, "Whst, the").select(F.col("key").alias("event"))


@query(f"""
WITH {ORDER_MATCHES_SQL}
SELECT seq, trim(regexp_replace(lower(concat_ws(' ', 'D' || seq, rlabel, rkey,
  CASE st WHEN 'F' THEN concat_ws(' ', own, seg, own, own, own, own, own, 'Rival', 'ORG', 'Rival', 'Rival', 'Rival', 'Rival', 'Rival')
          WHEN 'O' THEN concat_ws(' ', own, seg, own, own, own, own, own, 'Partner', 'Partner', 'Partner', 'Rival', 'AAA', 'Rival', 'Rival', 'Rival', 'Rival', 'Rival', 'Friend', 'Friend', 'Friend')
          ELSE concat_ws(' ', 'Team ' || seg, seg, 'Team ' || seg, 'Rivals', 'ORG', 'Rivals',
            own, seg, own, own, own, own, own, 'Rival', 'ORG', 'Rival', 'Rival', 'Rival', 'Rival', 'Rival',
            'Rival', 'ORG', 'Rival', 'Rival', 'Rival', 'Rival', 'Rival', own, seg, own, own, own, own, own) END)),
  '[^a-z0-9]+', ' ', 'g')) AS search_text FROM m""")
def q_search_text(spark, sf_dir):
    return order_matches(spark, sf_dir).select("seq", search.match_search_text(Names()).alias("search_text"))


@query("""
SELECT CAST(o_orderkey AS BIGINT) AS event, strftime(o_orderdate, '%Y-%m-%d') AS start FROM orders
ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def q_sort_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("event"), day("o_orderdate").alias("start"),
        F.lit(None).cast("string").alias("end"))
    return search.top_events(rows, "start", "end", "event").select(F.col("event").cast("bigint").alias("event"), "start")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS event, c_name AS "eventName", '/events/result' || c_custkey || '/' AS "eventUrl",
       'finished' AS status FROM customer
WHERE contains(c_custkey || ' customer ' || c_custkey, 'customer ' || 17)""")
def q_domestic_search(spark, sf_dir):
    names_table = table(spark, sf_dir, "customer").select(
        F.lit("zennihon").alias("source"), F.col("c_custkey").cast("string").alias("event"), F.col("c_name").alias("name"))
    return jobs.domestic_search(names_table, "Customer #017", "/events/result").select("event", "eventName", "eventUrl", "status")


# ---- dates, names of events, index -----------------------------------------------------

@query("""
WITH e AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS s,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 30 END AS e, o_orderpriority || ' 20' || (o_orderkey % 90 + 10) || ' cup' AS nm,
         2000 + o_orderkey % 90 + 10 AS y FROM orders)
SELECT o_orderkey,
  CASE WHEN s IS NULL AND e IS NULL THEN CASE WHEN y < 1997 THEN 'finished' WHEN y > 1997 THEN 'upcoming' ELSE 'unknown' END
       WHEN s > DATE '1997-06-15' THEN 'upcoming' WHEN e < DATE '1997-06-15' THEN 'finished'
       WHEN s <= DATE '1997-06-15' AND e >= DATE '1997-06-15' THEN 'live' ELSE 'unknown' END AS status,
  CASE WHEN s IS NULL THEN '' WHEN e IS NULL THEN strftime(s, '%Y/%-m/%-d')
       WHEN year(s) = year(e) AND month(s) = month(e) THEN strftime(s, '%Y/%-m/%-d') || '-' || day(e)
       ELSE strftime(s, '%Y/%-m/%-d') || '-' || strftime(e, '%-m/%-d') END AS label,
  COALESCE(e < DATE '1997-06-15', FALSE) AS ended FROM e""")
def q_lifecycle(spark, sf_dir):
    start = F.when(F.col("o_orderstatus") != "P", day("o_orderdate"))
    end = F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd"))
    name = F.concat(F.col("o_orderpriority"), F.lit(" 20"), (F.col("o_orderkey") % 90 + 10).cast("string"), F.lit(" cup"))
    orders = spread_table(spark, sf_dir, "orders").select("o_orderkey", start.alias("s"), end.alias("e"), name.alias("n"))
    s, e = F.col("s"), F.col("e")
    now = F.lit("1997-06-15").cast("date")
    return orders.select("o_orderkey", dates.lifecycle_status(s, e, F.lit("unknown"), F.col("n"), now).alias("status"),
                         dates.date_range_label(s, e).alias("label"), dates.ended_before(e, F.lit("1997-06-15")).alias("ended"))


@query("""
WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS event, o_totalprice > 100000 AS archived, o_totalprice > 400000 AS forced,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN '1990-01-01'
                       WHEN o_orderpriority <> '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders WHERE o_orderstatus IN ('F', 'O')),
f AS (SELECT CAST(o_orderkey AS VARCHAR) AS event, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority AS t, o_totalprice > 300000 AS fin
      FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW')
SELECT CAST(o_orderkey AS VARCHAR) AS event,
  CASE WHEN f.event IS NOT NULL THEN 'feed' ELSE 'wtt' END AS source, COALESCE(f.t, '') AS title,
  CASE WHEN a.archived AND NOT a.forced AND a.d < '1998-01-01' THEN 'archived' WHEN a.d < '1998-01-01' OR f.fin OR f.d < '1998-01-01' THEN 'finished'
       ELSE 'live' END AS mode,
  COALESCE(CASE WHEN f.event IS NOT NULL THEN '1990-01-01' ELSE a.d END, '') AS "startDate"
FROM orders LEFT JOIN a ON a.event = CAST(o_orderkey AS VARCHAR) LEFT JOIN f ON f.event = CAST(o_orderkey AS VARCHAR)""")
def q_lifecycle_meta(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("event", F.col("o_orderkey").cast("string"))
    none = F.lit(None).cast("string")
    # urgent ones carry explicit nulls, high ones lack the dates
    own_date = F.when(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), day("o_orderdate"))
    carried = F.when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("archived"))).otherwise(F.array(F.lit("startDate"), F.lit("endDate")))
    indexed = orders.filter("o_orderstatus in ('F', 'O')").select(
        "event", none.alias("source"), none.alias("title"), own_date.alias("startDate"), own_date.alias("endDate"), carried.alias("present"),
        (F.col("o_totalprice") > 100000).alias("archived"), (F.col("o_totalprice") > 400000).alias("forced"),
        F.lit(False).alias("canAutoArchive"), none.alias("eventName"))
    dated = orders.filter("o_orderstatus = 'F'").select("event", none.alias("source"), none.alias("title"), none.alias("eventName"),
                                                        F.lit("1990-01-01").alias("startDate"), F.lit("1990-01-01").alias("endDate"))
    feed = ix.daily_meta(orders.filter("o_orderstatus = 'P' and o_orderpriority <> '5-LOW'").select(
        "event", none.alias("champDesc"), F.col("o_orderpriority").alias("champ"), (F.col("o_totalprice") > 300000).alias("isFinished"),
        F.array(F.struct(F.lit("").alias("raw")), F.struct(F.lit("1990-01-01").alias("raw")),
                F.struct(day("o_orderdate").alias("raw"))).alias("dates"), F.lit("feed").alias("feed_source")))
    return ix.lifecycle_meta(orders, dated, indexed, feed, "1998-01-01").select(
        "event", "source", "title", "mode", F.coalesce("startDate", F.lit("")).alias("startDate"))


@query("""
WITH n AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'ITTF World Youth Championships' WHEN 'PROMO' THEN 'WTT Star Contender'
  WHEN 'LARGE' THEN 'World Team Table Tennis Championships Finals' WHEN 'SMALL' THEN 'Test Champions' WHEN 'STANDARD' THEN 'Grand Smash Team Cup'
  ELSE 'Regional Open' END || ' ' || p_name AS nm, p_type AS t FROM part)
SELECT p_partkey,
  CASE t WHEN 'ECONOMY' THEN 'Youth' WHEN 'PROMO' THEN 'Star Contender' WHEN 'LARGE' THEN 'World Championships' WHEN 'SMALL' THEN 'Champions'
    WHEN 'STANDARD' THEN 'Smash' ELSE 'Other' END AS series,
  CASE WHEN t IN ('ECONOMY','LARGE') THEN 'ITTF' ELSE 'WTT' END AS body, t <> 'SMALL' AS indexable, t IN ('PROMO','LARGE') AS hosted,
  t = 'ECONOMY' AS preferred,
  CASE WHEN p_partkey < 3000 AND t NOT IN ('PROMO','LARGE') THEN 'r/' || p_partkey || '/results.html#/results'
       WHEN t = 'ECONOMY' THEN 'r/TTE' || p_partkey || '/results.html#/results'
       WHEN t IN ('LARGE','STANDARD') THEN 't/' || p_partkey ELSE 'e/' || p_partkey END AS url FROM n""")
def q_series(spark, sf_dir):
    prefix = {"ECONOMY": "ITTF World Youth Championships", "PROMO": "WTT Star Contender", "LARGE": "World Team Table Tennis Championships Finals",
              "SMALL": "Test Champions", "STANDARD": "Grand Smash Team Cup"}
    name = F.concat_ws(" ", F.coalesce(text.look_up(prefix, F.col("p_type")), F.lit("Regional Open")), "p_name")
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("n"))
    n, event = F.col("n"), F.col("p_partkey").cast("string")
    return rows.select("p_partkey", labels.series(n).alias("series"), labels.governing_body(n).alias("body"),
                       labels.indexable_name(n).alias("indexable"), labels.hosted_name(n).alias("hosted"),
                       labels.results_preferred_name(n).alias("preferred"),
                       ix.event_url(event, F.lit(""), n, ix.UrlBases("e/", "t/", "r/")).alias("url"))


@query("""
SELECT o_orderkey, array_to_string(list_distinct_ordered, '|') AS tokens FROM (
  SELECT o_orderkey, [strftime(o_orderdate, '%m/%d/%Y %H:%M:%S'), strftime(o_orderdate, '%Y%m%d%H%M'), strftime(o_orderdate, '%Y%m%d%H%M') || '-',
    strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d %H:%M'), strftime(o_orderdate, '%Y/%m/%d'), strftime(o_orderdate, '%Y/%m/%d %H:%M'),
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')] AS list_distinct_ordered FROM orders)""")
def q_date_tokens(spark, sf_dir):
    local = F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss")
    utc = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return spread_table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(dates.date_tokens(local, utc), "|").alias("tokens"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS event, o_orderpriority AS "eventName",
       CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "startDate"
FROM orders WHERE o_orderkey > 0  -- an id of zero is none""")
def q_calendar_rows(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    rows = spread_table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "0").otherwise(F.col("o_orderkey").cast("string")).alias("EventCode"),
        F.when(F.col("o_orderkey") > 0, F.col("o_orderkey").cast("string")).alias("EventId"),
        F.concat(F.lit("  "), F.regexp_replace("o_orderpriority", " ", "   ")).alias("EventName"),
        F.when(F.col("o_orderstatus") == "F", "9").alias("EventDateChangeId"), F.lit(True).alias("ShowInCalendar"),
        stamp.alias("StartDateTime"), F.lit("").alias("EndDateTime"),
        F.date_format(F.date_add("o_orderdate", 7), "yyyy-MM-dd").alias("FromStartDate"), F.lit(None).cast("string").alias("FromEndDate"))
    return ix.normalize_calendar_row(rows).select("event", "eventName", "startDate")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS event, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE o_orderstatus END AS "eventName",
       strftime(o_orderdate, '%Y-%m-%d') AS "startDate", 'calendar' AS source FROM orders""")
def q_date_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("EventId"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("eventName"),
        F.col("o_orderpriority").alias("title"), F.lit("").alias("startDate"), day("o_orderdate").alias("start"))
    return ix.normalize_date_entry(rows).select("event", "eventName", "startDate", "source")


@query("""
WITH e AS (SELECT CAST(c_nationkey + 2490 AS VARCHAR) AS event, MIN(o_orderdate) AS s, MAX(o_orderdate) AS e, COUNT(*) AS n
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
base AS (SELECT event, strftime(s, '%Y-%m-%d') AS sd, strftime(e, '%Y-%m-%d') AS ed, 'Open ' || event AS nm FROM e),
a AS (SELECT CAST(s_nationkey + 2490 AS VARCHAR) AS event, MIN(s_name) AS nm, COUNT(*) > 3 AS arch FROM supplier GROUP BY 1),
j AS (SELECT COALESCE(base.event, a2.event) AS event, base.event AS be, a2.event AS ae, COALESCE(a2.nm, base.nm) AS nm, sd, ed, a2.arch
      FROM base FULL JOIN (SELECT * FROM a WHERE CAST(event AS INTEGER) >= 2500) a2 ON base.event = a2.event)
SELECT event, nm AS "eventName", sd AS "startDate", ed AS "endDate", COALESCE(arch, FALSE) AS archived,
  CASE WHEN sd IS NULL THEN CASE WHEN arch THEN 'finished' ELSE 'unknown' END WHEN sd > '1998-01-01' THEN 'upcoming' WHEN ed < '1998-01-01' THEN 'finished' ELSE 'live' END AS status
FROM j""")
def q_build_index(spark, sf_dir):
    event = F.concat((F.col("event") + 2490).cast("string"))
    matches = nation_orders(spark, sf_dir, "o_orderdate").groupBy(event.alias("event")).agg(
        F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"))
    name = F.concat(F.lit("Open "), F.col("event"))
    start, end = day("s"), day("e")
    now = F.lit("1998-01-01").cast("date")
    found = matches.select(
        "event", name.alias("eventName"), start.alias("startDate"), end.alias("endDate"), dates.date_range_label(start, end).alias("dateLabel"),
        F.lit(False).alias("archived"), dates.lifecycle_status(start, end, F.lit("unknown"), name, now).alias("status"),
        F.lit("wtt").alias("source"), labels.series(name).alias("series"), F.lit("v").alias("verifiedAt"))
    nation = table(spark, sf_dir, "nation").select(event_id("n_nationkey").alias("event"))
    old = nation.select("event", F.lit("Gone").alias("eventName"), *[F.lit(None).cast("string").alias(c) for c in (
        "startDate", "endDate", "dateLabel")], F.lit(False).alias("archived"), *[F.lit("x").alias(c) for c in (
            "status", "source", "series", "verifiedAt")])
    archive = table(spark, sf_dir, "supplier").groupBy(event_id("s_nationkey").alias("event")).agg(
        F.min("s_name").alias("title"), (F.count(F.lit(1)) > 3).alias("archived")).select(
        "event", "title", "archived", *[F.lit(None).cast("string").alias(c) for c in ("startDate", "endDate", "source", "archivedAt", "lastFetchedAt")])
    undated = archive.select("event", F.lit(" ").alias("title"), "startDate", "endDate", "source")
    built = jobs.build_event_index(nation, found, archive, undated, old, now, "v")
    return built.select("event", "eventName", "startDate", "endDate", "archived", "status")


def event_id(c):
    return (F.col(c).cast("bigint") + 2490).cast("string")


@query("""
SELECT COUNT(*) AS events, CAST(COUNT(*) FILTER (c_acctbal < 0) AS BIGINT) AS archived,
       CAST(COUNT(*) FILTER (c_mktsegment = 'BUILDING') AS BIGINT) AS live, CAST(COUNT(*) FILTER (c_mktsegment = 'MACHINERY') AS BIGINT) AS finished,
       CAST(COUNT(*) FILTER (c_mktsegment = 'FURNITURE') AS BIGINT) AS upcoming FROM customer""")
def q_index_summary(spark, sf_dir):
    status = text.look_up({"BUILDING": "live", "MACHINERY": "finished", "FURNITURE": "upcoming"}, F.col("c_mktsegment"))
    return facets.index_summary(table(spark, sf_dir, "customer").select((F.col("c_acctbal") < 0).alias("archived"), status.alias("status")))


@query("""
WITH s AS (
  SELECT o_custkey AS event, MAX(o_orderdate) FILTER (o_orderstatus = 'F') AS arch, MAX(o_orderdate) FILTER (o_orderstatus = 'O') AS live,
         arg_max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END, (o_orderdate, 'error', CASE WHEN o_orderpriority = '1-URGENT' THEN 'fetch failed' ELSE 'bad' END)) FILTER (o_orderstatus = 'P') AS soft,
         MAX(o_orderdate) FILTER (o_orderstatus = 'P') AS failed, BOOL_OR(o_totalprice > 490000) AS ended FROM orders GROUP BY 1),
r AS (SELECT *, CASE WHEN ended AND arch IS NOT NULL THEN 'archive' WHEN live IS NOT NULL THEN 'live'
                     WHEN failed IS NOT NULL AND arch IS NOT NULL AND soft = 1 THEN 'archive' ELSE 'error' END AS answer FROM s)
SELECT event, answer, COALESCE(strftime(CASE answer WHEN 'archive' THEN arch WHEN 'live' THEN live END, '%Y-%m-%d'), '') AS answered_at,
  COALESCE(CASE WHEN answer = 'error' AND arch IS NOT NULL THEN date_diff('minute', arch, TIMESTAMP '2002-01-01') END, -1) AS stale_minutes
FROM r""")
def q_choose_snapshot(spark, sf_dir):
    status = F.col("o_orderstatus")
    snapshots = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event"), F.when(status == "F", "archive").otherwise("live").alias("origin"),
        F.when(status == "P", "error").otherwise("ok").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "fetch failed").otherwise("bad").alias("error"),
        F.col("o_orderdate").cast("timestamp").alias("fetched_at"), (F.col("o_totalprice") > 490000).alias("ended"))
    chosen = files.choose_snapshot(snapshots, "event", F.col("ended"), F.lit(False), F.lit("2002-01-01 00:00:00").cast("timestamp"))
    return chosen.select("event", "answer", F.coalesce(day("answered_at"), F.lit("")).alias("answered_at"),
                         F.coalesce("stale_minutes", F.lit(-1)).alias("stale_minutes"))


# ---- scores ----------------------------------------------------------------------------

@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) % 4 AS a, CAST(round(l_tax * 100) AS BIGINT) % 4 AS b,
  CAST(l_quantity AS BIGINT) AS h1, CAST(round(l_discount * 100) AS BIGINT) AS w1, CAST(round(l_tax * 100) AS BIGINT) AS h2, l_linenumber AS w2,
  l_returnflag = 'R' AND l_linestatus = 'F' AS special, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS l FROM lineitem),
g AS (SELECT *, CASE WHEN l = 0 THEN h1 ELSE w1 END AS l1, CASE WHEN l = 0 THEN w1 ELSE h1 END AS r1,
        CASE WHEN l = 0 THEN h2 ELSE w2 END AS l2, CASE WHEN l = 0 THEN w2 ELSE h2 END AS r2 FROM r)
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS line_no,
  CASE WHEN special THEN 'RET' ELSE CASE WHEN l = 0 THEN a ELSE b END || '(' || CASE WHEN l1 > r1 THEN '' || r1 ELSE '-' || l1 END || ','
       || CASE WHEN l2 > r2 THEN '' || r2 ELSE '-' || l2 END || ')' || CASE WHEN l = 0 THEN b ELSE a END END AS score,
  CASE WHEN a > b THEN 'A' WHEN b > a THEN 'B' ELSE '-' END AS winner, a = 0 AND b = 0 AS zero FROM g""")
def q_score_text(spark, sf_dir):
    q, tax, disc = F.col("l_quantity").cast("bigint"), cents("l_tax"), cents("l_discount")
    score = F.concat_ws("-", (q % 4).cast("string"), (tax % 4).cast("string"))
    listed = F.concat(F.concat_ws("-", q.cast("string"), disc.cast("string")), F.lit(", 0-0 ,"),
                      F.concat_ws("-", tax.cast("string"), F.col("l_linenumber").cast("string")))
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "Retired (ret.)")
    rows = spread_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("line_no"), score.alias("s"),
        scores.split_games(listed).alias("g"), status.alias("st"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("left"))
    shown = scores.score_text(F.col("s"), F.col("g"), F.col("st"), F.col("left"), "en")
    org = scores.winner_org(F.col("s"), F.array(F.lit("A"), F.lit("B")))
    index = F.when(scores.score_winner(F.col("s")) == 0, "A").when(scores.score_winner(F.col("s")) == 1, "B")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "line_no", shown.alias("score"),
                       F.when(org.eqNullSafe(index), F.coalesce(org, F.lit("-"))).otherwise("?").alias("winner"),
                       scores.is_zero_score(F.col("s")).alias("zero"))


@query("""
SELECT l_orderkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lefts, CAST(SUM(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS rights
FROM (SELECT l_orderkey, l_quantity, l_tax FROM lineitem WHERE l_returnflag <> 'R' UNION ALL
      SELECT l_orderkey, l_quantity, l_tax FROM lineitem) GROUP BY l_orderkey""")
def q_team_totals(spark, sf_dir):
    none = F.lit(None).cast("string")
    straight = F.concat_ws("-", F.col("l_quantity").cast("bigint").cast("string"), cents("l_tax").cast("string"))
    turned = F.concat_ws("-", cents("l_tax").cast("string"), F.col("l_quantity").cast("bigint").cast("string"))

    def rubber(score, first, second):
        return F.struct(score.alias("overallScore"), F.array(F.struct(F.lit(first).alias("org")), F.struct(F.lit(second).alias("org"))).alias("competitors"))

    singles = F.when(F.col("l_returnflag") == "R", F.array(rubber(turned, "B", "A"))).otherwise(
        F.array(rubber(straight, "A", "B"), rubber(turned, "B", "A")))
    totals = scores.team_game_totals(singles, F.lit("A"), F.lit("B"))
    return spread_table(spark, sf_dir, "lineitem").select("l_orderkey", totals.alias("t"), none.alias("x")).groupBy("l_orderkey").agg(
        F.sum("t.left").alias("lefts"), F.sum("t.right").alias("rights"))


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'H' || (l_partkey % 4) AS h1, 'A' || (l_suppkey % 4) AS a1, 'H' || (l_linenumber % 4) AS h2,
  'A' || (CAST(l_quantity AS BIGINT) % 4) AS a2, 'H' || (l_orderkey % 5) AS h3, 'A' || (l_partkey % 5) AS a3,
  'H' || (l_partkey % 4) AS h4, 'A' || (CAST(l_quantity AS BIGINT) % 3) AS a4, l_returnflag = 'R' AS turned FROM lineitem),
v AS (SELECT *, h1 <> h2 AND a1 <> a2 AND h3 NOT IN (h1, h2) AND a3 NOT IN (a1, a2) AS valid,
  NOT ((h1 = h1 AND a1 = a2) OR (h2 = h1 AND a2 = a2 AND h2 = h1) OR (h3 = h1 AND a3 = a2) OR (h4 = h1 AND a4 = a2)) AS p1,
  NOT ((h1 = h2 AND a1 = a1) OR (h3 = h2 AND a3 = a1) OR (h4 = h2 AND a4 = a1)) AS p2 FROM n)
SELECT l_orderkey, l_linenumber::BIGINT AS line_no, l_partkey, l_suppkey, CASE WHEN NOT valid THEN 'none' ELSE concat_ws(';',
  CASE WHEN p1 THEN CASE WHEN turned THEN a2 || ':' || h1 ELSE h1 || ':' || a2 END END,
  CASE WHEN p2 THEN CASE WHEN turned THEN a1 || ':' || h2 ELSE h2 || ':' || a1 END END) END AS pending FROM v""")
def q_pending_pairs(spark, sf_dir):
    none = F.lit(None).cast("string")

    def name(prefix, value):
        return F.concat(F.lit(prefix), value.cast("string"))

    def side(n, kind):
        return F.struct(F.lit(kind).alias("type"), none.alias("id"), n.alias("name"),
                        F.array(F.struct(none.alias("id"), n.alias("name"))).alias("players"))

    def rubber(h, a, swap=False):
        sides = [side(name("H", h), "H"), side(name("A", a), "A")]
        return F.struct(F.array(*(reversed(sides) if swap else sides)).alias("competitors"))

    quantity, part = F.col("l_quantity").cast("bigint"), F.col("l_partkey")
    singles = F.array(rubber(part % 4, F.col("l_suppkey") % 4), rubber(F.col("l_linenumber") % 4, quantity % 4, True),
                      rubber(F.col("l_orderkey") % 5, part % 5), rubber(part % 4, quantity % 3))
    left = F.when(F.col("l_returnflag") == "R", "AW").otherwise("HO")
    right = F.when(F.col("l_returnflag") == "R", "HO").otherwise("AW")
    rows = spread_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line_no"), "l_partkey", "l_suppkey", singles.alias("singles"),
        left.alias("lo"), right.alias("ro"))
    sides = rows.withColumns({"left_org": F.col("lo"), "right_org": F.col("ro"), "home_org": F.lit("HO"), "away_org": F.lit("AW"),
                              "left_index": F.lit(0)})
    shown = F.array_join(F.transform("pending", lambda p: F.concat_ws(":", p["left"], p["right"])), ";")
    return report.with_pending(sides).select("l_orderkey", "line_no", "l_partkey", "l_suppkey",
                                             F.coalesce(shown, F.lit("none")).alias("pending"))


@query("""
WITH words AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations),
lines AS (SELECT conv_id, turn, unnest(range(len(ls))) AS rubber_no, ls FROM words),
w AS (SELECT conv_id, turn, rubber_no, string_split(ls[rubber_no + 1], ' ') AS ws FROM lines)
SELECT conv_id, turn, CAST(rubber_no AS BIGINT) AS rubber_no, CAST(n AS BIGINT) AS player_no, ws[n + 1] AS name FROM
  (SELECT *, unnest(range(len(ws))) AS n FROM w)""")
def q_nested_explode(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")

    def side(line):
        return F.struct(F.lit("side").alias("name"), F.lit("org").alias("org"),
                        F.transform(F.split(line, " "), lambda w: F.struct(w.alias("name"))).alias("players"))

    nested = talk.select("conv_id", "turn", F.transform(F.split("text", "\n"), lambda line: F.struct(
        F.lit("0-0").alias("overallScore"), F.array().cast("array<string>").alias("gameScores"), F.lit("").alias("winnerOrg"),
        F.array(side(line)).alias("competitors"))).alias("singles"))
    flat = report.explode_sub_matches(nested, ["conv_id", "turn"])
    return flat.select("conv_id", "turn", F.col("rubber_no").cast("bigint").alias("rubber_no"),
                       F.col("player_no").cast("bigint").alias("player_no"), F.col("player.name").alias("name"))


@query(f"""
WITH {ORDER_MATCHES_SQL}
SELECT seq, CASE WHEN st = 'P' THEN 2 ELSE 0 END::BIGINT AS rubbers, CASE WHEN st = 'P' THEN 4 ELSE 2 END::BIGINT AS sides,
  CASE WHEN st = 'F' THEN 2 ELSE 4 END::BIGINT AS players, CASE WHEN st = 'P' THEN 4 ELSE 2 END::BIGINT AS games FROM m""")
def q_nested_counts(spark, sf_dir):
    return report.nested_counts(order_matches(spark, sf_dir)).select("seq", "rubbers", "sides", "players", "games")


# ---- pages -----------------------------------------------------------------------------

@query("""
WITH t AS (SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS event, page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS ts FROM pages),
u AS (SELECT event, page_id, unnest(range(len(ts))) AS n, ts FROM t)
SELECT event, ts[n + 1] AS token, MIN(page_id) AS page_id, CAST(arg_min(n, (page_id, n)) AS BIGINT) AS place FROM u GROUP BY 1, 2""")
def q_html_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("event"), "page_id", "html")
    links = [F.regexp_extract_all(F.col("html"), F.lit('href="(/[^"]*)"'), 1)]
    return html_pages.harvest(pages, ["event"], "page_id", links).select(
        "event", "token", F.col("position.page_id").alias("page_id"), F.col("position.__at").cast("bigint").alias("place"))


@query("""
WITH s AS (SELECT page_id, '[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+' AS sp, html FROM pages)
SELECT page_id, trim(regexp_replace(CASE WHEN regexp_matches(html, '(?is)<h3>.*?</h3>')
  THEN regexp_replace(regexp_extract(html, '(?is)<h3>(.*?)</h3>', 1), '<[^>]+>', ' ', 'g')
  ELSE regexp_extract(html, '(?is)<title>(.*?)</title>', 1) END, sp, ' ', 'g')) AS title FROM s""")
def q_html_title(spark, sf_dir):
    return html_pages.page_title(table(spark, sf_dir, "pages")).select("page_id", "title")


_STRIP = """trim(regexp_replace(regexp_replace(regexp_replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace({0}, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
  '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g'), 'zzzz', 'zzzz'),
  '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'),
  chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(12288) || chr(65279))"""


@query(f"SELECT page_id, md5({_STRIP.format('html')}) AS hash, length({_STRIP.format('html')}) AS n FROM pages")
def q_strip_html(spark, sf_dir):
    stripped = spread_table(spark, sf_dir, "pages").select("page_id", html.strip_html(F.col("html")).alias("t"))
    return stripped.select("page_id", F.md5("t").alias("hash"), F.length("t").cast("bigint").alias("n"))


@query("""
WITH f AS (SELECT page_id, regexp_extract_all(html, '(?s)<li><a href="[^"]*">.*?</a></li>') AS ts FROM pages),
u AS (SELECT page_id, unnest(range(len(ts))) AS position, ts FROM f)
SELECT page_id, CAST(position AS BIGINT) AS position, regexp_extract(ts[position + 1], 'href="([^"]*)"', 1) AS link,
       regexp_extract(ts[position + 1], '(?s)>([^<]*)</a>', 1) AS label FROM u""")
def q_html_tables(spark, sf_dir):
    parts = html_pages.explode_fragments(table(spark, sf_dir, "pages"), "html", '(?s)<li><a href="[^"]*">.*?</a></li>', ["page_id"])
    return parts.select("page_id", F.col("position").cast("bigint").alias("position"),
                        F.regexp_extract("fragment", 'href="([^"]*)"', 1).alias("link"),
                        F.regexp_extract("fragment", "(?s)>([^<]*)</a>", 1).alias("label"))


@query("""
SELECT doc_id, md5(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(12288) || chr(65279))) AS compact
FROM documents""")
def q_compact_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(names.compact_name(F.col("text"))).alias("compact"))


# ---- labels ----------------------------------------------------------------------------

# text, gender, discipline, canonical category, para category, comparable label
_CATEGORY_CASES = [
    ("Men's Singles", "men", "singles", "Men Singles", None, "men singles"),
    ("WOMENS DOUBLES", "women", "doubles", "Women Doubles", None, "women doubles"),
    ("U19 Girls' Singles", "women", "singles", "U19 Girls Singles", None, "u19 girls singles"),
    ("Mixed Mixed", "mixed", "mixed mixed", "Mixed Doubles", None, "mixed doubles"),
    ("Men's Singles Class 3 - 5", "men", "singles", "Men Singles Class 3-5", "Men Singles Class 3-5", "men singles class 3 5"),
    ("Junior Boys Singles", "men", "singles", "Junior Boys Singles", None, "junior boys singles"),
    ("u 15 mixed Doubles", "mixed", "doubles", "U15 Mixed Doubles", None, "u 15 mixed doubles"),
    ("Mixed Team", "mixed", "teams", "Mixed Teams", None, "mixed team"),
]


def _case(values, number, index):
    whens = " ".join(f"WHEN {i} THEN " + ("NULL" if v[index] is None else "'" + str(v[index]).replace("'", "''") + "'")
                     for i, v in enumerate(values))
    return f"CASE {number} {whens} END"


@query(f"""
SELECT p_partkey, {_case(_CATEGORY_CASES, f'p_partkey % {len(_CATEGORY_CASES)}', 1)} AS gender,
  {_case(_CATEGORY_CASES, f'p_partkey % {len(_CATEGORY_CASES)}', 2)} AS discipline, {_case(_CATEGORY_CASES, f'p_partkey % {len(_CATEGORY_CASES)}', 3)} AS category,
  {_case(_CATEGORY_CASES, f'p_partkey % {len(_CATEGORY_CASES)}', 4)} AS para, {_case(_CATEGORY_CASES, f'p_partkey % {len(_CATEGORY_CASES)}', 5)} AS label,
  'Stage of ' || p_name AS round, p_partkey AS number, trim(p_brand) AS code FROM part""")
def q_normalise_labels(spark, sf_dir):
    picked = F.element_at(F.lit([c[0] for c in _CATEGORY_CASES]), (F.col("p_partkey") % len(_CATEGORY_CASES) + 1).cast("int"))
    rows = spread_table(spark, sf_dir, "part").select(
        "p_partkey", picked.alias("raw"), F.concat(F.lit("X - Stage of "), F.col("p_name"), F.lit(" - Match "), F.col("p_partkey").cast("string")).alias("d"),
        F.concat(F.lit(" "), F.col("p_brand"), F.lit("--")).alias("c"))
    rows = rows.withColumn("t", text.norm_text(F.col("raw")))
    rows = rows.withColumns({"gender": labels.infer_gender(F.col("raw"), F.col("t")), "discipline": labels.norm_discipline(F.col("raw"), F.col("t"))})
    return rows.select("p_partkey", "gender", "discipline",
                       labels.canonical_category(F.col("raw"), F.col("d"), F.col("gender"), F.col("discipline")).alias("category"),
                       labels.para_category(F.col("raw"), F.col("d")).alias("para"), labels.category_label(F.col("raw"), F.col("t")).alias("label"),
                       labels.round_label(F.col("d")).alias("round"), labels.match_number(F.col("d")).alias("number"), text.norm_code(F.col("c")).alias("code"))


# label, key, sort value without a stage number, English label, native label
_ROUND_CASES = [
    ("第２回戦", "knockout_round_2", 2, "Round 2", "2回戦"),
    ("Group 7", "group 7", 7, "Group 7", "グループ7"),
    ("Stage 1B - Group 4", "stage_1b_group", 104, "Stage 1B - Group 4", "Stage1Bグループ4"),
    ("Quarter-Finals", "quarterfinal", 103, "Quarterfinals", "決勝トーナメント準々決勝"),
    ("準決勝", "semifinal", 104, "Semifinals", "決勝トーナメント準決勝"),
    ("Gold Medal Match", "final", 105, "Final", "決勝トーナメント決勝"),
    ("Qualifying Round 3", "qualifying_round_3", 3, "Qualifying Round 3", "予選トーナメント3回戦"),
    ("Preliminary Round", "preliminary_round", 99, "Preliminary Round", "予備ラウンド"),
    ("Round of 64", "round_of_64", 999, "Round of 64", "決勝トーナメント2回戦"),
    ("Bronze Medal Match", "bronze_medal_match", 999, "Bronze Medal Match", "3位決定戦"),
    ("予選リーグ", "qualifying", 999, "予選リーグ", "予選リーグ"),
]
_ROUND_NO = f"o_orderkey % {len(_ROUND_CASES)}"


@query(f"""
SELECT o_orderkey, {_case(_ROUND_CASES, _ROUND_NO, 1)} AS k, CAST({_case(_ROUND_CASES, _ROUND_NO, 2)} AS BIGINT) AS v,
  {_case(_ROUND_CASES, _ROUND_NO, 3)} AS en, {_case(_ROUND_CASES, _ROUND_NO, 4)} AS ja FROM orders""")
def q_round_sort(spark, sf_dir):
    picked = F.element_at(F.lit([c[0] for c in _ROUND_CASES]), (F.col("o_orderkey") % len(_ROUND_CASES) + 1).cast("int"))
    rows = spread_table(spark, sf_dir, "orders").select("o_orderkey", picked.alias("raw"))
    rows = rows.withColumn("k", labels.norm_round(F.col("raw")))
    no = F.lit(None).cast("int")
    return rows.select("o_orderkey", "k", labels.round_sort_value(F.col("k"), F.col("raw"), no).alias("v"),
                       labels.round_en(F.col("k"), F.col("raw")).alias("en"),
                       labels.round_ja(F.col("k"), F.col("raw"), no, F.lit(None).cast("string"), LabelRules()).alias("ja"))


_DAILY_CASES = [("MS.1.R64.001", "Round of 64"), ("MS.1.8FNL.001", "Round of 16"), ("WT.2.GP04.001", "Group 4"), ("XD.3.509-.001", "Pos. 5-9"),
                ("XD.3.FNL-.001", "Finals"), ("XD.3", ""), ("XD.3.ABC.1", "")]


@query(f"SELECT p_partkey, {_case(_DAILY_CASES, f'p_partkey % {len(_DAILY_CASES)}', 1)} AS label FROM part")
def q_daily_round_label(spark, sf_dir):
    picked = F.element_at(F.lit([c[0] for c in _DAILY_CASES]), (F.col("p_partkey") % len(_DAILY_CASES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.daily_round_label(picked).alias("label"))


# ---- reports ---------------------------------------------------------------------------

_SHOWN = f"""
{ORDER_MATCHES_SQL},
ranked AS (SELECT *, CASE WHEN step < 5 THEN DENSE_RANK() OVER (PARTITION BY event, step < 5 ORDER BY step) END AS no FROM m),
side AS (SELECT *, CASE WHEN b > a THEN 1 ELSE 0 END AS l FROM ranked),
games AS (SELECT *, CASE WHEN l = 0 THEN mo ELSE da END AS x, CASE WHEN l = 0 THEN da ELSE mo END AS y,
            CASE WHEN l = 0 THEN da ELSE mo END AS x2, CASE WHEN l = 0 THEN mo ELSE da END AS y2,
            CASE WHEN l = 0 THEN a ELSE b END AS sl, CASE WHEN l = 0 THEN b ELSE a END AS sr FROM side),
txt AS (SELECT *, CASE WHEN x > y THEN '' || y ELSE '-' || x END || ',' || CASE WHEN x2 > y2 THEN '' || y2 ELSE '-' || x2 END AS g,
          CASE WHEN mo > da THEN '' || da ELSE '-' || mo END || ',' || CASE WHEN da > mo THEN '' || mo ELSE '-' || da END AS g0,
          CASE WHEN da > mo THEN '' || mo ELSE '-' || da END || ',' || CASE WHEN mo > da THEN '' || da ELSE '-' || mo END AS g1 FROM games),
placed AS (SELECT *, sl || '(' || g || ')' || sr AS sc, a || '(' || g0 || ')' || b AS s0, b || '(' || g1 || ')' || a AS s1,
             ROW_NUMBER() OVER o AS row_no,
             LAG(CASE WHEN st = 'P' THEN 'tie' || seq ELSE cat || rkey END) OVER o AS before,
             CASE WHEN st = 'P' THEN 'tie' || seq ELSE cat || rkey END AS run
           FROM txt WINDOW o AS (PARTITION BY event ORDER BY cat_no, CASE WHEN step < 5 THEN 100 + no ELSE 3 END, seq)),
runs AS (SELECT *, before IS DISTINCT FROM run AS opens, SUM(CASE WHEN before IS DISTINCT FROM run THEN 1 ELSE 0 END)
           OVER (PARTITION BY event ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block_no FROM placed)"""

_SPREAD = """,
spread AS (SELECT event, block_no, row_no, CASE WHEN opens THEN list_concat(CASE WHEN block_no > 1 THEN [''] ELSE [] END, list_concat([header], body))
           ELSE body END AS ls FROM content),
numbered AS (SELECT event, block_no, row_no, unnest(range(len(ls))) AS line_no, ls FROM spread)
SELECT event, CAST(block_no AS BIGINT) AS block_no, CAST(row_no AS BIGINT) AS row_no, CAST(line_no AS BIGINT) AS line_no, ls[line_no + 1] AS line FROM numbered"""


def _lines(df):
    return df.select("event", *[F.col(c).cast("bigint").alias(c) for c in ("block_no", "row_no", "line_no")], "line")


@query(f"""
WITH {_SHOWN},
content AS (SELECT event, block_no, row_no, opens,
  '▼' || CASE st WHEN 'F' THEN '男子シングルス' WHEN 'O' THEN '女子ダブルス' ELSE '男子団体' END
      || CASE WHEN step < 5 THEN '決勝トーナメント' || no || '回戦' ELSE 'グループ3' END AS header,
  CASE st
    WHEN 'F' THEN [CASE WHEN l = 0 THEN own || '（' || seg || '）　' || sc || '　Rival（ORG）' ELSE 'Rival（ORG）　' || sc || '　' || own || '（' || seg || '）' END]
    WHEN 'O' THEN [CASE WHEN l = 0 THEN own || '／Partner（' || seg || '）' || chr(10) || '　' || sc || chr(10) || '　　Rival／Friend（AAA／BBB）'
                        ELSE 'Rival／Friend（AAA／BBB）' || chr(10) || '　' || sc || chr(10) || '　　' || own || '／Partner（' || seg || '）' END]
    ELSE [
      CASE WHEN l = 0 THEN '　Team ' || seg || '　' || a || '-' || b || '　Rivals' ELSE '　Rivals　' || b || '-' || a || '　Team ' || seg END,
      CASE WHEN a = b THEN '　' || own || '　' || s0 || '　Rival' WHEN l = 0 THEN '○' || own || '　' || s0 || '　Rival' ELSE '○Rival　' || s1 || '　' || own END,
      CASE WHEN l = 0 THEN CASE WHEN a = b THEN '　' || own || '　' || s1 || '　Rival' ELSE '　' || own || '　' || s1 || '　Rival○' END
           ELSE '　Rival　' || s0 || '　' || own || '○' END] END AS body FROM runs){_SPREAD}""")
def q_report_ja(spark, sf_dir):
    return _lines(jobs.match_query(order_matches(spark, sf_dir), filters.MatchArgs(mode="ja")))


@query(f"""
WITH {_SHOWN},
content AS (SELECT event, block_no, row_no, opens,
  '▼' || CASE st WHEN 'F' THEN 'Men''s Singles' WHEN 'O' THEN 'Women''s Doubles' ELSE 'Men''s Teams' END || ' '
      || CASE rlabel WHEN 'Finals' THEN 'Final' ELSE rlabel END AS header,
  CASE st
    WHEN 'F' THEN [CASE WHEN a = b THEN own || ' (' || seg || ') ' || sc || ' Rival (ORG)'
                        WHEN l = 0 THEN own || ' (' || seg || ') d. Rival (ORG) ' || sc ELSE 'Rival (ORG) d. ' || own || ' (' || seg || ') ' || sc END]
    WHEN 'O' THEN [CASE WHEN a = b THEN own || ' / Partner (' || seg || ') ' || sc || ' Rival (AAA) / Friend (BBB)'
                        WHEN l = 0 THEN own || ' / Partner (' || seg || ') d. Rival (AAA) / Friend (BBB) ' || sc
                        ELSE 'Rival (AAA) / Friend (BBB) d. ' || own || ' / Partner (' || seg || ') ' || sc END]
    ELSE [
      CASE WHEN l = 0 THEN '  ' || seg || ' ' || a || '-' || b || ' ORG' ELSE '  ORG ' || b || '-' || a || ' ' || seg END,
      CASE WHEN a = b THEN '  ' || own || ' ' || s0 || ' Rival' WHEN a > b THEN '  ' || own || ' d. Rival ' || s0 ELSE '  Rival d. ' || own || ' ' || s1 END,
      CASE WHEN a = b THEN '  ' || own || ' ' || s1 || ' Rival' WHEN a > b THEN '  Rival d. ' || own || ' ' || s0 ELSE '  ' || own || ' d. Rival ' || s1 END] END AS body FROM runs){_SPREAD}""")
def q_report_en(spark, sf_dir):
    return _lines(jobs.match_query(order_matches(spark, sf_dir), filters.MatchArgs(mode="en")))


@query(f"""
WITH {ORDER_MATCHES_SQL}
SELECT event, ROW_NUMBER() OVER (PARTITION BY event ORDER BY seq) AS row_no, ROW_NUMBER() OVER (PARTITION BY event ORDER BY seq) || '. D' || seq || ' | ' ||
  CASE st WHEN 'F' THEN own || '（' || seg || '） ' || a || '-' || b || ' Rival（ORG）' WHEN 'O' THEN own || '／Partner（' || seg || '） ' || a || '-' || b || ' Rival／Friend（AAA／BBB）'
    ELSE 'Team ' || seg || ' (' || seg || ') ' || a || '-' || b || ' Rivals (ORG)' END AS line FROM m""")
def q_report_list(spark, sf_dir):
    lines = jobs.match_query(order_matches(spark, sf_dir), filters.MatchArgs(mode="list"))
    return lines.select("event", F.col("row_no").cast("bigint").alias("row_no"), "line")


@query(f"""
WITH {ORDER_MATCHES_SQL},
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event ORDER BY seq) AS row_no, mo || '-' || da || ', ' || da || '-' || mo AS g FROM m),
t AS (SELECT event, row_no, list_concat(CASE WHEN row_no > 1 THEN [''] ELSE [] END, CASE WHEN st = 'P' THEN
  ['[' || row_no || '] D' || seq, 'Team ' || seg || ' (' || seg || ') ' || a || '-' || b || ' Rivals (ORG)',
   '1. ' || own || ' (' || seg || ') vs Rival (ORG) | ' || a || '-' || b || ' | ' || g, '2. Rival (ORG) vs ' || own || ' (' || seg || ') | ' || a || '-' || b || ' | ' || g]
  ELSE ['[' || row_no || '] D' || seq, own || ' (' || seg || ') ' || a || '-' || b || CASE st WHEN 'F' THEN ' Rival (ORG)' ELSE ' Rival (AAA)' END, 'games: ' || g] END) AS ls FROM n),
u AS (SELECT event, row_no, unnest(range(len(ls))) AS line_no, ls FROM t)
SELECT event, row_no, CAST(line_no AS BIGINT) AS line_no, ls[line_no + 1] AS line FROM u""")
def q_report_text(spark, sf_dir):
    lines = jobs.match_query(order_matches(spark, sf_dir), filters.MatchArgs(mode="text"))
    return lines.select("event", *[F.col(c).cast("bigint").alias(c) for c in ("row_no", "line_no")], "line")


@query(f"""
WITH {ORDER_MATCHES_SQL},
k AS (SELECT *, DENSE_RANK() OVER (PARTITION BY event ORDER BY step) AS nth FROM m WHERE st = 'F' AND step < 5),
f AS (SELECT event, seq, own, seg, a, b FROM k WHERE nth = 2 AND contains(seq || rlabel || rkey || own || seg, '1'))
SELECT event, ROW_NUMBER() OVER (PARTITION BY event ORDER BY seq) AS row_no,
  ROW_NUMBER() OVER (PARTITION BY event ORDER BY seq) || '. D' || seq || ' | ' || own || '（' || seg || '） ' || a || '-' || b || ' Rival（ORG）' AS line
FROM f QUALIFY row_no <= 5""")
def q_match_query_filtered(spark, sf_dir):
    args = filters.MatchArgs(category="men singles", rounds=("第2回戦",), contains="1", limit=5, mode="list")
    lines = jobs.match_query(order_matches(spark, sf_dir), args)
    return lines.select("event", F.col("row_no").cast("bigint").alias("row_no"), "line")


@query(f"""
WITH {ORDER_MATCHES_SQL},
s AS (SELECT event, 'summary' AS facet, CAST(COUNT(*) AS VARCHAR) AS value, CAST(COUNT(*) FILTER (st = 'F') AS VARCHAR) AS label, CAST(0 AS BIGINT) AS first_seq FROM m GROUP BY 1),
r AS (SELECT event, 'rounds', rlabel, rlabel, MIN(seq) FROM m GROUP BY event, rlabel),
c AS (SELECT event, 'categories', cat, '男子シングルス', MIN(seq) FROM m WHERE st = 'F' GROUP BY event, cat),
o AS (SELECT event, rlabel, step, MIN(seq) AS fs FROM m WHERE st = 'F' GROUP BY 1, 2, 3),
ol AS (SELECT event, 'round_options', rlabel, CASE WHEN step = 5 THEN 'グループ3' ELSE '決勝トーナメント' || DENSE_RANK() OVER (PARTITION BY event, step < 5 ORDER BY step) || '回戦' END, fs FROM o)
SELECT * FROM s UNION ALL SELECT * FROM r UNION ALL SELECT * FROM c UNION ALL SELECT * FROM ol""")
def q_query_facets(spark, sf_dir):
    found = jobs.match_facets(order_matches(spark, sf_dir), filters.MatchArgs(category="Men Singles", gender="men", discipline="singles"))
    parts = [
        found["summary"].select("event", F.lit("summary").alias("facet"), F.col("fetched").cast("string").alias("value"),
                                F.col("returned").cast("string").alias("label"), F.lit(0).cast("bigint").alias("first_seq")),
        found["rounds"].select("event", F.lit("rounds").alias("facet"), F.col("round").alias("value"), F.col("round").alias("label"), "first_seq"),
        found["categories"].select("event", F.lit("categories").alias("facet"), "value", "label", "first_seq"),
        found["round_options"].select("event", F.lit("round_options").alias("facet"), "value", "label", "first_seq")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_brand":"' || p_brand || '","size":' || p_size || ',"none":null}' AS line FROM part""")
def q_json_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").alias("size"), F.lit(None).cast("string").alias("none"))
    return part.select("p_partkey", report.to_json_rows(part, ["p_partkey", "p_name", "p_brand", "size", "none"]))
