"""Driver tables as inputs of the operators."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_ROWS = 200_000  # of a spread table
LADDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table for queries that compute much per row, dealt out to all cores whatever its files. More rows make more
    tasks, not longer ones; their number is read from the files' footers."""
    rows = table(spark, sf_dir, name)
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return (rows.select(*columns) if columns else rows).repartition(parts)


def cents(c) -> F.Column:
    return F.round(F.col(c) * 100).cast("bigint")


def day(c):
    return F.date_format(F.col(c), "yyyy-MM-dd")


def nation_orders(spark, sf_dir, *columns, light=True) -> DataFrame:
    """orders with the nation of their customer as ``event``."""
    orders = table(spark, sf_dir, "orders") if light else spread_table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("bigint").alias("event"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select("event", *columns)


def order_matches(spark, sf_dir) -> DataFrame:
    """Match rows made of every order: singles, doubles and team ties of the customer's nation."""
    from courtside import schema

    rows = nation_orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate",
                         "c_name", light=False).join(table(spark, sf_dir, "customer").select(
                             F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg")), "o_custkey")
    status, step = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    month, dom = (F.date_format("o_orderdate", f) for f in ("M", "d"))
    score = F.concat_ws("-", (F.col("o_custkey") % 4).cast("string"), (F.col("o_orderkey") % 4).cast("string"))
    games = F.array(F.concat_ws("-", month, dom), F.concat_ws("-", dom, month))
    none = F.lit(None).cast("string")

    def player(name, org, position):
        return F.struct(none.alias("id"), name.alias("name"), org.alias("org"), none.alias("orgCode"),
                        F.lit(position).alias("position"))

    def side(name, org, players):
        return F.struct(none.alias("type"), none.alias("id"), name.alias("name"), org.alias("org"), none.alias("orgCode"),
                        none.alias("irm"), players.alias("players"))

    def lit(x):
        return F.lit(x)

    own, rival = F.col("c_name"), lit("Rival")
    single = F.array(side(own, F.col("seg"), F.array(player(own, F.col("seg"), 1))),
                     side(rival, lit("ORG"), F.array(player(rival, lit("ORG"), 1))))
    double = F.array(
        side(own, F.col("seg"), F.array(player(own, F.col("seg"), 1), player(lit("Partner"), F.col("seg"), 2))),
        side(rival, lit("AAA"), F.array(player(rival, lit("AAA"), 1), player(lit("Friend"), lit("BBB"), 2))))

    def rubber(order, sides):
        return F.struct(F.lit(order).alias("order"), none.alias("documentCode"), none.alias("description"),
                        score.alias("overallScore"), none.alias("resultStatus"), games.alias("gameScores"),
                        sides.alias("competitors"), none.alias("winnerOrg"))

    teams = F.array(*[F.struct(n.alias("name"), o.alias("org"), none.alias("orgCode"))
                      for n, o in ((F.concat(lit("Team "), F.col("seg")), F.col("seg")), (lit("Rivals"), lit("ORG")))])
    kinds = {"F": ("Men Singles", "men", "singles"), "O": ("Women Doubles", "women", "doubles"), "P": ("Men Teams", "men", "teams")}
    rounds = {"1": ("round_of_16", "Round of 16"), "2": ("quarterfinal", "Quarterfinals"), "3": ("semifinal", "Semifinals"),
              "4": ("final", "Finals"), "5": ("group 3", "Group 3")}

    def pick(values, key, i):
        from courtside.functions.text import look_up
        return look_up({k: v[i] for k, v in values.items()}, key)

    empty = {c: F.array().cast(t) for c, t in schema.MATCH_FIELDS.items() if t.startswith("array")}
    computed = {
        "matchType": F.when(status == "P", "team").otherwise("individual"), "id": none, "eventId": F.col("event").cast("string"),
        "documentCode": F.concat(lit("M"), F.col("o_orderkey").cast("string")), "source": none, "subEventType": none,
        "categoryName": pick(kinds, status, 0), "discipline": pick(kinds, status, 2), "gender": pick(kinds, status, 1),
        "roundLabel": pick(rounds, step, 1), "roundKey": pick(rounds, step, 0), "matchNumber": F.col("o_orderkey"),
        "description": F.concat(lit("D"), F.col("o_orderkey").cast("string")), "venue": none, "table": none,
        "startDateLocal": none, "startDateUtc": none, "searchDateTokens": empty["searchDateTokens"], "overallScore": score,
        "resultStatus": none, "isParaClass": F.lit(False),
        "teams": F.when(status == "P", teams).otherwise(empty["teams"]),
        "competitors": F.when(status == "F", single).when(status == "O", double).otherwise(empty["competitors"]),
        "gameScores": F.when(status == "P", empty["gameScores"]).otherwise(games),
        "singles": F.when(status == "P", F.array(rubber(1, single), rubber(2, F.reverse(single)))).otherwise(empty["singles"]),
    }
    return rows.select(F.col("event").cast("string").alias("event"), F.col("o_orderkey").alias("seq"),
                       *[computed[c].cast(t).alias(c) for c, t in schema.MATCH_FIELDS.items()])


# The same match rows for the SQL side: sides, games and labels as plain columns.
ORDER_MATCHES_SQL = """
m AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS event, o_orderkey AS seq, o_orderstatus AS st, c_name AS own, c_mktsegment AS seg,
         o_custkey % 4 AS a, o_orderkey % 4 AS b, month(o_orderdate) AS mo, day(o_orderdate) AS da,
         CASE o_orderstatus WHEN 'F' THEN 'Men Singles' WHEN 'O' THEN 'Women Doubles' ELSE 'Men Teams' END AS cat,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS cat_no,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'round_of_16' WHEN '2' THEN 'quarterfinal' WHEN '3' THEN 'semifinal'
              WHEN '4' THEN 'final' ELSE 'group 3' END AS rkey,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'Round of 16' WHEN '2' THEN 'Quarterfinals' WHEN '3' THEN 'Semifinals'
              WHEN '4' THEN 'Finals' ELSE 'Group 3' END AS rlabel,
         CAST(left(o_orderpriority, 1) AS INTEGER) AS step
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def new_folder(spark, name: str) -> str:
    """A folder for files that a query writes: in the cluster's shared folder; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='courtside-')}"
    return f"{root.rstrip('/')}/checks/{name}-{uuid.uuid4().hex}"
