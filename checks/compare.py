"""Runs bound queries next to their SQL on DuckDB: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from checks import ORACLES, QUERIES
from courtside.session import tune

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("checks").config("spark.sql.shuffle.partitions", cores)
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return f"rows-only {len(got)}"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t) != types[c]]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        only_a, only_b = set(map(repr, a)) - set(map(repr, b)), set(map(repr, b)) - set(map(repr, a))
        return (f"DIFFER {len(a)} vs {len(b)} columns {sorted(names)}\n   spark {sorted(only_a)[:3]}\n   duck  {sorted(only_b)[:3]}"
                f"\n   at {i}")
    return f"ok {len(a)}" + (f"  TYPES {odd}" if odd else "")


def main(argv: list[str]) -> int:
    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark, con, bad = session(), duck(argv[0]), 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as e:
            lines = str(e).splitlines()
            result = "ERROR " + type(e).__name__ + " " + " | ".join(lines[:6])[:900]
            if len(names) == 1:
                traceback.print_exc()
        bad += not result.startswith(("ok", "rows-only"))
        print(f"{name:24s} {time.time() - start:6.2f}s {result}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
