import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from courtside.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield tune(session)
    session.stop()


@pytest.fixture
def column(spark):
    """column(fn, values...) -> results of a Column function over rows of string arguments."""
    def run(fn, rows, ddl=None):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        ddl = ddl or ", ".join(f"c{i} string" for i in range(len(rows[0])))
        from pyspark.sql import functions as F

        data = [(i, *r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, f"i int, {ddl}")
        out = df.select("i", fn(*[F.col(c) for c in df.columns[1:]]).alias("out"))
        return [r["out"] for r in sorted(out.collect(), key=lambda r: r["i"])]

    return run
