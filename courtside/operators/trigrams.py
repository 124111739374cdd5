"""An inverted index of trigrams for "contains" searches (F6, E20, E32): a needle reads the postings of its own trigrams.

Rows are dealt to blocks by a hash of their key. A block is an index of its own, two partitions on disk: its texts, and
for each trigram the sorted keys that hold it, in order of the trigrams so that a reader skips the rest of the file. A
search intersects the lists of each block, reads the texts of the blocks that are left and tests them exactly; an upsert
rewrites the blocks of its keys and no other.

Contract. A null text is an empty one. Null keys are a key like any other. A key may be repeated: each of its rows is
tested, and an upsert replaces all of them. Needles below three characters have no trigram: the stored texts are scanned.
An empty table finds nothing. One writer at a time; an upsert that was cut short is repaired by running it again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = r"(?s)(?=(...))"  # every three characters in a row, overlaps included


def trigrams(needles: Sequence[str]) -> list[str]:
    return sorted({n[i:i + 3] for n in needles for i in range(len(n) - 2)})


@dataclass(frozen=True)
class TrigramIndex:
    """An index in ``folder``. ``blocks`` stays as it was written; some 100,000 rows a block keep lists short."""

    folder: str
    blocks: int = 64
    key_type: str = "string"

    def _rows(self, rows: DataFrame, key: Column, text: Column) -> DataFrame:
        rows = rows.select(key.cast(self.key_type).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
        return rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(self.blocks)).cast("int"))

    def texts(self, spark: SparkSession) -> DataFrame:
        """(key, text, block) of all rows."""
        return spark.read.schema(f"key {self.key_type}, text string, block int").parquet(f"{self.folder}/texts")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"gram string, keys array<{self.key_type}>, block int").parquet(f"{self.folder}/postings")

    def _save(self, df: DataFrame, name: str, order: Sequence[str]) -> None:
        # Rebalancing keeps a block together unless it is too large for one task, then splits it.
        (df.hint("rebalance", "block").sortWithinPartitions("block", *order).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{self.folder}/{name}"))

    def _save_postings(self, texts: DataFrame) -> None:
        found = texts.select("block", "key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(GRAM), 1))).alias("gram"))
        # Null keys travel in a struct, which a set keeps.
        keys = F.sort_array(F.collect_set(F.struct("key")))["key"]
        self._save(found.groupBy("block", "gram").agg(keys.alias("keys")), "postings", ["gram"])

    def write(self, rows: DataFrame, key: Column, text: Column) -> TrigramIndex:
        """Indexes ``rows`` in a folder that holds no index yet."""
        self._save(self._rows(rows, key, text), "texts", ["key"])
        self._save_postings(self.texts(rows.sparkSession))
        return self

    def upsert(self, rows: DataFrame, key: Column, text: Column) -> None:
        """Replaces the rows of the keys of ``rows``."""
        spark, new = rows.sparkSession, self._rows(rows, key, text)
        touched = F.col("block").isin([r["block"] for r in new.select("block").distinct().collect()])
        old = self.texts(spark).filter(touched)
        kept = self._of_keys(old, new.select("key", "block").distinct(), "left_anti")
        self._save(kept.unionByName(new), "texts", ["key"])
        self._save_postings(self.texts(spark).filter(touched))

    @staticmethod
    def _of_keys(texts: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("key").alias("__key"), F.col("block").alias("__block"))
        return texts.join(keys, (F.col("block") == F.col("__block")) & F.col("key").eqNullSafe(F.col("__key")), how)

    def find(self, spark: SparkSession, needles: Sequence[str], condition: Column | None = None) -> DataFrame:
        """(key, text) of the rows whose text holds all ``needles`` and meets ``condition`` on ``text`` and ``key``. A
        condition that asks for more than the needles may leave any of them out."""
        exact = F.lit(True) if condition is None else condition
        for needle in needles:
            exact = exact & F.contains("text", F.lit(needle))
        grams, texts = trigrams(needles), self.texts(spark)
        if grams:
            lists = (self.postings(spark).filter(F.col("gram").isin(grams)).groupBy("block").agg(F.collect_list("keys").alias("lists"))
                     .filter(F.size("lists") == len(grams)))
            common = F.aggregate("lists", F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
            texts = self._of_keys(texts, lists.select("block", F.explode(common).alias("key")), "left_semi")
        return texts.filter(exact).select("key", "text")
