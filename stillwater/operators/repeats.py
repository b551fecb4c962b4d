"""Repeated frames kept up to date: a table of pairs by series, of which only series with changed content are matched again.

The table lies in one folder, a partition a series. A partition holds its pairs and one row of its content key, so both are
replaced together in one step; a series whose key is the stored one is neither matched nor rewritten. A series that is gone keeps
a partition with an empty key and no pairs. Works are matched within their series only.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.operators.keep import few, kept
from stillwater.operators.similar import pairs

PAIR = "wa int, a long, ta double, wb int, b long, tb double, similarity double"
KEPT = f"key string, {PAIR}, series int"


def content_keys(frames: DataFrame) -> DataFrame:
    """series, key: changes with any frame of the series, not with their order. frames: series, id, work, ts, v."""
    h = F.xxhash64("id", "work", "ts", "v")
    sums = frames.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    return sums.select("series", F.concat_ws(":", *[F.col(c).cast("string") for c in "nsx"]).alias("key"))


def stored(spark: SparkSession, at: str) -> DataFrame:
    """The table's rows; none where it hasn't been written yet."""
    try:
        return spark.read.schema(KEPT).option("basePath", at).parquet(at)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KEPT)


def due(frames: DataFrame, at: str) -> DataFrame:
    """series, key of series to be matched (again): new, changed, or gone (key null)."""
    old = stored(frames.sparkSession, at).where("wa IS NULL").select("series", F.col("key").alias("old"))
    both = content_keys(frames).join(old, "series", "full")
    return both.where(~F.col("key").eqNullSafe(F.col("old"))).select("series", "key")


def refresh(frames: DataFrame, at: str, least: float = 0.95) -> DataFrame:
    """Brings the table at `at` up to date and gives its pairs. frames: series int, id, work, ts, v."""
    spark = frames.sparkSession
    stale = kept(due(frames, at))
    if not stale.isEmpty():
        found = pairs(frames.join(stale.where("key IS NOT NULL").select("series"), "series", "left_semi"), least)
        rows = found.join(few(stale), "series").select("key", *[c.split()[0] for c in PAIR.split(", ")], "series")
        none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in PAIR.split(", ")]
        marks = stale.select("key", *none, "series")
        # each task writes the pairs of its own blocks, so a series is as many files as tasks and is never gathered in one
        rows.unionByName(marks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series").parquet(at)
    return stored(spark, at).where("wa IS NOT NULL").drop("key")
