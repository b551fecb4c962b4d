"""Tables kept between rounds, and sides small enough to broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table of this run in the folder that the cluster names; a local one only where all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        at = tempfile.mkdtemp(prefix="stillwater-")
    return f"{at}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the folder that the cluster names: it cuts lineage and survives lost executors. (A
    checkpoint would compute df twice, once to count it.)"""
    at = scratch(df.sparkSession, "kept")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be broadcast while it has at most `most` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
