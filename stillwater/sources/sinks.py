"""Publishing tables so that a reader never sees a part of one: the data first, then a marker that names it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def publish(df: DataFrame, path: str, replace: bool = False) -> bool:
    """Writes df below `path` and then the marker that points at it; keeps a published table unless told to replace it.

    The new marker takes the old one's place in one step, so there is no moment without one.
    """
    spark = df.sparkSession
    if not replace and exists(spark, f"{path}/READY"):
        return False
    part = uuid.uuid4().hex
    df.write.parquet(f"{path}/{part}")
    fs, fresh = filesystem(spark, f"{path}/READY.{part}")
    out = fs.create(fresh)
    out.write(bytearray(json.dumps({"data": part, "columns": sorted(df.columns)}, sort_keys=True).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/READY"), how)
    return True


def published(spark: SparkSession, path: str) -> DataFrame:
    """The table that the marker names; without a marker there is none."""
    if not exists(spark, f"{path}/READY"):
        raise FileNotFoundError(f"{path} has no READY marker")
    return spark.read.parquet(f"{path}/{json.loads(spark.read.text(f'{path}/READY').first().value)['data']}")


def records(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys, in order of the id through the part files: read in order of their names, the same rows give the same bytes."""
    df.select("id", F.to_json(F.struct(*sorted(df.columns))).alias("value")).orderBy("id").select("value").write.mode("overwrite").text(path)
