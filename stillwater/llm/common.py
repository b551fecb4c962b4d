"""What the operators of this subpackage share: folders, text columns, folds, joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named and all runs in one process (tests), a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        at = tempfile.mkdtemp(prefix="stillwater-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id is in fold 0, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, lengthened until df has none of them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(left: DataFrame, right: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of many rows with one row a key. hot: the keys that hold a thousandth of left's rows or more, so a
    thousand keys at most: these meet by broadcast, and no task gets such a group whole; all others by shuffle."""
    hot = hot.select(*on).withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(hot), on, "left")
    few = right.join(F.broadcast(hot.drop("_hot")), on, "left_semi")
    return marked.where("_hot IS NULL").drop("_hot").join(right, on).unionByName(marked.where("_hot").drop("_hot").join(F.broadcast(few), on))


def kept_rows(docs: DataFrame, keys: DataFrame, sig: Column, more: list[str]) -> DataFrame:
    """One row of docs for each (doc_id, sig) of keys, with the columns `more` of keys; null ids meet null.

    keys has `times`, the number of rows of a key: repeated rows are told apart by nothing, so one of them stays, and they
    alone are grouped.
    """
    i, s, t = spare(docs, "_id", "_sig", "_times")
    keys = keys.select(F.col("doc_id").alias(i), F.col("sig").alias(s), F.col("times").alias(t), *more)
    kept = docs.join(keys, docs["doc_id"].eqNullSafe(keys[i]) & (sig == keys[s]))
    columns = [*docs.columns, *more]
    return kept.where(F.col(t) == 1).select(*columns).unionByName(kept.where(F.col(t) > 1).dropDuplicates([i, s]).select(*columns))


def stay(docs: DataFrame, keys: DataFrame, sig: Column) -> DataFrame:
    """One row of docs for each (doc_id, sig, times) of keys."""
    return kept_rows(docs, keys, sig, [])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place from 0: rows are dealt by ranges of the order, counted in each range, and the ranges'
    counts (one number a task) are added up."""
    (part,) = spare(df, "_range")
    ranged = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = sorted((r[part], r["count"]) for r in ranged.groupBy(part).count().collect())
    before = [(p, sum(n for _, n in counts[:k])) for k, (p, _) in enumerate(counts)]
    ahead = df.sparkSession.createDataFrame(before, f"{part} int, {name} long")
    at = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    ranged = ranged.withColumn("_at", at).join(F.broadcast(ahead), part)
    return ranged.withColumn(name, F.col(name) + F.col("_at")).drop(part, "_at")


def tree_sum(rows: DataFrame, key: str, add, schema: str, fan: int = 64) -> DataFrame:
    """Partial sums of a key, numbered by `part`, added `fan` at a time until each key has one row."""
    most = rows.agg(F.max("part")).first()[0] or 0
    while True:
        most //= fan
        rows = rows.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy(key, "part").applyInArrow(add, schema)
        if not most:
            return rows
