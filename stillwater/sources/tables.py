"""The library's canonical views over the given tables.

A document stands for a still, its source for a work; five works make a season, two
seasons a franchise. Labels stand for review marks. Vectors, events and orders stand
for embeddings, jobs and timelines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = r"[^a-z ]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_band(n: Column) -> Column:
    return F.when(n < 500, "short").when(n < 2000, "middle").otherwise("long")


def tags_of(text: Column) -> Column:
    """Distinct words of four letters or more."""
    words = F.split(F.regexp_replace(F.lower(text), WORDS, " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4))


def stills(spark: SparkSession, sf_dir: str, tags: bool = False) -> DataFrame:
    """id, work, season, franchise, ts, selected, excluded, locked, review_state, facets, facets_human; tags if asked for (they read the texts)."""
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    number = F.substring("source", 4, 9).cast("int")
    none = F.lit(None).cast("string")
    human = F.when(F.col("toxic") == 1, F.create_map(F.lit("lang"), none)).when(F.col("quality") == 0, F.create_map(F.lit("grade"), F.lit("poor")))
    out = d.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("work"),
        (number % 5).alias("season"),
        (number % 5 % 2).alias("franchise"),
        F.col("doc_id").cast("double").alias("ts"),
        (F.col("doc_id") % 10 != 0).alias("selected"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("excluded"),
        (F.col("doc_id") % 17 == 0).alias("locked"),
        F.when(F.col("quality") == 1, "kept").when(F.col("quality") == 0, "culled").otherwise("unreviewed").alias("review_state"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("size"), size_band(F.col("n_chars"))).alias("facets"),
        human.alias("facets_human"),
        *([tags_of(F.col("text")).alias("tags")] if tags else []),
    )
    return out


def swatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, work, lane, rank, hex, weight: three swatches, a shadow and a highlight of each still, cut from a digest of its id."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("work"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("m"))
    lanes = [("swatches", 0, 1), ("swatches", 1, 7), ("swatches", 2, 13), ("shadows", 0, 19), ("highlights", 0, 25)]
    each = F.array(*[F.struct(F.lit(lane).alias("lane"), F.lit(k).alias("rank"), F.concat(F.lit("#"), F.upper(F.substring("m", at, 6))).alias("hex"), F.lit(1.0 / (1 + k)).alias("weight")) for lane, k, at in lanes])
    return d.select("id", "work", F.inline(each))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, work, series, ts, v: a label is a work, all of one series; vec_id is its time."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("work"), F.lit(0).alias("series"), F.col("vec_id").cast("double").alias("ts"), F.col("embedding").alias("v"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, stage, worker, seconds, units, ts of each event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.col("user_id").alias("worker"), F.col("value").alias("seconds"), F.get_json_object("props", "$.k").cast("long").alias("units"), "ts")


#: The same views for the other engine: (name, body) of common table expressions.
SQL_VIEWS = {
    "still": """SELECT d.doc_id AS id, d.source AS work, CAST(substr(d.source, 4) AS INTEGER) % 5 AS season, CAST(substr(d.source, 4) AS INTEGER) % 5 % 2 AS franchise,
  CAST(d.doc_id AS DOUBLE) AS ts, d.doc_id % 10 <> 0 AS selected, coalesce(l.toxic = 1, FALSE) AS excluded, d.doc_id % 17 = 0 AS locked,
  CASE WHEN l.quality = 1 THEN 'kept' WHEN l.quality = 0 THEN 'culled' ELSE 'unreviewed' END AS review_state,
  d.lang AS lang, CASE WHEN d.n_chars < 500 THEN 'short' WHEN d.n_chars < 2000 THEN 'middle' ELSE 'long' END AS size, l.quality AS quality, l.toxic AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "seen": "SELECT * FROM still WHERE selected AND review_state <> 'culled' AND NOT excluded",
    "facet": """SELECT id, 'lang' AS k, lang AS v FROM still WHERE NOT coalesce(toxic = 1, FALSE)
  UNION ALL SELECT id, 'size', size FROM still UNION ALL SELECT id, 'grade', 'poor' FROM still WHERE coalesce(toxic, 0) <> 1 AND quality = 0""",
    "tag": r"""SELECT DISTINCT doc_id AS id, t FROM (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' ')) AS t FROM documents) WHERE length(t) >= 4""",
    "digest": "SELECT doc_id AS id, source AS work, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents",
    "swatch": """SELECT id, work, lane, rank, '#' || upper(substr(m, pos, 6)) AS hex, weight FROM digest,
  (VALUES ('swatches', 0, 1, 1e0), ('swatches', 1, 7, 0.5e0), ('swatches', 2, 13, 1e0 / 3e0), ('shadows', 0, 19, 1e0), ('highlights', 0, 25, 1e0)) AS x(lane, rank, pos, weight)""",
    "vec": "SELECT vec_id AS id, label AS work, CAST(vec_id AS DOUBLE) AS ts, embedding AS v FROM embeddings",
    "job": "SELECT event_id AS id, event_type AS stage, user_id AS worker, value AS seconds, CAST(json_extract_string(props, '$.k') AS BIGINT) AS units, ts FROM events",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names) + "\n"
