"""Record files: manifests, tag vocabularies, listings. A missing optional file is an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bundle_id string, candidates array<struct<candidate_id: string, shot_id: string, artifact_name: string, sha256: string, bytes: long, intended_pts: long, observed_pts: long, time_base: string, width: int, height: int>>"
PROPOSALS = "run_ref string, proposals array<struct<candidate_id: string, provenance: struct<shot_scale_lane: string, fields: map<string, struct<source: string, score: double>>>, proposal: struct<scores: array<struct<family: string, label: string, score: double>>>>>"


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """bundle_id and each candidate's columns, with ts from its pts and time base."""
    rows = optional_json(spark, path, MANIFEST).select("bundle_id", F.inline("candidates"))
    num, den = (F.split("time_base", "/")[k].cast("double") for k in (0, 1))
    return rows.withColumn("ts", F.col("intended_pts") * num / den)


def proposals(spark: SparkSession, path: str) -> DataFrame:
    """work, id, family, label, score of every proposal."""
    rows = optional_json(spark, path, PROPOSALS).select(F.regexp_replace("run_ref", "^run-", "").alias("work"), F.inline("proposals"))
    return rows.select("work", F.col("candidate_id").alias("id"), F.inline("proposal.scores"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """tag_id, name, category of a tag list."""
    return spark.read.csv(path, header=True, schema="tag_id long, name string, category int, count long")


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".mkv", ".mp4", ".avi"), most: int = 2000) -> DataFrame:
    """name, length, left_out, others of a folder's files of given kinds, by name: the first `most`, how many more there
    are, and how many files of other kinds."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length")
    kind = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(*suffixes)
    n = files.agg(F.greatest(F.lit(0), F.count_if(kind) - most).cast("long").alias("left_out"), F.count_if(~kind).alias("others"))
    return files.where(kind).orderBy("name").limit(most).join(F.broadcast(n)).orderBy("name")  # one row


def newest_version(folders: DataFrame) -> DataFrame:
    """The folder of the highest x.y.z of each group. Rows: grp, name."""
    part = F.transform(F.split(F.regexp_extract("name", r"(\d+\.\d+\.\d+)", 1), r"\."), lambda x: x.cast("int"))
    return folders.where(F.col("name").rlike(r"\d+\.\d+\.\d+")).groupBy("grp").agg(F.max_by("name", part).alias("name"))

CHECKS = "format string, checks array<struct<id: string, work: string, candidate: string, machine: map<string,string>, human: map<string,string>, sources: map<string, struct<s: string, p: double>>>>"


def label_checks(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """id, work, family, machine, human, answered, source of exported label checks of one format."""
    rows = spark.read.schema(CHECKS).json(path, multiLine=True)
    rows = rows.select(F.assert_true(F.col("format") == wanted, F.lit("another format of label checks")).alias("ok"), F.inline("checks"))
    families = F.array_union(F.map_keys(F.coalesce("machine", F.create_map().cast("map<string,string>"))), F.map_keys(F.coalesce("human", F.create_map().cast("map<string,string>"))))
    each = rows.where(F.col("ok").isNull()).select("id", "work", "machine", "human", "sources", F.explode(families).alias("family"))
    at = lambda c: F.try_element_at(F.col(c), F.col("family"))
    return each.select("id", "work", "family", at("machine").alias("machine"), at("human").alias("human"), F.coalesce(F.map_contains_key("human", F.col("family")), F.lit(False)).alias("answered"), at("sources")["s"].alias("source"))


def audit(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an audit file, which is an array or an object with one array in it."""
    row = "array<struct<candidate_id: string, shot_id: string, timestamp_seconds: double, pixel: boolean>>"
    text = spark.read.text(path, wholetext=True)
    plain = F.when(F.ltrim("value").startswith("["), F.from_json("value", row)).otherwise(F.map_values(F.from_json("value", f"map<string, {row}>"))[0])
    return text.select(F.inline(plain))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """candidate_id, embedding: the first file of each candidate by path."""
    rows = spark.read.schema("candidate_id string, embedding array<float>").json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.groupBy("candidate_id").agg(F.min_by("embedding", "path").alias("embedding"))
