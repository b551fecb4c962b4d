"""Imports: records merged into tables, bundles verified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIPELINE = ("work", "ts", "facets", "selected")
REVIEW = ("review_state", "locked", "excluded", "facets_human")


def untouched():
    return (F.col("t.review_state") == "unreviewed") & ~F.col("t.locked") & ~F.col("t.excluded") & F.col("t.facets_human").isNull()


def merge(target: DataFrame, source: DataFrame) -> DataFrame:
    """target after a run's rows (id and PIPELINE columns) are imported.

    Pipeline columns follow the run and review columns stay. Rows of the run's works that it no
    longer has go when nobody touched them, else stay without being selected. Other works' rows
    stay as they are. Importing twice gives what importing once gives.
    """
    works = source.select("work").distinct().withColumn("_run", F.lit(True))
    s = source.select("id", *PIPELINE).withColumn("_new", F.lit(True)).alias("s")
    t = target.withColumn("_old", F.lit(True)).alias("t")
    both = t.join(s, F.col("t.id") == F.col("s.id"), "full").select("t.*", *[F.col(f"s.{c}").alias(f"s_{c}") for c in ("id", *PIPELINE)], "_new")
    both = both.join(works.select(F.col("work").alias("_w"), "_run"), F.col("work") == F.col("_w"), "left").alias("t")
    gone = F.col("_new").isNull() & F.coalesce("_run", F.lit(False))
    both = both.where(~(gone & F.coalesce(untouched(), F.lit(False))))
    new = F.col("_new").isNotNull()
    cols = {c: F.when(new, F.col(f"s_{c}")).otherwise(F.when(gone, F.lit(False)).otherwise(F.col(c)) if c == "selected" else F.col(c)) for c in PIPELINE}
    defaults = {"review_state": F.lit("unreviewed"), "locked": F.lit(False), "excluded": F.lit(False)}
    cols |= {c: F.coalesce(F.col(c), defaults[c]) if c in defaults else F.col(c) for c in REVIEW}
    return both.select(F.coalesce("id", "s_id").alias("id"), *[v.alias(k) for k, v in cols.items()])


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """id, problem: what a bundle's files and its manifest disagree on. files: id, content; manifest: id, sha256, bytes."""
    f = files.select("id", F.sha2("content", 256).alias("have"), F.octet_length("content").cast("long").alias("size"), F.lit(True).alias("there"))
    m = manifest.groupBy("id").agg(F.first("sha256").alias("sha256"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("k"))
    both = m.join(f, "id", "full")
    problem = F.when(F.col("k").isNull(), "not listed").when(F.col("there").isNull(), "missing").when(F.col("k") > 1, "listed twice").when(F.col("size") != F.col("bytes"), "size").when(F.col("have") != F.col("sha256"), "digest")
    return both.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def first_source(*tables: DataFrame) -> DataFrame:
    """Union of tables by id where an earlier table's row wins; adds `rank`, the table's place."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("rank", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    cols = [c for c in out.columns if c != "id"]
    return out.groupBy("id").agg(F.min_by(F.struct(*cols), "rank").alias("r")).select("id", "r.*")


def upsert(target: DataFrame, source: DataFrame, key: str, taken: tuple[str, ...], cleared: tuple[str, ...] = (), defaults: dict | None = None) -> DataFrame:
    """target with source's rows: known keys take the columns `taken`, nulls too, and lose the `cleared` ones; other columns
    stay. New keys get `defaults` where source says nothing. One row a key on both sides."""
    s = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in taken], F.lit(True).alias("_new"))
    both = target.withColumn("_old", F.lit(True)).join(s, target[key] == s["_k"], "full")
    new, old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    cols = []
    for c in target.columns:
        v = F.coalesce(key, "_k") if c == key else F.when(new, F.col(f"_{c}")).otherwise(F.col(c)) if c in taken else F.when(new, F.lit(None)).otherwise(F.col(c)) if c in cleared else F.col(c)
        if defaults and c in defaults:
            v = F.when(~old, defaults[c]).otherwise(v)
        cols.append(v.cast(target.schema[c].dataType).alias(c))
    return both.select(*cols)


WORK = ("title", "entry_type", "episode", "episode_title", "series", "bundle")


def upsert_works(works: DataFrame, imported: DataFrame, at) -> DataFrame:
    """works after an import: the run's columns are taken and the repeat key is cleared, since its stills have not been
    matched yet; what people typed and the time of the first import stay."""
    return upsert(works, imported, "work", WORK, ("repeats_key",), {"imported_at": at})


def sync_catalogue(seasons: DataFrame, franchises: DataFrame, listed: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """Both tables after a catalogue's answer; ids below zero are local ones that it never names. listed: season, name, kind,
    air_date, franchise, franchise_name, sort_name; a name that is missing is the id."""
    own = listed.where("season >= 0 AND season IS NOT NULL")
    s = own.groupBy("season").agg(*[F.max(c).alias(c) for c in ("franchise", "kind", "air_date")], F.coalesce(F.max("name"), F.col("season").cast("string")).alias("name"))
    f = own.groupBy("franchise").agg(F.coalesce(F.max("franchise_name"), F.col("franchise").cast("string")).alias("name"), F.max("sort_name").alias("sort_name"))
    f = f.withColumn("synced_at", at)
    return upsert(seasons, s, "season", ("franchise", "kind", "air_date", "name")), upsert(franchises, f, "franchise", ("name", "sort_name", "synced_at"))
