"""Job records of older forms brought to the present one: JSON held as VARIANT, keys renamed, words replaced, purposes filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a source's identity, old and new, and the worker that was named after its machine.
IDENTITY = {"shoko_series_id": "series_id", "shoko_episode_ids": "episode_ids", "shoko_file_id": "file_id", "fixture_id": "work_id"}
WORKERS = {"unraid": "source"}


def mapping(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def members(v: Column) -> Column:
    """A VARIANT object as a map; null for anything else."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v.cast("map<string,variant>"))


def renamed(v: Column, names: dict[str, str]) -> Column:
    """An object with its keys renamed; where the new key is there too, the old one's value takes its place."""
    m = members(v)
    found = F.map_filter(m, lambda k, x: F.map_contains_key(mapping(names), k))
    new = F.transform_keys(found, lambda k, x: F.element_at(mapping(names), k))
    rest = F.map_filter(m, lambda k, x: ~F.map_contains_key(mapping(names), k) & ~F.map_contains_key(new, k))
    return F.to_variant_object(F.map_concat(rest, new))


def put(v: Column, key: str, value: Column) -> Column:
    """An object with one member set. value: a VARIANT."""
    return F.to_variant_object(F.map_concat(F.map_filter(members(v), lambda k, x: k != key), F.create_map(F.lit(key), value)))


def words(xs: Column, names: dict[str, str]) -> Column:
    """An array of words with some replaced, null for null."""
    return F.transform(xs, lambda x: F.coalesce(F.try_element_at(mapping(names), x), x))


def purposes(jobs: DataFrame) -> DataFrame:
    """chain, purpose of chains that tell it by their shape: one that begins with a palette stage, one that is a lone import."""
    each = jobs.groupBy("chain").agg(F.bool_or((F.col("stage") == "palette") & F.col("parent").isNull()).alias("palette"), F.bool_or((F.col("stage") == "import") & F.col("parent").isNull()).alias("import"), F.count(F.lit(1)).alias("n"))
    return each.select("chain", F.when(F.col("palette"), "repalette").when(F.col("import") & (F.col("n") == 1), "reread").alias("purpose")).where("purpose IS NOT NULL")


def migrate(jobs: DataFrame) -> DataFrame:
    """jobs with capability, owner and params (JSON) in the present form. A reread is filled in only where its flag stands.

    jobs: id, chain, parent, stage, state, capability, owner, params. Params that are no object stay as they are.
    """
    rows = jobs.join(purposes(jobs), "chain", "left").withColumn("_v", F.try_parse_json("params"))
    old = F.try_variant_get("_v", "$.identity", "variant")
    has_old = F.try_variant_get("_v", "$.identity.shoko_series_id", "variant").isNotNull()
    rows = rows.withColumn("_w", F.when(has_old, put(F.col("_v"), "identity", renamed(old, IDENTITY))).otherwise(F.col("_v")))
    bare = F.try_variant_get("_w", "$.purpose", "variant").isNull() & members(F.col("_w")).isNotNull()
    flagged = F.col("purpose").isNotNull() & ((F.col("purpose") != "reread") | F.try_variant_get("_w", "$.reread", "variant").isNotNull())
    filled = F.when(bare & flagged, put(F.col("_w"), "purpose", F.parse_json(F.concat(F.lit('"'), F.col("purpose"), F.lit('"'))))).otherwise(F.col("_w"))
    live = F.col("state").isin("leased", "running", "cancel_requested")
    swap = lambda c: F.coalesce(F.try_element_at(mapping(WORKERS), F.col(c)), F.col(c))
    new = {"capability": swap("capability"), "owner": F.when(live, swap("owner")).otherwise(F.col("owner")), "params": F.when(F.col("_v").isNull(), F.col("params")).otherwise(F.to_json(filled))}
    return rows.withColumns(new).select(*jobs.columns)
