"""Bundles checked as wholes: their list against the digest that closed them, every listed frame against its file.

One row a bundle: the first problem in a fixed order, or 'accepted'. The list's digest is taken over its entries in order of their
place, so a list that was changed after closing is found. All is joins and grouped minima; a bundle of any size is many
tasks' work until its list is digested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Problems in the order in which they count.
PROBLEMS = ("not finished", "changed list", "no frames", "unsafe id", "listed twice", "missing frame", "wrong size", "wrong digest", "other timestamp", "other dimensions")


def safe(name: Column) -> Column:
    """A name that stays where it is put: no separator, no leading dot, no control sign, not empty."""
    odd = F.greatest(*[F.position(F.lit(c), name) for c in ("/", "\\", ":")])
    return F.coalesce((F.length(name) > 0) & (F.length(name) <= 255) & (odd == 0) & ~name.startswith(".") & ~name.rlike(r"\p{Cntrl}"), F.lit(False))


def entry(prefix: str = "") -> Column:
    """A list entry as text."""
    return F.concat_ws("|", *[F.coalesce(F.col(prefix + c).cast("string"), F.lit("-")) for c in ("id", "name", "bytes", "sha256", "asked", "found", "width", "height")])


def list_digest(listed: DataFrame) -> DataFrame:
    """bundle, digest of its entries in order of place."""
    return lists(listed).select("bundle", "digest")


def lists(listed: DataFrame) -> DataFrame:
    """bundle, digest of its entries in order of place, frames (their number), double (whether an id or a name comes twice)."""
    rows = listed.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("place", F.sha2(entry(), 256).alias("e"), "id", "name"))).alias("es"))
    twice = lambda c: F.size(F.array_distinct(F.transform("es", lambda x: x[c]))) < F.size("es")
    digest = F.sha2(F.array_join(F.transform("es", lambda x: x["e"]), "\n"), 256)
    return rows.select("bundle", digest.alias("digest"), F.size("es").alias("frames"), (twice("id") | twice("name")).alias("double"))


def verdicts(bundles: DataFrame, listed: DataFrame, files: DataFrame) -> DataFrame:
    """bundle, verdict, frames.

    bundles: bundle, name, closed (the digest recorded when it was finished; null: not finished); listed: bundle, place, id,
    name, bytes, sha256, asked, found, width, height (null: not told); files: bundle, name, size, sha256, width, height.
    """
    said = lambda k, bad: F.when(F.coalesce(bad, F.lit(False)), F.lit(PROBLEMS.index(k)))
    f = files.select(F.col("bundle").alias("fb"), F.col("name").alias("fn"), F.col("size"), F.col("sha256").alias("fsha"), F.col("width").alias("fw"), F.col("height").alias("fh"), F.lit(True).alias("there"))
    each = listed.join(f, (F.col("bundle") == F.col("fb")) & (F.col("name") == F.col("fn")), "left")
    # Of a frame that is there, all that is told must hold; a size that isn't told is not asked for.
    frame = F.least(
        said("unsafe id", ~safe(F.col("id"))), said("missing frame", F.col("there").isNull() | ~safe(F.col("name"))), said("wrong size", F.col("size") != F.col("bytes")),
        said("wrong digest", ~F.col("fsha").eqNullSafe(F.col("sha256"))), said("other timestamp", ~F.col("asked").eqNullSafe(F.col("found"))),
        said("other dimensions", F.col("width").isNotNull() & F.col("height").isNotNull() & ((F.col("fw") != F.col("width")) | (F.col("fh") != F.col("height")))),
    )
    worst = each.groupBy("bundle").agg(F.min(frame).alias("frame"))
    rows = bundles
    for more in (lists(listed), worst):
        rows = rows.join(more, "bundle", "left")
    none = F.sha2(F.lit(""), 256)
    problem = F.least(
        said("not finished", F.col("closed").isNull()), said("changed list", F.col("closed") != F.coalesce("digest", none)), said("no frames", F.col("frames").isNull()),
        said("unsafe id", ~safe(F.col("name"))), said("listed twice", F.col("double")), F.col("frame"), F.lit(len(PROBLEMS)),
    )
    words = F.array(*map(F.lit, (*PROBLEMS, "accepted")))
    return rows.select("bundle", F.get(words, problem).alias("verdict"), F.coalesce("frames", F.lit(0)).cast("long").alias("frames"))
