"""Time: intervals, shots, samples, as-of frames, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(intervals: DataFrame, margin: float = 0.0) -> DataFrame:
    """src, s, e, ids: overlapping intervals of a source joined, each widened by a margin. Rows: src, id, s, e."""
    w = Window.partitionBy("src").orderBy("s", "e", "id")
    x = intervals.select("src", "id", F.greatest(F.lit(0.0), F.col("s") - margin).alias("s"), (F.col("e") + margin).alias("e"))
    x = x.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("island", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(w))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "e", "id"))), lambda r: r["id"].cast("string")), ",")
    return x.groupBy("src", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), ids.alias("ids")).select("src", "s", "e", "ids")


def free(merged: DataFrame, spans: DataFrame) -> DataFrame:
    """src, s, e: what merged intervals leave of each source's 0..duration. spans: src, duration."""
    w = Window.partitionBy("src").orderBy("s")
    after = merged.select("src", F.col("e").alias("s"), F.lead("s").over(w).alias("e"))
    first = spans.join(merged.groupBy("src").agg(F.min("s").alias("e")), "src", "left").select("src", F.lit(0.0).alias("s"), "e")
    rest = first.unionByName(after).join(spans, "src")
    return rest.select("src", "s", F.least(F.coalesce("e", "duration"), "duration").alias("e")).where("e > s")


def status(times: DataFrame, approved: DataFrame, proposed: DataFrame, margin: float = 2.0, bucket: float = 3600.0) -> DataFrame:
    """id, status, held_by of times outside approved intervals: held by the first proposed interval over it, else cleared.

    times: src, id, t; intervals: src, id, s, e, ord. Intervals meet times by source and time bucket.
    """
    spread = lambda iv: iv.withColumn("k", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor(F.col("e") / bucket))))
    t = times.withColumn("tk", F.floor(F.col("t") / bucket))
    out = spread(merge(approved, margin)).select(F.col("src").alias("s1"), "k", "s", "e")
    t = t.join(out, (t["src"] == out["s1"]) & (t["tk"] == out["k"]) & t["t"].between(out["s"], out["e"]), "left_anti")
    held = spread(proposed).select(F.col("src").alias("s2"), "k", "s", "e", "ord", F.col("id").alias("by"))
    both = t.join(held, (t["src"] == held["s2"]) & (t["tk"] == held["k"]) & t["t"].between(held["s"], held["e"]), "left")
    best = both.groupBy("src", t["id"]).agg(F.min_by("by", "ord").alias("held_by"))
    return best.select("src", "id", F.when(F.col("held_by").isNull(), "cleared").otherwise("held_unresolved").alias("status"), "held_by")


def shots(cuts: DataFrame, spans: DataFrame) -> DataFrame:
    """src, shot, s, e, score: between cuts; a shot has the score of the cut that opens it. cuts: src, t, score; spans: src, duration."""
    ends = cuts.unionByName(spans.select("src", F.col("duration").alias("t"), F.lit(0.0).alias("score")))
    w = Window.partitionBy("src").orderBy("t", "score")
    rows = ends.select("src", F.lag("t", 1, 0.0).over(w).alias("s"), F.col("t").alias("e"), F.lag("score", 1, 0.0).over(w).alias("score")).where("e > s")
    return rows.withColumn("shot", (F.row_number().over(Window.partitionBy("src").orderBy("s")) - 1).cast("int"))


def samples_per_shot(span: Column, spacing: float = 2.0, most: int = 3, density: float = 1.0) -> Column:
    natural = F.lit(most) if spacing <= 0 else 1 + F.floor(span / F.lit(spacing))
    return F.greatest(F.lit(1), F.least(F.lit(most), F.bround(natural * F.lit(density)).cast("int")))


def samples(shot_rows: DataFrame, regions: DataFrame, margin: float = 0.5) -> DataFrame:
    """src, shot, k, t: evenly spaced samples of each shot's part in each free region."""
    r = regions.select(F.col("src").alias("rs"), F.col("s").alias("r0"), F.col("e").alias("r1"))
    both = shot_rows.join(r, (F.col("src") == F.col("rs")) & (F.col("s") < F.col("r1")) & (F.col("e") > F.col("r0")))
    both = both.select("src", "shot", (F.greatest("s", "r0") + margin).alias("a"), (F.least("e", "r1") - margin).alias("b")).where("b > a")
    both = both.withColumn("n", samples_per_shot(F.col("b") - F.col("a")))
    both = both.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return both.select("src", "shot", "k", (F.col("a") + (F.col("b") - F.col("a")) / F.col("n") * (F.col("k") + F.lit(0.5))).alias("t"))


def next_frame(times: DataFrame, frames: DataFrame) -> DataFrame:
    """src, id, frame: the first frame time at or after each time (null past the end). One sort of both, no pair of rows."""
    both = times.select("src", "t", F.col("id"), F.lit(None).cast("double").alias("f"), F.lit(0).alias("kind"))
    both = both.unionByName(frames.select("src", F.col("f").alias("t"), F.lit(None).cast("long").alias("id"), "f", F.lit(1).alias("kind")))
    w = Window.partitionBy("src").orderBy("t", "kind").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("frame", F.first("f", ignorenulls=True).over(w)).where("kind = 0").select("src", "id", "frame")


#: First words of a chapter's title that name a theme; length and place of one that has no name, in seconds.
OPENING, ENDING = ("op", "opening"), ("ed", "ending", "outro", "credit", "credits")
THEME, EDGE, LEAST, REST = (85, 95), 360, 20, 60


def chapter_kind(title: Column, s: Column, e: Column, duration: Column) -> Column:
    """opening or ending with what says so, or null: a title's first word, else the length of a theme near either end.

    Neither a chapter too short to drop nor one that would leave less than a minute of the file is any kind.
    """
    length, word = e - s, F.lower(F.regexp_extract(title, "^([A-Za-z]+)(?:[^A-Za-z_]|$)", 1))
    theme = length.between(*THEME) & (duration > 0)
    named = F.when(word.isin(*OPENING), "opening_theme:named").when(word.isin(*ENDING), "ending_theme:named")
    near = F.when(theme & (s <= EDGE), "opening_theme:length-and-position").when(theme & (duration - e <= EDGE), "ending_theme:length-and-position")
    return F.when((length >= LEAST) & ~((duration > 0) & (duration - length < REST)), F.coalesce(named, near))


def chapters(rows: DataFrame) -> DataFrame:
    """src, id, kind, held; nothing is held where less than a minute of the file would be left. Rows: src, id, title, s, e, duration."""
    x = rows.withColumn("kind", chapter_kind(F.trim("title"), F.col("s"), F.col("e"), F.col("duration")))
    taken = F.sum(F.when(F.col("kind").isNotNull(), F.col("e") - F.col("s")).otherwise(0.0)).over(Window.partitionBy("src"))
    return x.select("src", "id", "kind", (F.col("kind").isNotNull() & ~((F.col("duration") > 0) & (F.col("duration") - taken < 60))).alias("held"))
