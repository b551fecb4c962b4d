"""Review marks and removals: each change is a projection of the table, returned with what it changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.operators.catalog import placed



def marked(stills: DataFrame, ids: DataFrame) -> DataFrame:
    """stills with `_hit`, whether the id is among ids."""
    return stills.join(ids.select("id").distinct().withColumn("_h", F.lit(True)), "id", "left").withColumn("_hit", F.coalesce("_h", F.lit(False))).drop("_h")


def changed(rows: DataFrame, hit: Column, **values: Column) -> DataFrame:
    """Sets columns where hit; null-safe on the hit."""
    hit = F.coalesce(hit, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def set_review(stills: DataFrame, ids: DataFrame, state: str, at: Column) -> DataFrame:
    return changed(marked(stills, ids), F.col("_hit"), review_state=F.lit(state), reviewed_at=at).drop("_hit")


def set_flag(stills: DataFrame, ids: DataFrame, flag: str, value: bool) -> DataFrame:
    return changed(marked(stills, ids), F.col("_hit"), **{flag: F.lit(value)}).drop("_hit")


def correct(stills: DataFrame, corrections: DataFrame) -> DataFrame:
    """Human values laid over those there are; a null value is kept, as it clears. corrections: id, fix (map)."""
    both = stills.join(corrections.select("id", "fix"), "id", "left")
    old = F.coalesce("facets_human", F.create_map().cast("map<string,string>"))
    new = F.map_zip_with(old, F.col("fix"), lambda k, a, b: F.when(F.map_contains_key(F.col("fix"), k), b).otherwise(a))
    return changed(both, F.col("fix").isNotNull(), facets_human=new).drop("fix")


def accept_suggestion(stills: DataFrame, suggestions: DataFrame) -> DataFrame:
    """A suggested value becomes the reviewer's only where they have said nothing of the family. suggestions: id, family, value."""
    fresh = stills.select("id", "facets_human").join(suggestions, "id")
    fresh = fresh.where(F.col("facets_human").isNull() | ~F.map_contains_key(F.coalesce("facets_human", F.create_map().cast("map<string,string>")), F.col("family")))
    fixes = fresh.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("family", "value")))).alias("fix"))
    return correct(stills, fixes)


def keep_rest(stills: DataFrame, works: DataFrame, at: Column) -> DataFrame:
    """Keeps every picked, unreviewed still of the works that isn't hidden, all with one time stamp."""
    rows = stills.join(works.select("work").distinct().withColumn("_w", F.lit(True)), "work", "left")
    take = F.col("_w") & F.col("selected") & (F.col("review_state") == "unreviewed") & ~F.col("excluded")
    return changed(rows, take, review_state=F.lit("kept"), reviewed_at=at).drop("_w")


def undo(stills: DataFrame, state: str, at: Column) -> DataFrame:
    """Takes back one batch: the stills still in its state with exactly its stamp."""
    return changed(stills, (F.col("review_state") == state) & (F.col("reviewed_at") == at), review_state=F.lit("unreviewed"), reviewed_at=F.lit(None).cast("timestamp"))


def set_locks(stills: DataFrame, ids: DataFrame, discarded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the ids locked, and the ids refused: stills without an image of works whose frames are gone. stills: tiers."""
    rows = marked(stills, ids).join(discarded.select("work").distinct().withColumn("_gone", F.lit(True)), "work", "left")
    bare = F.coalesce("_gone", F.lit(False)) & (F.size("tiers") == 0)
    return changed(rows, F.col("_hit") & ~bare, locked=F.lit(True)).drop("_hit", "_gone"), rows.where(F.col("_hit") & bare).select("id")


def pin(stills: DataFrame, frame: DataFrame) -> DataFrame:
    """A pool frame becomes a locked still that isn't selected, or the still it already is gets the lock. frame: columns of stills."""
    have = set_flag(stills, frame, "locked", True)
    new = frame.join(stills.select("id"), "id", "left_anti").withColumns({"selected": F.lit(False), "locked": F.lit(True)})
    return have.unionByName(new, allowMissingColumns=True)


def remove(works: DataFrame, stills: DataFrame, jobs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the works that go; jobs that scrub stay, and each work gets one."""
    keys = gone.select("work").distinct()
    kept = jobs.join(keys, "work", "left_semi").where("stage = 'scrub'")
    scrub = works.join(keys, "work", "left_semi").select("work", F.lit("scrub").alias("stage"))
    return works.join(keys, "work", "left_anti"), stills.join(keys, "work", "left_anti"), jobs.join(keys, "work", "left_anti").unionByName(kept).unionByName(scrub, allowMissingColumns=True)


def confirm_token(frames: DataFrame) -> DataFrame:
    """work, token: a digest of the frames that a discard would take, checked again when it runs. frames: work, id, keep."""
    listed = F.to_json(F.array_sort(F.collect_list(F.struct("id", "keep"))))
    return frames.groupBy("work").agg(F.substring(F.sha2(listed.cast("binary"), 256), 1, 32).alias("token"))


def new_local(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, id: the known id of a name whatever its case, or a new one below zero."""
    lower = F.lower(F.trim("name"))
    want = names.select(lower.alias("k"), F.trim("name").alias("name")).groupBy("k").agg(F.min("name").alias("name"))
    have = known.select(F.lower("name").alias("hk"), F.col("id").alias("old")).groupBy("hk").agg(F.min("old").alias("old"))
    both = want.join(have, want["k"] == have["hk"], "left")
    low = known.agg(F.least(F.coalesce(F.min("id"), F.lit(0)), F.lit(0)).alias("low"))
    new = placed(both.where("old IS NULL").select("name"), "name").select("name", F.col("place").alias("r"))
    new = new.join(F.broadcast(low)).select("name", (F.col("low") - F.col("r")).cast("long").alias("id"))  # one row
    return both.where("old IS NOT NULL").select("name", F.col("old").cast("long").alias("id")).unionByName(new)


def rename_values(rows: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Values of an array column under their new names."""
    return rows.withColumn(column, F.transform(column, lambda x: F.coalesce(*[F.when(x == a, b) for a, b in names.items()], x)))


def file_problems(files: DataFrame) -> DataFrame:
    """id, problem of files that can't be queued. files: id, episode, minutes, known (a work has it), live (a chain runs)."""
    several = files.where("episode IS NOT NULL").groupBy(F.col("episode").alias("_e")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    files = files.join(several, F.col("episode") == F.col("_e"), "left")
    said = F.array(
        F.when(F.col("known"), "already a work"), F.when(F.col("live"), "already queued"), F.when(F.coalesce("minutes", F.lit(0.0)) <= 0, "no duration"),
        F.when(F.col("_n").isNotNull(), "several files of the episode"),
    )
    return files.select("id", F.explode(F.array_compact(said)).alias("problem"))
