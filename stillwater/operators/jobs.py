"""The workflow's tables: rates, runnable stages, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.operators.catalog import placed
from stillwater.operators.keep import few, kept


def usual_rates(runs: DataFrame, least: int = 5) -> DataFrame:
    """stage, film, low, high: 10th and 90th percentile of a rate where at least `least` runs are known. runs: stage, film, rate.

    Exact, between neighbours in proportion. The rates are numbered over ranges of all groups, and a group needs the four at
    its places alone, so no task holds a group's rates. Runs without a rate count as known, but have no place.
    """
    rows = kept(placed(runs.where("rate IS NOT NULL").select("stage", "film", "rate"), "stage", "film", "rate"))
    own = rows.groupBy(F.col("stage").alias("_s"), F.col("film").alias("_f")).agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = F.col("stage").eqNullSafe(F.col("_s")) & F.col("film").eqNullSafe(F.col("_f"))
    at = F.col("place") - F.col("_first")
    ends = {q: F.lit(q) * (F.col("_n") - 1) for q in (0.1, 0.9)}
    near = rows.join(few(own), same).withColumn("at", at).where(" OR ".join(f"at IN (floor({q} * (_n - 1)), ceil({q} * (_n - 1)))" for q in ends))

    def between(q: float):
        w = ends[q] - F.floor(ends[q])
        low, high = (F.max(F.when(F.col("at") == side(ends[q]), F.col("rate"))) for side in (F.floor, F.ceil))
        return low * (1 - F.max(w)) + high * F.max(w)

    found = near.groupBy("stage", "film").agg(between(0.1).alias("low"), between(0.9).alias("high"))
    known = runs.groupBy(F.col("stage").alias("_s"), F.col("film").alias("_f")).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= least)
    return known.join(found, same, "left").select(F.col("_s").alias("stage"), F.col("_f").alias("film"), "low", "high")


def batch_estimates(runs: DataFrame, stages: tuple[str, ...], first: str, last: str) -> DataFrame:
    """runs, seconds_per_minute, stills_per_minute: one row, or none until stages `first` and `last` have both run.

    Committed stages of a first attempt with a known time and some video count. A stage's cost is all its seconds over all
    its minutes of video, and the costs of the given `stages` add up (others, run beside them, don't count); stills and runs
    are those of `last`.
    runs: stage, state, attempt, seconds, video (its seconds), selected.
    """
    known = runs.where((F.col("state") == "committed") & (F.col("attempt") == 1) & F.col("seconds").isNotNull() & (F.col("video") > 0))
    each = known.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"), (F.sum("video") / 60).alias("minutes"), F.sum("selected").alias("selected"))
    of = lambda c: F.max(F.when(F.col("stage") == last, F.col(c)))
    total = each.agg(of("n").alias("runs"), F.sum(F.when(F.col("stage").isin(*stages), F.col("seconds") / F.col("minutes")).otherwise(0.0)).alias("seconds_per_minute"), (of("selected") / of("minutes")).alias("stills_per_minute"), F.bool_or(F.col("stage") == first).alias("ok"))
    return total.where(F.col("ok") & F.col("runs").isNotNull()).drop("ok")


def runnable(jobs: DataFrame, now) -> DataFrame:
    """id, capability of stages that may start: due or with an expired lease, and no parent that isn't committed.

    jobs: id, parent, capability, state, not_before, lease, created.
    """
    p = jobs.select(F.col("id").alias("pid"), F.col("state").alias("pstate"))
    due = F.col("state").isin("queued", "retry_wait") & (F.col("not_before").isNull() | (F.col("not_before") <= now))
    lost = F.col("state").isin("leased", "running") & (F.col("lease") < now)
    both = jobs.join(p, jobs["parent"] == p["pid"], "left").where((due | lost) & (F.col("parent").isNull() | (F.col("pstate") == "committed")))
    return both.select("id", "capability", "created")


def line(ready: DataFrame) -> DataFrame:
    """Position of each ready stage in its machine's line, and the line's length. Places are numbered over ranges of all
    lines, so a machine's line is not one task's work."""
    rows = kept(placed(ready, "capability", "created", "id"))
    ends = rows.groupBy(F.col("capability").alias("_of")).agg((F.min("place") - 1).alias("ahead"), F.count(F.lit(1)).alias("waiting"))
    return rows.join(few(ends), F.col("capability").eqNullSafe(F.col("_of"))).select("id", "capability", (F.col("place") - F.col("ahead")).alias("position"), "waiting")


#: States of stages by what they mean for their chain.
STUCK, RUNNING = ("dead_letter", "blocked", "ineligible"), ("leased", "running", "cancel_requested")
OPEN = ("queued", "leased", "running", "retry_wait", "blocked", "cancel_requested")


def chain_group(chains: DataFrame) -> DataFrame:
    """chain, status, current, stages: what a chain's stages say as a whole. Rows: chain, depth, id, state.

    A stuck stage needs attention whatever else runs; a cancelled stage decides only when no other is open. The current
    stage is the first that is stuck, else the first that runs, else the first still to come.
    """
    state = F.col("state")
    has = lambda *s: F.bool_or(state.isin(*s))
    status = (
        F.when(has(*STUCK), "attention").when(has(*RUNNING), "running").when(F.bool_and(state == "committed"), "done")
        .when(has("cancelled") & ~has(*OPEN), "cancelled").otherwise("waiting")
    )
    first = lambda ok: F.min(F.when(ok, F.struct("depth", "id")))
    current = F.coalesce(first(state.isin(*STUCK)), first(state.isin(*RUNNING)), first(~state.isin("committed", "cancelled")))
    return chains.groupBy("chain").agg(status.alias("status"), current.alias("c"), F.count(F.lit(1)).alias("stages")).select("chain", "status", F.col("c.id").alias("current"), "stages")


def newest(chains: DataFrame) -> DataFrame:
    """work, chain, earlier: the newest of a work's chains that committed something, and how many such came before.

    Of chains of one time the least counts. Rows: work, chain, created, state, one a stage.
    """
    each = chains.where(F.col("state") == "committed").groupBy("work", "chain").agg(F.max("created").alias("created"))
    best = F.max_by("chain", F.struct("created", -F.col("chain")))
    return each.groupBy("work").agg(best.alias("chain"), (F.count(F.lit(1)) - 1).alias("earlier"))


def roots(jobs: DataFrame) -> DataFrame:
    """id, root, depth by parent links of any length: each round doubles how far a row has looked. A parent that is no row is none.

    Links that lead in a circle have no root and raise an error.
    """
    known = jobs.select(F.col("id").alias("known"))
    out = jobs.join(known, jobs["parent"] == known["known"], "left").select("id", F.col("known").alias("up"), F.coalesce("known", "id").alias("root"), F.col("known").isNotNull().cast("int").alias("depth"))
    far, n = 1, None
    while True:
        out = kept(out)
        if out.where("up IS NOT NULL").isEmpty():
            return out.select("id", "root", "depth")
        n = out.count() if n is None else n
        if far > 2 * n:
            raise ValueError("parents lead in a circle")
        step = out.select(F.col("id").alias("pid"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"))
        both = out.join(step, out["up"] == step["pid"], "left")
        out = both.select("id", F.col("next").alias("up"), F.coalesce("top", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        far *= 2
