"""How far reviewed labels agree with proposed ones; tag evidence fused into fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(machine: Column, truth: Column) -> Column:
    return (
        F.when(machine.isNotNull() & machine.eqNullSafe(truth), "agreed").when(machine.isNotNull() & truth.isNotNull(), "corrected")
        .when(machine.isNotNull(), "cleared").when(truth.isNotNull(), "missed").otherwise("none")
    )


def judged(checks: DataFrame) -> DataFrame:
    """family, source, machine, truth, kind of each check. checks: family, source, machine, answered, human (null: nothing applies)."""
    truth = F.when(F.col("answered"), F.col("human")).otherwise(F.col("machine"))
    return checks.select("family", F.coalesce("source", F.lit("not recorded")).alias("source"), "machine", truth.alias("truth"), outcome(F.col("machine"), truth).alias("kind"))


def report(checks: DataFrame) -> DataFrame:
    """Counts of each outcome per family, and the share of proposals that review agreed with."""
    kinds = ("agreed", "corrected", "cleared", "missed", "none")
    out = judged(checks).groupBy("family").agg(F.count(F.lit(1)).alias("checked"), F.count("machine").alias("proposed"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return out.withColumn("agreement", F.round(F.col("agreed") / F.when(F.col("proposed") > 0, F.col("proposed")), 6))


def by_value(checks: DataFrame) -> DataFrame:
    """Per family, source and proposed value; all values of a source and all sources of a family too (nulls)."""
    j = judged(checks).where("machine IS NOT NULL")
    out = j.rollup("family", "source", "machine").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "agreed").alias("agreed"), F.grouping_id().cast("int").alias("level"))
    return out.where("family IS NOT NULL")


def corrections(checks: DataFrame) -> DataFrame:
    """What wrong proposals were corrected to."""
    j = judged(checks).where("machine IS NOT NULL AND kind <> 'agreed'")
    return j.groupBy("family", "source", "machine", F.coalesce("truth", F.lit("none")).alias("to")).agg(F.count(F.lit(1)).alias("n"))


def score(checks: DataFrame, run: DataFrame) -> DataFrame:
    """A run against the checks: answered, right, missed, truths and checks without a candidate. run: id, family, label."""
    j = checks.select("id", "family", F.when(F.col("answered"), F.col("human")).otherwise(F.col("machine")).alias("truth"))
    both = j.join(run.select("id", "family", "label", F.lit(True).alias("known")), ["id", "family"], "left")
    return both.groupBy("family").agg(
        F.count_if(F.col("label").isNotNull()).alias("answered"), F.count_if(F.col("label") == F.col("truth")).alias("right"),
        F.count_if(F.col("known") & F.col("label").isNull() & F.col("truth").isNotNull()).alias("missed"), F.count_if(F.col("known") & F.col("truth").isNotNull()).alias("truths"), F.count_if(F.col("known").isNull()).alias("unmatched"),
    )


def filled(checks: DataFrame) -> DataFrame:
    """family, value, n: what review put where nothing was proposed."""
    return judged(checks).where("kind = 'missed'").groupBy("family", F.col("truth").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def suggestions(checks: DataFrame) -> DataFrame:
    """family, n, accepted, changed, unanswered of values that were suggested, not proposed. checks also has `suggested`.

    Silence says nothing of a suggestion: it was not cleared.
    """
    held = checks.where(F.col("machine").isNull() & F.col("suggested").isNotNull())
    human = F.when(F.col("answered"), F.col("human"))
    return held.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(human == F.col("suggested")).alias("accepted"), F.count_if(human != F.col("suggested")).alias("changed"), F.count_if(human.isNull()).alias("unanswered")
    )


def runs(checks: DataFrame) -> DataFrame:
    """taxonomy, allowlist, fusion, tag_cut, scene_cut, n: the label versions that the checks were made against; nulls are one value."""
    return checks.groupBy("taxonomy", "allowlist", "fusion", "tag_cut", "scene_cut").agg(F.count(F.lit(1)).alias("n"))
