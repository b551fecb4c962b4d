"""Palettes of pictures from their pixels: weighted histograms, representative picks, the distance of two palettes.

Pixels are rows (img, r, g, b of 0 to 255), so a picture of any size is many tasks' work until its bins are summed; weights are
whole millionths, which makes sums independent of their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.functions import descriptor as de
from stillwater.functions import picks
from stillwater.functions.color import bound

#: Brightness of the tone buckets, which overlap, and from where a colour counts as black or white.
TONES = (("all", None, None), ("shadows", None, 0.33), ("midtones", 0.25, 0.72), ("highlights", 0.67, None))
BLACK, WHITE = 0.085, 0.985
TO_REF = 70.0


def histogram(pixels: DataFrame) -> DataFrame:
    """img, tone, bin (of 16 x 16 x 16), w, sr, sg, sb: weights by saturation and middle brightness, and weighted sums."""
    parts = [F.col(c).cast("int") for c in "rgb"]
    top, low = F.greatest(*parts) / 255, F.least(*parts) / 255
    snapped = lambda c: F.when(top < BLACK, 0).when(low > WHITE, 255).otherwise(c)
    rows = pixels.select("img", *[snapped(c).alias(n) for c, n in zip(parts, "rgb", strict=True)])
    c = {n: F.col(n) for n in "rgb"}
    rows = rows.withColumns({"y": picks.luma(c), "s": picks.saturation(c)})
    weight = (F.col("s") * 0.85 + 0.15) * (F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("y") - 0.5) * 1.4) + 0.35)
    at = F.shiftleft(F.shiftright("r", 4), 8) + F.shiftleft(F.shiftright("g", 4), 4) + F.shiftright("b", 4)
    within = lambda low, high: F.lit(True) & (F.lit(True) if low is None else F.col("y") >= low) & (F.lit(True) if high is None else F.col("y") < high)
    tones = F.array_compact(F.array(*[F.when(within(low, high), name) for name, low, high in TONES]))
    rows = rows.select("img", at.cast("int").alias("bin"), F.round(weight * 1e6).cast("long").alias("w"), *"rgb", F.explode(tones).alias("tone"))
    return rows.groupBy("img", "tone", "bin").agg(F.sum("w").alias("w"), *[F.sum(F.col(n) * F.col("w")).alias(f"s{n}") for n in "rgb"])


def gathered(bins: DataFrame) -> DataFrame:
    """img, tone, bins (array), total: at most 4,096 bins each."""
    mean = lambda n: (F.col(f"s{n}").cast("double") / F.greatest(F.col("w"), F.lit(1))).alias(n)
    return bins.groupBy("img", "tone").agg(F.collect_list(F.struct("w", "bin", *[mean(n) for n in "rgb"])).alias("bins"), F.sum("w").alias("total"))


def byte(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x + 0.5).cast("int")))


def told(c: Column, weight: Column, accent: Column) -> Column:
    """A pick as a palette's colour: hex, weight, hue, sat, luma, accent; parts are rounded to bytes first."""
    whole = F.struct(*[byte(c[n]).cast("double").alias(n) for n in "rgb"])
    hex_ = lambda x: F.concat(F.lit("#"), *[F.lpad(F.hex(x[n].cast("long")), 2, "0") for n in "rgb"])
    return bound(whole, lambda x: F.struct(hex_(x).alias("hex"), weight.alias("weight"), picks.hue(x).alias("hue"), picks.saturation(x).alias("sat"), picks.luma(x).alias("luma"), accent.alias("accent")))


def palettes(pixels: DataFrame, n: int = 8, tones: tuple = ("all", "shadows", "midtones", "highlights")) -> DataFrame:
    """img, tone, dominant, representative: arrays of colours (hex, weight, hue, sat, luma, accent).

    A pick's weight is its share of the picks, an accent's its share of the whole picture. Without weight both are empty.
    """
    rows = gathered(histogram(pixels).where(F.col("tone").isin(*tones)))
    rows = rows.withColumn("bins", F.transform("bins", picks.rich))
    both = F.struct(picks.dominant(F.col("bins"), F.col("total"), n).alias("d"), picks.representative(F.col("bins"), F.col("total"), n).alias("p"))
    rows = rows.select("img", "tone", "total", F.inline(F.array(both)))  # a generator's columns are computed once, however often used
    mass = lambda xs: F.greatest(F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    plain = mass(F.transform(F.filter("p", lambda x: ~x["accent"]), lambda x: x["c"]["w"]))
    all_ = mass(F.transform("d", lambda x: x["w"]))
    return rows.select(
        "img", "tone", F.transform("d", lambda x: told(x, x["w"] / all_, F.lit(False))).alias("dominant"),
        F.transform("p", lambda x: told(x["c"], F.when(x["accent"], x["c"]["w"] / F.greatest(F.col("total"), F.lit(1))).otherwise(x["c"]["w"] / plain), x["accent"])).alias("representative"),
    )


def out_of_palette(reference: Column, target: Column) -> Column:
    """The share of target's coloured mass whose hue finds no partner in reference; 0 where either has no colour."""
    refs, own = F.filter(reference, de.has_hue), F.filter(target, de.has_hue)

    def missing(refs: Column) -> Column:
        near = lambda c: F.array_max(F.transform(refs, lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - de.turn(r["hue"], c["hue"]) / TO_REF))))
        out, all_ = de.total(F.transform(own, lambda c: (1.0 - near(c)) * de.pull(c))), de.total(F.transform(own, de.pull))
        return F.when((F.size(refs) == 0) | (all_ <= 1e-6), 0.0).otherwise(out / all_)

    return bound(refs, missing)


def palette_distance(a: Column, b: Column) -> Column:
    """struct<hue_family_l1, out_of_palette_mass, source_chroma_delta> from palette a to palette b."""
    apart = de.total(F.zip_with(de.hue_supports(a), de.hue_supports(b), lambda x, y: F.abs(x - y))) * 0.5
    return F.struct(apart.alias("hue_family_l1"), out_of_palette(a, b).alias("out_of_palette_mass"), (de.weighted_mean(b, "sat") - de.weighted_mean(a, "sat")).alias("source_chroma_delta"))
