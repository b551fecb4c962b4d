"""Palette descriptor rules over arrays of colours (struct hue, sat, luma, weight, cb, cr, accent)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stillwater.functions.color import bound

#: Hues of the eight bands in degrees, how far a band reaches, what an unsaturated colour still weighs,
#: and where colours are too grey, too dark or too bright to have a hue.
BANDS, REACH, GREY = (0.0, 30.0, 60.0, 120.0, 180.0, 220.0, 275.0, 320.0), 75.0, 0.25
LEAST_SAT, DARK, BRIGHT = 0.08, 0.10, 0.94
ACCENT_SHARE = 0.06


def turn(a: Column, b: Column) -> Column:
    """Degrees between two hues, the short way."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def has_hue(c: Column) -> Column:
    return (c["sat"] >= LEAST_SAT) & c["luma"].between(DARK, BRIGHT)


def extreme(r: Column, g: Column, b: Column) -> Column:
    """Nearly black or nearly white; parts from 0 to 255."""
    return (F.greatest(r, g, b) < 8) | (F.least(r, g, b) > 247)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def pull(c: Column) -> Column:
    return c["weight"] * (F.lit(GREY) + c["sat"])


def hue_supports(colors: Column) -> Column:
    """Eight shares: how much each band is backed by colours near it; all 0 without a coloured one."""
    live = F.transform(F.filter(colors, has_hue), lambda c: F.struct(c["hue"].alias("hue"), pull(c).alias("pull")))

    def band(live: Column, hue: float) -> Column:
        near = lambda c: F.greatest(F.lit(0.0), F.lit(1.0) - turn(F.lit(hue), c["hue"]) / REACH) * c["pull"]
        return F.aggregate(live, F.lit(0.0), lambda acc, c: acc + near(c))

    raw = bound(live, lambda live: F.array(*[band(live, h) for h in BANDS]))
    return shared(raw, lambda x, all_: F.when(all_ > 1e-6, x / all_).otherwise(x))


def shared(xs: Column, part) -> Column:
    """part(x, sum of all) of each number: the numbers and their sum are computed once, not once an element."""
    both = bound(xs, lambda xs: F.struct(xs.alias("xs"), total(xs).alias("all")))
    return bound(both, lambda b: F.transform(b["xs"], lambda x: part(x, b["all"])))


def weighted_mean(colors: Column, part: str) -> Column:
    """Mean of sat, cb or cr over coloured ones; 0 without any."""
    live = F.transform(F.filter(colors, has_hue), lambda c: F.struct(c[part].alias("x"), pull(c).alias("pull")))
    sums = bound(live, lambda live: F.struct(total(F.transform(live, lambda c: c["pull"])).alias("w"), total(F.transform(live, lambda c: c["x"] * c["pull"])).alias("s")))
    return bound(sums, lambda x: F.when(x["w"] > 1e-6, x["s"] / x["w"]).otherwise(0.0))


def strip_shares(weights: Column) -> Column:
    """Widths of a palette strip: an accent gets a least share before all add up to 1. weights: array of struct weight, accent."""
    own = F.transform(weights, lambda s: F.when(s["accent"], F.greatest(s["weight"], F.lit(ACCENT_SHARE))).otherwise(s["weight"]))
    return shared(own, lambda w, all_: w / F.when(all_ == 0, 1.0).otherwise(all_))
