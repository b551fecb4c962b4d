"""Picks from a picture's colour bins, as expressions over arrays of struct w (long), bin, r, g, b (0 to 255), h, s, y (`rich`).

A picture has at most 4,096 bins, so an array is bounded; every step is an `aggregate` in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stillwater.functions.color import bound
from stillwater.functions.descriptor import BRIGHT, DARK, LEAST_SAT, extreme, turn

#: What a bin or a group weighs at least of a picture, how near colours are one, accents and what they need.
LEAST_SHARE, MERGE, ACCENTS, ACCENT_SAT, ACCENT_APART = 0.006, 42.0, 2, 0.35, 2.0
#: Degrees, brightness and RGB distance that count 1 between two colours, and how much hue and RGB may count.
HUE_UNIT, LUMA_UNIT, RGB_UNIT, HUE_MOST, RGB_MOST = 55.0, 0.20, 70.0, 2.0, 1.5
SUMS = "struct<w:double,bin:int,r:double,g:double,b:double>"
BIN = "struct<w:bigint,bin:int,r:double,g:double,b:double,h:double,s:double,y:double>"


def heavy(bins: Column) -> Column:
    """Heaviest first; of equals the lower bin."""
    return F.transform(F.array_sort(F.transform(bins, lambda c: F.struct((-c["w"]).alias("n"), c["bin"].alias("k"), c.alias("c")))), lambda x: x["c"])


def luma(c: Column) -> Column:
    return c["r"] / 255 * 0.2126 + c["g"] / 255 * 0.7152 + c["b"] / 255 * 0.0722


def saturation(c: Column) -> Column:
    top = F.greatest(c["r"], c["g"], c["b"])
    return F.when(top <= 0, 0.0).otherwise((top - F.least(c["r"], c["g"], c["b"])) / top)


def hue(c: Column) -> Column:
    """Degrees; 0 for greys."""
    r, g, b = c["r"], c["g"], c["b"]
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(top - low, F.lit(0.0))
    at = F.when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2.0).otherwise((r - g) / span + 4.0)
    return F.coalesce(F.pmod(at * 60.0, F.lit(360.0)), F.lit(0.0))


def apart(x: Column, y: Column) -> Column:
    dr, dg, db = (x[c] - y[c] for c in "rgb")
    return F.sqrt(dr * dr + dg * dg + db * db)


def anchor(c: Column) -> Column:
    return extreme(c["r"], c["g"], c["b"])


def colored(c: Column) -> Column:
    return (c["s"] >= LEAST_SAT) & c["y"].between(DARK, BRIGHT)


def rich(c: Column) -> Column:
    """A bin with its hue, saturation and brightness, which every comparison needs."""
    return F.struct(*[c[k].alias(k) for k in ("w", "bin", "r", "g", "b")], hue(c).alias("h"), saturation(c).alias("s"), luma(c).alias("y"))


def unlikeness(x: Column, y: Column) -> Column:
    """How unlike two picks are: hue, brightness and RGB, each in its unit."""
    return F.least(turn(x["h"], y["h"]) / HUE_UNIT, F.lit(HUE_MOST)) + F.abs(x["y"] - y["y"]) / LUMA_UNIT + F.least(apart(x, y) / RGB_UNIT, F.lit(RGB_MOST))


def worth(c: Column) -> Column:
    """A pick's score: area, colour and middle brightness."""
    balance = F.greatest(F.lit(0.25), F.least(F.lit(1.0), 1.0 - F.abs(c["y"] - 0.45) * 1.6))
    return F.pow(c["w"].cast("double"), F.lit(0.62)) * (c["s"] + 0.35) * balance


def by_worth(bins: Column) -> Column:
    """Best first; of equals the heavier, then the lower bin."""
    rated = F.transform(bins, lambda c: F.struct((-worth(c)).alias("s"), (-c["w"]).alias("n"), c["bin"].alias("k"), c.alias("c")))
    return F.transform(F.array_sort(rated), lambda x: x["c"])


def empty(kind: str) -> Column:
    return F.expr(f"CAST(array() AS array<{kind}>)")


def taken(bins: Column, start: Column, most: Column, fits) -> Column:
    """Greedy picks: the bins in order, each if fewer than `most` are in and it fits with these."""
    return F.aggregate(bins, start, lambda acc, c: F.when((F.size(acc) < most) & fits(acc, c), F.concat(acc, F.array(c))).otherwise(acc))


def cleared(bins: Column, total: Column) -> Column:
    return F.filter(bins, lambda c: c["w"] >= total * LEAST_SHARE)


def dominant(bins: Column, total: Column, n: int) -> Column:
    """Heaviest first, none near one before; nearly black and white ones stand apart from all."""
    fits = lambda acc, c: anchor(c) | ~F.exists(acc, lambda p: ~anchor(p) & (apart(p, c) < MERGE))
    return taken(heavy(cleared(bins, total)), empty(BIN), F.lit(n), fits)


def mean(g: Column) -> Column:
    """A group's sums as a bin."""
    w = F.greatest(g["w"], F.lit(1e-6))
    return F.struct(g["w"].cast("long").alias("w"), g["bin"].alias("bin"), (g["r"] / w).alias("r"), (g["g"] / w).alias("g"), (g["b"] / w).alias("b"))


def off(g: Column, c: Column) -> Column:
    """Squared distance of a group's mean from a colour, times its squared weight: no division."""
    dr, dg, db = (g[k] - g["w"] * c[k] for k in "rgb")
    return dr * dr + dg * dg + db * db


def groups(small: Column) -> Column:
    """Small bins by leader: a bin joins the first group whose mean is near it and moves that mean, or opens one."""
    sums = lambda c: F.struct(c["w"].cast("double").alias("w"), c["bin"].alias("bin"), *[(c[k] * c["w"]).alias(k) for k in "rgb"])
    both = lambda g, c: F.struct((g["w"] + c["w"]).alias("w"), g["bin"].alias("bin"), *[(g[k] + c[k] * c["w"]).alias(k) for k in "rgb"])

    def put(acc: Column, c: Column) -> Column:
        first = F.array_position(F.transform(acc, lambda g: off(g, c) < g["w"] * g["w"] * MERGE**2), F.lit(True))
        return bound(first, lambda k: F.when(k == 0, F.concat(acc, F.array(sums(c)))).otherwise(F.transform(acc, lambda g, i: F.when(i == k - 1, both(g, c)).otherwise(g))))

    return F.transform(F.aggregate(heavy(small), empty(SUMS), put), lambda g: bound(mean(g), rich))


def accents(bins: Column, large: Column, total: Column) -> Column:
    """Colours spread thin over small bins: groups of enough weight with none of the `large` bins near, which are heavy enough by themselves."""
    small = F.filter(bins, lambda c: (c["w"] > 0) & (c["w"] < total * LEAST_SHARE))
    found = cleared(groups(small), total)
    return F.filter(found, lambda c: ~F.exists(large, lambda s: apart(s, c) < MERGE))


def representative(bins: Column, total: Column, n: int) -> Column:
    """array<struct<c, accent>>: up to two nearly black or white bins, then the best coloured ones that are unlike each other, `n`
    in all, and up to two saturated accents unlike everything; by weight, accents last."""
    return bound(heavy(cleared(bins, total)), lambda large: bound(F.slice(F.filter(large, anchor), 1, 2), lambda fixed: among(bins, large, fixed, total, n)))


def among(bins: Column, large: Column, fixed: Column, total: Column, n: int) -> Column:
    """`representative` from the bins that are heavy enough and the nearly black or white ones of these, both computed by now."""
    others = F.array_except(large, fixed)
    unlike = lambda least: lambda acc, c: ~F.exists(acc, lambda p: unlikeness(p, c) < least)
    plain = taken(F.filter(by_worth(others), colored), fixed, F.lit(n), unlike(1.0))
    strong = by_worth(F.filter(accents(bins, large, total), lambda c: colored(c) & (c["s"] >= ACCENT_SAT)))

    def add(plain: Column) -> Column:
        more = taken(strong, plain, F.size(plain) + ACCENTS, unlike(ACCENT_APART))
        marked = F.transform(heavy(F.slice(more, F.size(plain) + 1, ACCENTS)), lambda c: F.struct(c.alias("c"), F.lit(True).alias("accent")))
        return F.concat(F.transform(heavy(plain), lambda c: F.struct(c.alias("c"), F.lit(False).alias("accent"))), marked)

    return bound(plain, add)
