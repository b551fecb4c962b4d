"""Colours as columns: hex, OKLab, distance, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published OKLab matrices, rows of (r, g, b) or (l, m, s).
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.291485548))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))
# Upper bound of the hue angle in degrees, and its word.
HUES = ((20, "pink"), (45, "red"), (70, "orange"), (95, "amber"), (115, "yellow"), (160, "green"), (195, "teal"), (235, "cyan"), (275, "blue"), (310, "violet"), (340, "magenta"), (361, "pink"))
LIGHTS = ((0.25, "very dark"), (0.4, "dark"), (0.6, ""), (0.8, "light"), (9.0, "pale"))


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def rgb(hex_: Column) -> list[Column]:
    return [F.conv(F.substring(hex_, at, 2), 16, 10).cast("double") / F.lit(255.0) for at in (2, 4, 6)]


def to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / F.lit(12.92)).otherwise(F.pow((c + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def from_linear(c: Column) -> Column:
    # A negative value is on the straight part; its power would be no number.
    return F.when(c <= 0.0031308, c * F.lit(12.92)).otherwise(F.lit(1.055) * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - F.lit(0.055))


def weigh(matrix, xs: list[Column]) -> list[Column]:
    return [sum((x * F.lit(m) for m, x in zip(row[1:], xs[1:], strict=True)), xs[0] * F.lit(row[0])) for row in matrix]


def oklab(hex_: Column) -> Column:
    """struct<l, a, b> of '#RRGGBB'."""
    lms = [F.cbrt(x) for x in weigh(TO_LMS, [to_linear(c) for c in rgb(hex_)])]
    return F.struct(*[x.alias(n) for n, x in zip("lab", weigh(TO_LAB, lms), strict=True)])


def hex_of(lab: Column) -> Column:
    """'#RRGGBB' of an OKLab struct, clamped."""
    # Lambda variables bind each step once; written out, the expression would repeat itself 27 times.
    cubes = lambda x: F.struct(*[F.pow(c, F.lit(3.0)).alias(n) for n, c in zip("lms", weigh(FROM_LAB, [x["l"], x["a"], x["b"]]), strict=True)])
    light = lambda x: F.array(*weigh(FROM_LMS, [x["l"], x["m"], x["s"]]))
    byte = lambda c: F.lpad(F.hex(half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), from_linear(c))) * 255).cast("long")), 2, "0")
    parts = F.transform(F.flatten(F.transform(F.transform(F.array(lab), cubes), light)), byte)
    return F.concat(F.lit("#"), F.array_join(parts, ""))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(sum(((x[n] - y[n]) * (x[n] - y[n]) for n in "ab"), (x["l"] - y["l"]) * (x["l"] - y["l"])))


def chroma(lab: Column) -> Column:
    return F.sqrt(lab["a"] * lab["a"] + lab["b"] * lab["b"])


def hue(lab: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(lab["b"], lab["a"])) + 360, F.lit(360.0))


def bound(x: Column, f) -> Column:
    """f(x) with x computed once: a long expression would be written out at each use."""
    return F.element_at(F.transform(F.array(x), f), 1)


def tone_name(lab: Column) -> Column:
    return bound(lab, lambda x: bound(F.struct(hue(x).alias("h"), chroma(x).alias("c")), tone_of))


def tone_of(x: Column) -> Column:
    h = x["h"]
    return F.when(x["c"] < 0.03, "neutral").when((h >= 15) & (h < 110), "warm").when((h >= 110) & (h < 175), "green").when((h >= 175) & (h < 300), "cool").otherwise("magenta")


def steps(x: Column, table) -> Column:
    out = F.lit(table[-1][1])
    for bound, word in reversed(table[:-1]):
        out = F.when(x < bound, word).otherwise(out)
    return out


def color_name(lab: Column) -> Column:
    return bound(lab, name_of)


def name_of(lab: Column) -> Column:
    light, c = steps(lab["l"], LIGHTS), chroma(lab)
    gray = F.when(lab["l"] < 0.2, "black").when(lab["l"] > 0.9, "white").otherwise(F.trim(F.concat(light, F.lit(" gray"))))
    muted = F.when(c < 0.07, "muted").otherwise("")
    named = F.array_join(F.filter(F.array(light, muted, steps(hue(lab), HUES)), lambda w: w != ""), " ")
    return F.when(c < 0.03, gray).otherwise(named)


def luminance(hex_: Column) -> Column:
    r, g, b = (to_linear(c) for c in rgb(hex_))
    return r * F.lit(0.2126) + g * F.lit(0.7152) + b * F.lit(0.0722)


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + F.lit(0.05)) / (F.least(la, lb) + F.lit(0.05))


def text_on(hex_: Column) -> Column:
    """Which of near-black and near-white text contrasts more with the colour."""
    return F.when(contrast(hex_, F.lit("#111111")) >= contrast(hex_, F.lit("#F4F4F4")), "#111").otherwise("#f4f4f4")


def luma709(hex_: Column) -> Column:
    r, g, b = rgb(hex_)
    return r * F.lit(0.2126) + g * F.lit(0.7152) + b * F.lit(0.0722)


def saturation(hex_: Column) -> Column:
    """Of HSV."""
    r, g, b = rgb(hex_)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, (top - low) / top).otherwise(F.lit(0.0))
