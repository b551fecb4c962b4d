"""Label rules as columns: colour, people, shot size, composition, review reasons, quality floor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WARM, COOL = (0, 1, 2, 7), (4, 5, 6)  # hue bands; band 3 (green) is neither
#: Shares of the frame from which a face, and of its height from which a head, is that near.
FACE_CUTS, HEAD_CUTS = ((0.14, "close-up"), (0.009, "medium")), ((0.72, "close-up"), (0.19, "medium"))


def four(x: Column) -> Column:
    """Rounded to four places, halves to even."""
    return F.bround(x, 4)


def one_at_most(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def color_bias(bands: Column, saturation: Column) -> Column:
    """struct<value, score>; bands: array of eight shares."""
    warm = sum((bands[k] for k in WARM[1:]), bands[WARM[0]])
    cool = sum((bands[k] for k in COOL[1:]), bands[COOL[0]])
    lean = warm - cool
    said = lambda v, s: F.struct(F.lit(v).alias("value"), s.alias("score"))
    return (
        F.when(saturation < 0.12, said("monochrome", F.lit(0.6)))
        .when((warm >= 0.25) & (cool >= 0.25), said("mixed", four(F.least(warm, cool) / 0.25 * 0.5)))
        .when(lean >= 0.35, said("warm", four(one_at_most(F.abs(lean)))))
        .when(lean <= -0.35, said("cool", four(one_at_most(F.abs(lean)))))
        .otherwise(said("neutral", four(1 - F.abs(lean) / 0.35)))
    )


def saturation_word(value: Column) -> Column:
    return F.when(value < 0.3, "muted").when(value > 0.6, "vivid").otherwise("balanced")


def lighting(mean: Column, p05: Column, p95: Column) -> Column:
    return F.when((mean < 0.3) & (p95 < 0.75), "low-key").when((mean > 0.65) & (p05 > 0.3), "high-key").otherwise("abstain")


def people_bucket(n: Column) -> Column:
    return F.when(n <= 0, "zero").when(n == 1, "one").when(n == 2, "two").when(n <= 5, "small-group").otherwise("crowd")


def by_cuts(x: Column, cuts) -> Column:
    return F.when(x >= cuts[0][0], cuts[0][1]).when(x >= cuts[1][0], cuts[1][1]).otherwise("wide")


def near_cut(x: Column, cuts, log: bool) -> Column:
    far = [F.abs(F.log10(x) - F.log10(F.lit(c))) < 0.15 if log else F.abs(x - c) < 0.05 for c, _ in cuts]
    return far[0] | far[1]


def shot_scale(tag: Column, tag_score: Column, face: Column, scenery: Column, head: Column) -> Column:
    """struct<value, score, lane> of the first lane with an answer: tagger, face size, scenery, head height."""
    said = lambda v, s, lane: F.struct(v.alias("value"), s.alias("score"), F.lit(lane).alias("lane"))
    return (
        F.when(~tag.isin("abstain", "unknown"), said(tag, tag_score, "tagger"))
        .when(face > 0, said(by_cuts(face, FACE_CUTS), F.when(near_cut(face, FACE_CUTS, True), 0.35).otherwise(0.55), "face-occupancy"))
        .when(scenery, said(F.lit("wide"), F.lit(0.3), "scenery"))
        .when(head > 0, said(by_cuts(head, HEAD_CUTS), F.when(near_cut(head, HEAD_CUTS, False), 0.25).otherwise(0.3), "head-height"))
        .otherwise(said(F.lit("abstain"), F.lit(0.0), "none"))
    )


def largest_box_x(boxes: Column, width: float) -> Column:
    """Centre of the largest box as a share of the width. boxes: array<struct<x0, y0, x1, y1>>."""
    area = lambda b: F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])
    best = F.array_max(F.transform(boxes, lambda b: F.struct(area(b).alias("a"), ((b["x0"] + b["x1"]) / 2 / width).alias("x"))))
    return F.when(best["a"] > 0, best["x"])


def composition(text: Column, entropy: Column, symmetrical: Column, x: Column) -> Column:
    """Cards first, since type on a flat field mirrors itself; then symmetry; then where the subject stands."""
    third = F.least(F.abs(x - 1 / 3), F.abs(x - 2 / 3)) <= 0.06
    return F.when(text & (entropy < 3.0), "abstain").when(symmetrical, "symmetrical").when(F.abs(x - 0.5) <= 0.06, "centered").when(third, "rule-of-thirds").otherwise("abstain")


#: Where the floor lies.
FLOOR = {"dark": 0.10, "bright": 0.90, "least_detail": 0.005, "least_entropy": 2.5, "blank": 0.005}


def quality_floor(luma: Column, spread: Column, detail: Column, entropy: Column, dark=FLOOR["dark"], bright=FLOOR["bright"], least_detail=FLOOR["least_detail"], least_entropy=FLOOR["least_entropy"], blank=FLOOR["blank"]) -> Column:
    """cleared, blank or review: questioned only if nearly black or white and featureless too."""
    extreme = (luma <= dark) | (luma >= bright)
    plain = (detail < least_detail) | (entropy < least_entropy)
    return F.when(~(extreme & plain), "cleared").when(spread <= blank, "blank").otherwise("review")


def review_reasons(text_tags: Column, rating: Column, scene: Column, scene_score: Column, scale: Column, scale_score: Column, lane: Column, agrees: Column) -> Column:
    """Kinds of reason to look at a still."""
    known = scale != "abstain"
    weak = F.when(known & (scale_score < 0.35), F.when(lane == "head-height", "head").otherwise("scale")).when(known & ~agrees, "split")
    return F.array_compact(F.array(F.when(F.size(text_tags) > 0, "text"), F.when(rating >= 0.1, "rating"), F.when((scene != "abstain") & (scene_score < 0.35), "unsure"), weak))


def tier_widths(width: Column, tiers=(320, 640, 960, 1920)) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.array(*map(F.lit, tiers)), lambda w: F.least(w, width))))


def tier_height(width: Column, height: Column, tier: Column) -> Column:
    return F.when(tier == width, height).otherwise(F.greatest(F.lit(1), F.bround(height * tier / width)).cast("int"))


def publish_budget(shots: Column, share: float = 0.15, more: float = 1.1) -> Column:
    return F.greatest(F.lit(35), F.least(F.lit(300), F.bround(shots * F.lit(share) * F.lit(more)).cast("int")))
