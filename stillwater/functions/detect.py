"""Detections as arrays of structs score, x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stillwater.functions.color import bound


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    """Overlap of boxes whose far edges count as pixels of their own."""
    side = lambda x: (x["x1"] - x["x0"] + 1) * (x["y1"] - x["y0"] + 1)
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]) + 1)
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]) + 1)
    return w * h / (side(a) + side(b) - w * h)


def suppress(boxes: Column, most: float = 0.7) -> Column:
    """Boxes from the best score down, each kept unless it overlaps one kept before by more than `most`."""
    ranked = F.array_sort(boxes, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0))
    none = F.slice(ranked, 1, 0)
    return F.aggregate(ranked, none, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > most), kept).otherwise(F.concat(kept, F.array(b))))


def largest(boxes: Column) -> Column:
    """The box of largest area; of equal ones the better score."""
    best = F.array_max(F.transform(boxes, lambda b: F.struct(area(b).alias("a"), b["score"].alias("s"), b.alias("b"))))
    return best["b"]


def over_centre(heads: Column, face: Column) -> Column:
    """The best-scored head box that covers the face's centre."""
    middle = bound(face, lambda f: F.struct(((f["x0"] + f["x1"]) / 2).alias("x"), ((f["y0"] + f["y1"]) / 2).alias("y")))
    cover = bound(middle, lambda m: F.filter(heads, lambda h: m["x"].between(h["x0"], h["x1"]) & m["y"].between(h["y0"], h["y1"])))
    return F.array_max(F.transform(cover, lambda h: F.struct(h["score"].alias("s"), h.alias("b"))))["b"]
