"""Label proposals: what each field of a candidate says, who says it and how surely, from the evidence of all providers.

Rules are a table: each field has sources in order of precedence, the first with an answer counts. So fields and scores are
one projection of a row, without joins. A field without an answer abstains with source 'none' and score 0.

Evidence, one row a candidate: id; wd (whether the tagger ran); tags (map of field to struct value, score); angle (struct
value, score of the camera classifier, or null); card (a text-only card); scale (struct value, score, lane); head (the
shot size that a head says, or null); composition (struct value, score, basis); faces (number, or null); people (struct
value, score, tagger, inconsistent); palette (struct lighting, lighting_score, color_bias, color_bias_score, saturation,
saturation_score); quality (struct value, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.functions.labels import four

ABSTAIN = "abstain"
#: How an id must look, and sizes that count as their neighbour when a head is asked.
OPAQUE_ID = "^[a-z]+-[a-z0-9][a-z0-9-]{2,63}$"
NEIGHBOUR = {"extreme-close-up": "close-up", "extreme-wide": "wide"}
#: Labels and dispositions of quality.
QUALITY = ("usable", "text-only-card", "prominent-text-overlay", "transition-interstitial", "visually-redundant-composition", "technical-defect", "unknown", "abstain")
DISPOSITION = ("accept", "reject", "review")


def tag(field: str, part: str = "value") -> Column:
    """What the tagger says of a field; null where it didn't run or abstains."""
    t = F.try_element_at("tags", F.lit(field))
    return F.when(F.col("wd") & (t["value"] != ABSTAIN), t[part])


def palette(part: str) -> Column:
    return F.when(F.col(f"palette.{part}") != ABSTAIN, F.col(f"palette.{part}"))


#: Field: (source, value or null, score) in order of precedence.
def rules() -> dict[str, list[tuple[Column | str, Column, Column]]]:
    tagged = lambda f: ("tagger", tag(f), tag(f, "score"))
    weather, mono = tag("weather"), tag("color_bias")
    no_camera = F.col("wd") & F.col("card")
    has_angle = F.col("angle").isNotNull()
    both = F.when(F.col("faces").isNotNull() & ~F.col("people.inconsistent"), "tagger+faces").otherwise("tagger")
    own_count = F.col("faces").isNull() | (F.col("people.tagger") == F.col("people.value"))
    answer = lambda c: F.when(F.col(f"{c}.value") != ABSTAIN, F.col(f"{c}.value"))
    return {
        "setting": [tagged("setting")],
        "time": [tagged("time")],
        "weather": [("interior-rule", F.when(weather == "none-visible", weather), tag("weather", "score")), tagged("weather")],
        "angle": [("angle-classifier", F.when(has_angle & ~no_camera, F.col("angle.value")), F.col("angle.score")), ("tagger", F.when(~has_angle, tag("angle")), tag("angle", "score"))],
        "shot_scale": [(F.col("scale.lane"), answer("scale"), F.col("scale.score"))],
        "composition": [(F.col("composition.basis"), F.when(F.col("wd"), answer("composition")), F.col("composition.score"))],
        "people": [(both, F.when(own_count, answer("people")), F.col("people.score")), ("faces", answer("people"), F.col("people.score"))],
        "lighting": [tagged("lighting"), ("palette", palette("lighting"), F.col("palette.lighting_score"))],
        "color_bias": [("tagger", F.when(mono == "monochrome", mono), tag("color_bias", "score")), ("palette", palette("color_bias"), F.col("palette.color_bias_score"))],
        "saturation": [("palette", palette("saturation"), F.col("palette.saturation_score"))],
    }


def said(sources: list[tuple[Column | str, Column, Column]]) -> Column:
    """struct<value, source, score> of a field from its sources, unrounded."""
    lit = lambda s: F.lit(s) if isinstance(s, str) else s
    found = [F.when(value.isNotNull(), F.struct(value.alias("value"), lit(source).alias("source"), score.cast("double").alias("score"))) for source, value, score in sources]
    return F.coalesce(*found, F.struct(F.lit(ABSTAIN).alias("value"), F.lit("none").alias("source"), F.lit(0.0).alias("score")))


def with_said(evidence: DataFrame, names: list[str]) -> DataFrame:
    """evidence with a column _name for each field; a generator's columns are computed once, however often they are used."""
    table = rules()
    return evidence.select("*", F.inline(F.array(F.struct(*[said(table[name]).alias(f"_{name}") for name in names]))))


def fields(evidence: DataFrame) -> DataFrame:
    """id, fields: map of field to struct<value, source, score, head, agrees>; head and agrees where a head speaks beside a face."""
    beside = (F.col("scale.lane") == "face-occupancy") & F.col("head").isNotNull() & (F.col("scale.value") != ABSTAIN)
    size = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NEIGHBOUR.items() for x in kv]), F.col("scale.value")), F.col("scale.value"))

    def entry(name: str) -> Column:
        own = name == "shot_scale"
        second = (F.when(beside, F.col("head")), F.when(beside, size == F.col("head"))) if own else (F.lit(None).cast("string"), F.lit(None).cast("boolean"))
        x = F.col(f"_{name}")
        return F.struct(x["value"].alias("value"), x["source"].alias("source"), four(x["score"]).alias("score"), second[0].alias("head"), second[1].alias("agrees"))

    names = list(rules())
    rows = with_said(evidence, names)
    return rows.select("id", F.map_from_entries(F.array(*[F.struct(F.lit(name).alias("key"), entry(name).alias("value")) for name in names])).alias("fields"))


def best(pairs: list[tuple[Column, Column]]) -> Column:
    """struct<label, score> of the highest score, the first of equals."""
    rated = F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-k).alias("k"), v.alias("label")) for k, (v, s) in enumerate(pairs)])
    top = F.array_max(rated)
    return F.struct(top["label"].alias("label"), top["score"].alias("score"))


def scores(evidence: DataFrame) -> DataFrame:
    """id, family, label, score: each family's best label. Colour and light score the mean of what backs them, and abstentions
    don't pull it down."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tagged = lambda f: (F.coalesce(tag(f), F.lit(ABSTAIN)), zero(tag(f, "score")))
    rows = with_said(evidence, ["angle", "lighting", "color_bias", "saturation"])
    backed = [
        (F.col("_color_bias.value"), F.greatest(F.col("palette.color_bias_score"), zero(tag("color_bias", "score")))),
        (F.col("_saturation.value"), F.col("palette.saturation_score")),
        (F.col("_lighting.value"), F.greatest(F.col("palette.lighting_score"), zero(tag("lighting", "score")))),
    ]
    n = sum((F.when(s > 0, 1).otherwise(0) for _, s in backed[1:]), F.when(backed[0][1] > 0, 1).otherwise(0))
    total = sum((F.when(s > 0, s).otherwise(0.0) for _, s in backed[1:]), F.when(backed[0][1] > 0, backed[0][1]).otherwise(0.0))
    light = F.struct(F.when(n > 0, best(backed)["label"]).otherwise(ABSTAIN).alias("label"), F.when(n > 0, total / n).otherwise(0.0).alias("score"))
    plain = lambda c: F.struct(F.col(f"{c}.value").alias("label"), F.col(f"{c}.score").cast("double").alias("score"))
    families = {
        "setting-time-weather": best([tagged(f) for f in ("setting", "time", "weather")]), "lighting-color-character": light, "shot-scale": plain("scale"),
        "angle-composition": plain("_angle"), "people": plain("people"), "quality": plain("quality"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("family"), v["label"].alias("label"), four(v["score"]).alias("score")) for k, v in families.items()])
    return rows.select("id", F.inline(each))


def refused(evidence: DataFrame) -> DataFrame:
    """id, problem of rows that can't be proposals. Rows: id, quality (labels), disposition."""
    bad = F.exists("quality", lambda q: ~q.isin(*QUALITY))
    said = [F.when(F.col("id").isNull() | ~F.col("id").rlike(OPAQUE_ID), "not an opaque id"), F.when(bad, "not a quality value"), F.when(~F.col("disposition").isin(*DISPOSITION), "invalid selection disposition")]
    return evidence.select("id", F.explode(F.array_compact(F.array(*said))).alias("problem"))
