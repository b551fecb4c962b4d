"""Evidence of several providers fused into label fields: tags, counts of people, what fields imply of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.functions.labels import people_bucket
from stillwater.operators.keep import few

#: Cuts of a tag's score, the scene's fields with one of their own, what a corroborating tag adds.
CUT, SCENE_CUT, SCENE = 0.35, 0.2653, ("setting", "time", "weather")
CORROBORATION = 0.05
#: Tags that count people, and least numbers of the counted words.
GIRLS = {"1girl": 1, "2girls": 2, "3girls": 3, "4girls": 4, "5girls": 5, "6+girls": 6}
BOYS = {"1boy": 1, "2boys": 2, "3boys": 3, "6+boys": 6}
FLOORS = {"zero": 0, "one": 1, "two": 2, "small-group": 3, "crowd": 6}
#: Weight of a count summed from two kinds, of a couple, of a split between providers, of an implied field, and trust in faces.
MIXED, COUPLE, SPLIT, IMPLIED, FACES = 0.85, 0.8, 0.7, 0.8, 0.7


def four(x: Column) -> Column:
    return F.bround(x, 4)


def fuse(tags: DataFrame, mapping: DataFrame, cut: float = CUT, scene_cut: float = SCENE_CUT) -> DataFrame:
    """id, field, value, score, tags: the best value of each field from the tags that map to it.

    A value needs a primary tag; it scores what its best tag does, a little more for each corroborating one, 1 at most. The
    highest value wins (of equals the greater name) and keeps what it is ahead of the next by. People are counted, not
    chosen, so their field is left to `people`. tags: id, tag, score; mapping: tag, field, value, primary.
    """
    hits = tags.join(few(mapping), "tag").where((F.col("field") != "people") & (F.col("score") >= F.when(F.col("field").isin(*SCENE), scene_cut).otherwise(cut)))
    values = hits.groupBy("id", "field", "value").agg(
        F.max("score").alias("best"), F.count_if(~F.col("primary")).alias("more"), F.bool_or("primary").alias("named"), F.array_sort(F.collect_list("tag")).alias("tags")
    ).where("named")
    s = F.least(F.lit(1.0), F.col("best") + F.col("more") * F.lit(CORROBORATION))
    ranked = values.groupBy("id", "field").agg(F.sort_array(F.collect_list(F.struct(s.alias("s"), "value", "tags")), asc=False).alias("r"))
    top, second = F.col("r")[0], F.get("r", F.lit(1))
    ahead = F.when(second.isNull(), top["s"]).otherwise(F.greatest(F.lit(0.0), top["s"] - second["s"]))
    return ranked.select("id", "field", top["value"].alias("value"), four(ahead).alias("score"), top["tags"].alias("tags"))


def people(tags: DataFrame, cut: float = CUT) -> DataFrame:
    """id, value, score: how many people the counting tags say, girls and boys added up; no row where none fired.

    Outright statements (nobody, a crowd, alone) come before sums, a couple after them. A tag may come in several rows, of which
    the best counts; tags that count nobody go before anything is grouped.
    """
    tags = tags.where(F.col("tag").isin("no_humans", "crowd", "solo", "couple", *GIRLS, *BOYS) & (F.col("score") >= cut))
    at = {t: F.max(F.when((F.col("tag") == t) & (F.col("score") >= cut), F.col("score"))) for t in ("no_humans", "crowd", "solo", "couple", *GIRLS, *BOYS)}
    seen = tags.groupBy("id").agg(*[c.alias(t) for t, c in at.items()])
    col = lambda t: F.col(f"`{t}`")
    most = lambda counts: F.greatest(F.lit(0), F.lit(0), *[F.when(col(t).isNotNull(), n) for t, n in counts.items()])
    girls, boys = most(GIRLS), most(BOYS)
    least = F.least(*[col(t) for t in (*GIRLS, *BOYS)])
    said = lambda v, s: F.struct(v.alias("value"), four(s).alias("score"))
    word = lambda v, t, k=1.0: F.when(col(t).isNotNull(), said(F.lit(v), col(t) * k))
    summed = F.when(girls + boys > 0, said(people_bucket(girls + boys), least * F.when((girls > 0) & (boys > 0), MIXED).otherwise(1.0)))
    verdict = F.coalesce(word("zero", "no_humans"), word("crowd", "crowd"), word("one", "solo"), summed, word("two", "couple", COUPLE))
    return seen.select("id", verdict.alias("p")).where("p IS NOT NULL").select("id", "p.value", "p.score")


def with_faces(counted: DataFrame, faces: DataFrame) -> DataFrame:
    """id, value, score, tagger, inconsistent: the tagger's count and the number of faces as one; faces are a floor.

    counted: id, value, score of `people`; faces: id, faces.
    """
    both = counted.select("id", F.col("value").alias("tagger"), F.col("score").alias("s")).join(faces.select("id", "faces"), "id", "full").where("tagger IS NOT NULL OR faces IS NOT NULL")
    floor = F.coalesce(*[F.when(F.col("tagger") == v, n) for v, n in FLOORS.items()])
    seen, fused = people_bucket(F.col("faces")), people_bucket(F.greatest(F.col("faces"), floor))
    split = F.col("faces").isNotNull() & F.col("tagger").isNotNull() & (seen != F.col("tagger"))
    score = F.when(split, F.least("s", F.lit(FACES)) * SPLIT).otherwise(F.greatest("s", F.lit(FACES)))
    return both.select(
        "id", F.when(F.col("faces").isNull(), F.col("tagger")).when(F.col("tagger").isNull(), seen).otherwise(fused).alias("value"),
        F.when(F.col("faces").isNull(), F.col("s")).when(F.col("tagger").isNull(), F.lit(FACES)).otherwise(four(score)).alias("score"),
        F.coalesce("tagger", F.lit("abstain")).alias("tagger"), split.alias("inconsistent"),
    )


def cross_field(fields: DataFrame, tags: DataFrame, cut: float = SCENE_CUT) -> DataFrame:
    """id, field, value, score with what the tags imply together: a setting is mixed where inside and outside both fired,
    and an interior without any weather shows none."""
    at = lambda t: F.max(F.when(F.col("tag") == t, F.col("score")))
    sides = tags.groupBy("id").agg(at("indoors").alias("a"), at("outdoors").alias("b")).where((F.col("a") >= cut) & (F.col("b") >= cut))
    mixed = sides.select("id", F.lit("setting").alias("field"), F.lit("mixed").alias("value"), four(F.least("a", "b")).alias("score"))
    rest = fields.select("id", "field", "value", "score").join(mixed, ["id", "field"], "left_anti").unionByName(mixed)
    inside = rest.where("field = 'setting' AND value = 'interior'").join(rest.where("field = 'weather'"), "id", "left_anti")
    return rest.unionByName(inside.select("id", F.lit("weather").alias("field"), F.lit("none-visible").alias("value"), four(F.col("score") * IMPLIED).alias("score")))


def assemble(candidates: DataFrame, tags: DataFrame, faces: DataFrame, figures: DataFrame, angles: DataFrame, quality: DataFrame, cut: float = CUT) -> DataFrame:
    """A candidate with all that providers say of it; each may be missing. At most one row a candidate in faces, figures, angles and quality.

    candidates: id, shot, width, symmetry, entropy; tags: id, tag, score; faces: id, faces, largest; figures: id, head
    (height of the largest head); angles: id, angle, score; quality: id, symmetry, entropy, which come before the candidate's own.
    """
    tagged = tags.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("tags"))
    out = candidates.alias("c").join(tagged, "id", "left").join(faces.select("id", "faces", "largest"), "id", "left").join(figures.select("id", "head"), "id", "left")
    out = out.join(angles.select("id", "angle", F.col("score").alias("angle_score")), "id", "left").join(quality.select("id", F.col("symmetry").alias("_s"), F.col("entropy").alias("_e"), F.lit(True).alias("_q")), "id", "left")
    own = lambda q, c: F.when(F.col("_q"), F.col(q)).otherwise(F.col(f"c.{c}"))
    scenery = F.coalesce(F.try_element_at("tags", F.lit("scenery")) >= cut, F.lit(False))
    return out.select("id", "c.shot", "c.width", "tags", scenery.alias("scenery"), "faces", "largest", "head", "angle", "angle_score", own("_s", "symmetry").alias("symmetry"), own("_e", "entropy").alias("entropy"))


def facets(proposals: DataFrame) -> DataFrame:
    """id, facets, sources, suggestion of proposals: labels that abstain go, and a shot size that only a head gave is a suggestion.

    proposals: id, labels (map of field to value), fields (map of field to struct<source, score>), lane (of the shot size,
    from before fields had sources).
    """
    source = F.coalesce(F.try_element_at("fields", F.lit("shot_scale"))["source"], F.col("lane"))
    said = F.map_filter("labels", lambda k, v: v.isNotNull() & (v != "") & (v != "abstain"))
    only_head = F.coalesce((source == "head-height") & F.map_contains_key(said, F.lit("shot_scale")), F.lit(False))
    rows = proposals.withColumns({"said": said, "_head": only_head})
    out = rows.withColumn("facets", F.map_filter("said", lambda k, v: ~(F.col("_head") & (k == "shot_scale"))))
    known = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,struct<source:string,score:double>>")), lambda k, f: F.map_contains_key(F.col("facets"), k) & f["source"].isNotNull() & (f["source"] != "none"))
    lane = F.create_map(F.lit("shot_scale"), F.struct(F.col("lane").alias("source"), F.lit(None).cast("double").alias("score")))
    bare = F.map_contains_key("facets", F.lit("shot_scale")) & ~F.map_contains_key(known, F.lit("shot_scale")) & F.col("lane").isNotNull()
    sources = F.when(bare, F.map_concat(known, lane)).otherwise(known)
    return out.select("id", "facets", F.when(F.size(sources) > 0, sources).alias("sources"), F.when(F.col("_head"), F.col("said")["shot_scale"]).alias("suggestion"))


def coverage(scores: DataFrame) -> DataFrame:
    """family, backed: the share of proposals in which a family scores above 0. scores: id, family, score."""
    total = scores.agg(F.count_distinct("id").alias("all"))
    each = scores.groupBy("family").agg(F.count_if(F.col("score") > 0).alias("n"))
    return each.join(F.broadcast(total)).select("family", four(F.col("n") / F.col("all")).alias("backed"))  # one row


def zero_shot(similarities: DataFrame) -> DataFrame:
    """id, family, label, score: the mean similarity over a label's paraphrases. similarities: id, family, label, phrase, similarity."""
    return similarities.groupBy("id", "family", "label").agg(F.avg("similarity").alias("score"))
