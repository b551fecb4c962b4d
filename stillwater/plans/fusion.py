"""Queries of fused evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.operators import fusion as fu
from stillwater.plans.registry import query
from stillwater.sources.tables import stills, table, with_views

MAPPED = (("that", "setting", "interior", True), ("thth", "setting", "interior", False), ("with", "setting", "exterior", True), ("from", "time", "night", True), ("this", "time", "day", True), ("para", "shot_scale", "wide", True), ("have", "shot_scale", "wide", False), ("they", "shot_scale", "medium", True))
MAP_SQL = ", ".join(map(str, MAPPED))


def fused_sql(hit: str, mapping: str) -> str:
    return f"""{hit}, m(t, field, value, prim) AS (VALUES {mapping}),
c AS (SELECT id, t, score, field, value, prim FROM hit JOIN m USING (t) WHERE score >= CASE WHEN field IN ('setting', 'time', 'weather') THEN 0.2653e0 ELSE 0.35e0 END),
v AS (SELECT id, field, value, max(score) AS best, count(*) FILTER (WHERE NOT prim) AS more, string_agg(t, ',' ORDER BY t) AS tags FROM c GROUP BY id, field, value HAVING bool_or(prim)),
s AS (SELECT *, least(1e0, best + 0.05e0 * more) AS s FROM v),
r AS (SELECT *, row_number() OVER w AS r, lead(s) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY id, field ORDER BY s DESC, value DESC)),
fused AS (SELECT id, field, value, round_even(CASE WHEN nxt IS NULL THEN s ELSE greatest(0e0, s - nxt) END, 4) AS score, tags FROM r WHERE r = 1)"""


@query(fused_sql(with_views("still", "tag") + ", hit AS (SELECT id, t, (id * 7 + ascii(t) * 5 + ascii(substr(t, 3, 1)) * 11) % 90 / 100e0 + 0.1e0 AS score FROM tag)", MAP_SQL) + " SELECT * FROM fused")
def tag_fusion(spark, sf):
    words = F.array(*[F.lit(w[0]) for w in MAPPED])
    t = stills(spark, sf, tags=True).select("id", F.explode(F.array_intersect("tags", words)).alias("tag"))
    score = (F.col("id") * 7 + F.ascii("tag") * 5 + F.ascii(F.substring("tag", 3, 1)) * 11) % 90 / F.lit(100.0) + F.lit(0.1)
    mapping = spark.createDataFrame(MAPPED, "tag string, field string, value string, primary boolean")
    return fu.fuse(t.withColumn("score", score), mapping).withColumn("tags", F.array_join("tags", ","))


TAGS = ("indoors", "outdoors", "window", "rain", "night", "day", "1girl", "2girls", "6+girls", "1boy", "3boys", "solo", "crowd", "no_humans", "couple", "scenery", "close-up", "portrait", "full_shot")
SCENES = (("indoors", "setting", "interior", True), ("outdoors", "setting", "exterior", True), ("window", "setting", "interior", False), ("rain", "weather", "rain", True), ("night", "time", "night", True), ("day", "time", "day", True), ("close-up", "shot_scale", "close-up", True), ("portrait", "shot_scale", "close-up", False), ("full_shot", "shot_scale", "wide", True))
SEEN = f"""WITH hit AS (SELECT l_orderkey AS id, [{", ".join(f"'{t}'" for t in TAGS)}][l_partkey % {len(TAGS)} + 1] AS t, max(l_suppkey * 37 % 51 / 50e0) AS score FROM lineitem GROUP BY 1, 2)"""


def said(spark, sf):
    """The lines of an order as what is said of a frame's tags, some more than once."""
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("l_partkey") % len(TAGS) + 1).cast("int"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), tag.alias("tag"), (F.col("l_suppkey") * 37 % 51 / F.lit(50.0)).alias("score"))


def seen(spark, sf):
    """A frame's tags, each with its best score."""
    return said(spark, sf).groupBy("id", "tag").agg(F.max("score").alias("score"))


def faces(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").where(k % 3 != 0).select(k.alias("id"), (k % 7).cast("int").alias("faces"), (k % 50 / F.lit(100.0)).alias("largest"))


BUCKET = "CASE WHEN {0} <= 0 THEN 'zero' WHEN {0} = 1 THEN 'one' WHEN {0} = 2 THEN 'two' WHEN {0} <= 5 THEN 'small-group' ELSE 'crowd' END"
COUNT_SQL = SEEN + f""", f AS (SELECT * FROM hit WHERE score >= 0.35e0),
n(t, girls, boys) AS (VALUES ('1girl', 1, 0), ('2girls', 2, 0), ('6+girls', 6, 0), ('1boy', 0, 1), ('3boys', 0, 3)),
p AS (SELECT f.id, max(score) FILTER (WHERE f.t = 'no_humans') AS nobody, max(score) FILTER (WHERE f.t = 'crowd') AS crowd, max(score) FILTER (WHERE f.t = 'solo') AS solo, max(score) FILTER (WHERE f.t = 'couple') AS couple,
  coalesce(max(girls), 0) AS g, coalesce(max(boys), 0) AS b, min(score) FILTER (WHERE n.t IS NOT NULL) AS s FROM f LEFT JOIN n ON n.t = f.t GROUP BY f.id),
counted AS (SELECT id, CASE WHEN nobody IS NOT NULL THEN 'zero' WHEN crowd IS NOT NULL THEN 'crowd' WHEN solo IS NOT NULL THEN 'one' WHEN g + b > 0 THEN {BUCKET.format("(g + b)")} WHEN couple IS NOT NULL THEN 'two' END AS value,
  round_even(CASE WHEN nobody IS NOT NULL THEN nobody WHEN crowd IS NOT NULL THEN crowd WHEN solo IS NOT NULL THEN solo WHEN g + b > 0 THEN s * CASE WHEN g > 0 AND b > 0 THEN 0.85e0 ELSE 1e0 END ELSE couple * 0.8e0 END, 4) AS score FROM p)"""


@query(COUNT_SQL + f""", x AS (SELECT coalesce(c.id, o.o_orderkey) AS id, c.value AS tagger, c.score AS s, CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_orderkey % 7 END AS faces
  FROM (SELECT * FROM counted WHERE value IS NOT NULL) c FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) o ON o.o_orderkey = c.id),
y AS (SELECT *, {BUCKET.format("faces")} AS seen, {BUCKET.format("greatest(faces, CASE tagger WHEN 'one' THEN 1 WHEN 'two' THEN 2 WHEN 'small-group' THEN 3 WHEN 'crowd' THEN 6 ELSE 0 END)")} AS fused FROM x)
SELECT id, CASE WHEN faces IS NULL THEN tagger WHEN tagger IS NULL THEN seen ELSE fused END AS value,
 CASE WHEN faces IS NULL THEN s WHEN tagger IS NULL THEN 0.7e0 WHEN seen <> tagger THEN round_even(least(s, 0.7e0) * 0.7e0, 4) ELSE round_even(greatest(s, 0.7e0), 4) END AS score,
 coalesce(tagger, 'abstain') AS tagger, faces IS NOT NULL AND tagger IS NOT NULL AND seen <> tagger AS inconsistent FROM y""")
def people_fusion(spark, sf):
    return fu.with_faces(fu.people(said(spark, sf)), faces(spark, sf))


@query(fused_sql(SEEN, ", ".join(map(str, SCENES))) + """, sides AS (SELECT id, max(score) FILTER (WHERE t = 'indoors') AS a, max(score) FILTER (WHERE t = 'outdoors') AS b FROM hit GROUP BY id),
mixed AS (SELECT id, 'setting' AS field, 'mixed' AS value, round_even(least(a, b), 4) AS score FROM sides WHERE a >= 0.2653e0 AND b >= 0.2653e0),
rest AS (SELECT id, field, value, score FROM fused WHERE NOT (field = 'setting' AND id IN (SELECT id FROM mixed)) UNION ALL SELECT * FROM mixed)
SELECT * FROM rest UNION ALL SELECT id, 'weather', 'none-visible', round_even(score * 0.8e0, 4) FROM rest WHERE field = 'setting' AND value = 'interior' AND id NOT IN (SELECT id FROM rest WHERE field = 'weather')""")
def cross_field(spark, sf):
    tags = seen(spark, sf)
    return fu.cross_field(fu.fuse(tags, spark.createDataFrame(SCENES, "tag string, field string, value string, primary boolean")), tags)


@query(SEEN + """, tagged AS (SELECT id, count(*) AS n, max(score) FILTER (WHERE t = 'scenery') AS scenery FROM hit GROUP BY id)
SELECT o_orderkey AS id, o_custkey AS shot, coalesce(n, 0) AS tags, coalesce(scenery >= 0.35e0, FALSE) AS scenery, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END AS faces, c.c_acctbal AS head,
 CASE WHEN o_orderkey % 4 = 1 THEN 'low' END AS angle, CASE WHEN o_orderkey % 5 = 2 THEN o_orderkey % 11 / 10e0 ELSE o_orderkey % 13 / 10e0 END AS symmetry
FROM orders LEFT JOIN tagged ON tagged.id = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_orderkey""")
def evidence_join(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    cands = o.select(k.alias("id"), F.col("o_custkey").alias("shot"), F.lit(1920).alias("width"), (k % 13 / F.lit(10.0)).alias("symmetry"), F.lit(1.0).alias("entropy"))
    heads = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("head"))
    angles = o.where(k % 4 == 1).select(k.alias("id"), F.lit("low").alias("angle"), F.lit(0.5).alias("score"))
    quality = o.where(k % 5 == 2).select(k.alias("id"), (k % 11 / F.lit(10.0)).alias("symmetry"), F.lit(2.0).alias("entropy"))
    rows = fu.assemble(cands, seen(spark, sf), faces(spark, sf), heads, angles, quality)
    return rows.select("id", "shot", F.coalesce(F.when(F.col("tags").isNotNull(), F.size("tags")), F.lit(0)).cast("long").alias("tags"), "scenery", "faces", "head", "angle", "symmetry")


def proposals(spark, sf):
    k = F.col("p_size")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    src = lambda s, p: F.struct(s.alias("source"), p.cast("double").alias("score"))
    labels = F.create_map(F.lit("time"), pick(3, "night", "abstain", "day"), F.lit("shot_scale"), pick(4, "wide", "medium", "abstain", "close-up"), F.lit("angle"), pick(2, "low", ""))
    fields = F.create_map(F.lit("time"), src(pick(2, "tagger", "none"), k / F.lit(100.0)), F.lit("shot_scale"), src(pick(5, "tagger", "head-height", "scenery", "face-occupancy", "head-height"), k / F.lit(50.0)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), labels.alias("labels"), F.when(k % 7 != 0, fields).alias("fields"), F.when(k % 3 != 1, pick(2, "head-height", "tagger")).alias("lane"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS k, ['night', 'abstain', 'day'][p_size % 3 + 1] AS time, ['wide', 'medium', 'abstain', 'close-up'][p_size % 4 + 1] AS scale, ['low', ''][p_size % 2 + 1] AS angle,
  CASE WHEN p_size % 7 <> 0 THEN ['tagger', 'none'][p_size % 2 + 1] END AS time_source, CASE WHEN p_size % 7 <> 0 THEN ['tagger', 'head-height', 'scenery', 'face-occupancy', 'head-height'][p_size % 5 + 1] END AS scale_source,
  CASE WHEN p_size % 3 <> 1 THEN ['head-height', 'tagger'][p_size % 2 + 1] END AS lane FROM part),
q AS (SELECT *, scale <> 'abstain' AND coalesce(scale_source, lane, '') = 'head-height' AS head FROM p),
v AS (SELECT id, 'time' AS family, time AS value, CASE WHEN time_source <> 'none' THEN time_source END AS source, CASE WHEN time_source <> 'none' THEN k / 100e0 END AS score FROM q WHERE time <> 'abstain'
 UNION ALL SELECT id, 'shot_scale', scale, coalesce(scale_source, lane), CASE WHEN scale_source IS NOT NULL THEN k / 50e0 END FROM q WHERE scale <> 'abstain' AND NOT head
 UNION ALL SELECT id, 'angle', angle, NULL, NULL FROM q WHERE angle <> ''
 UNION ALL SELECT id, 'suggestion', scale, NULL, NULL FROM q WHERE head)
SELECT * FROM v""")
def facet_sources(spark, sf):
    f = fu.facets(proposals(spark, sf))
    said = f.select("id", F.explode("facets").alias("family", "value"), "sources").withColumn("x", F.try_element_at("sources", F.col("family")))
    hint = f.where("suggestion IS NOT NULL").select("id", F.lit("suggestion").alias("family"), F.col("suggestion").alias("value"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("score"))
    return said.select("id", "family", "value", "x.source", "x.score").unionByName(hint)


@query("""WITH s AS (SELECT l_orderkey AS id, l_returnflag || l_linestatus AS family, max(l_discount) AS score FROM lineitem GROUP BY 1, 2)
SELECT family, round_even(count(*) FILTER (WHERE score > 0) / CAST((SELECT count(DISTINCT id) FROM s) AS DOUBLE), 4) AS backed FROM s GROUP BY family""")
def proposal_coverage(spark, sf):
    li = table(spark, sf, "lineitem")
    return fu.coverage(li.groupBy(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("family")).agg(F.max("l_discount").alias("score")))


@query("""SELECT l_orderkey AS id, l_returnflag AS family, l_linestatus AS label, round(avg(l_discount), 9) AS score FROM lineitem GROUP BY 1, 2, 3""")
def zero_shot_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    s = li.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("label"), F.col("l_linenumber").alias("phrase"), F.col("l_discount").alias("similarity"))
    return fu.zero_shot(s).withColumn("score", F.round("score", 9))
