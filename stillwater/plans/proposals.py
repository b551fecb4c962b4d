"""Queries over proposals, kept repeats, migrated records and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.operators import bundles as bn
from stillwater.operators import filehash as fh
from stillwater.operators import grids as gr
from stillwater.operators import migrate as mg
from stillwater.operators import proposals as pr
from stillwater.operators import repeats as rp
from stillwater.operators.keep import scratch
from stillwater.plans.registry import query
from stillwater.sources.tables import table, vectors, with_views

pick = lambda n, *words: "CASE " + f"{n} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"
#: Evidence cut from a document's id (k) and size (n), in words that both engines read.
EVIDENCE = {
    "wd": "k % 7 <> 0", "setting": pick("k", "abstain", "interior", "exterior", "mixed"), "setting_s": "k % 10 / 10e0", "time": pick("k", "abstain", "day", "night"), "time_s": "k % 9 / 9e0",
    "weather": pick("k", "abstain", "none-visible", "rain", "abstain", "fog"), "weather_s": "k % 11 / 13e0", "light": pick("k", "abstain", "abstain", "backlit", "abstain"), "light_s": "k % 6 / 7e0",
    "bias": pick("k", "abstain", "monochrome", "abstain"), "bias_s": "k % 8 / 9e0", "tangle": pick("k", "low", "abstain", "abstain", "high", "abstain"), "tangle_s": "k % 12 / 17e0",
    "cangle": "CASE WHEN k % 4 = 1 THEN 'eye-level' END", "cangle_s": "k % 13 / 13e0", "card": "k % 9 = 4", "scale": pick("k", "abstain", "close-up", "medium", "extreme-wide"), "scale_s": "CASE WHEN k % 4 = 0 THEN 0e0 ELSE k % 11 / 11e0 END",
    "lane": pick("k", "none", "face-occupancy", "tagger", "face-occupancy"), "head": "CASE k % 3 WHEN 1 THEN 'close-up' WHEN 2 THEN 'wide' END", "comp": pick("k", "abstain", "centered", "symmetrical"), "basis": pick("k", "none", "subject-x", "mirror"),
    "faces": "CASE WHEN k % 5 > 0 THEN CAST(k % 5 AS INTEGER) END", "counted": pick("k", "abstain", "one", "two"), "people": "CASE WHEN k % 5 > 0 THEN " + pick("k / 5 * 5 + k", "one", "two") + " ELSE " + pick("k", "abstain", "one", "two") + " END", "people_s": "k % 14 / 15e0",
    "pl": pick("n", "abstain", "low-key", "high-key"), "pl_s": "CASE WHEN n % 3 = 0 THEN 0e0 ELSE 0.6e0 END", "pb": pick("n", "warm", "cool", "neutral", "mixed", "abstain"), "pb_s": "CASE WHEN n % 5 = 4 THEN 0e0 ELSE n % 10 / 10e0 END", "ps": pick("n", "muted", "balanced", "vivid"), "ps_s": "n % 7 / 7e0",
}
EVIDENCE["people"] = "CASE WHEN k % 5 > 0 THEN " + pick("k", "one", "two") + " ELSE " + pick("k", "abstain", "one", "two") + " END"
EV = "WITH d AS (SELECT doc_id AS k, n_chars AS n FROM documents), e AS (SELECT k AS id, " + ", ".join(f"{v} AS {c}" for c, v in EVIDENCE.items()) + " FROM d)"


def evidence(spark, sf):
    e = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.col("n_chars").alias("n")).selectExpr("k AS id", *[f"{v} AS {c}" for c, v in EVIDENCE.items()])
    two = lambda v: F.struct(F.col(v).alias("value"), F.col(f"{v}_s").alias("score"))
    tags = F.create_map(*[x for f, c in (("setting", "setting"), ("time", "time"), ("weather", "weather"), ("lighting", "light"), ("color_bias", "bias"), ("angle", "tangle")) for x in (F.lit(f), F.struct(F.col(c).alias("value"), F.when(F.col(c) == "abstain", 0.0).otherwise(F.col(f"{c}_s")).alias("score")))])
    pal = [F.col(c).alias(a) for c, a in (("pl", "lighting"), ("pl_s", "lighting_score"), ("pb", "color_bias"), ("pb_s", "color_bias_score"), ("ps", "saturation"), ("ps_s", "saturation_score"))]
    return e.select(
        "id", "wd", "card", "head", "faces", tags.alias("tags"), F.when(F.col("cangle").isNotNull(), two("cangle")).alias("angle"), F.struct(F.col("scale").alias("value"), F.col("scale_s").alias("score"), "lane").alias("scale"),
        F.struct(F.col("comp").alias("value"), F.when(F.col("comp") == "abstain", 0.0).otherwise(0.5).alias("score"), "basis").alias("composition"),
        F.struct(F.col("people").alias("value"), F.col("people_s").alias("score"), F.col("counted").alias("tagger"), (F.col("faces").isNotNull() & (F.col("faces") > 2)).alias("inconsistent")).alias("people"),
        F.struct(*pal).alias("palette"), F.struct(F.lit("usable").alias("value"), F.lit(0.35).alias("score")).alias("quality"),
    )


_tag = lambda c: f"(wd AND {c} <> 'abstain')"
_case = lambda *rows: "CASE " + " ".join(f"WHEN {w} THEN {{'value': {v}, 'source': {s}, 'score': CAST({n} AS DOUBLE)}}" for w, v, s, n in rows) + " ELSE {'value': 'abstain', 'source': 'none', 'score': 0e0} END"
FIELDS = {
    "setting": _case((_tag("setting"), "setting", "'tagger'", "setting_s")), "time": _case((_tag("time"), "time", "'tagger'", "time_s")),
    "weather": _case((_tag("weather"), "weather", "CASE WHEN weather = 'none-visible' THEN 'interior-rule' ELSE 'tagger' END", "weather_s")),
    "angle": _case(("cangle IS NOT NULL AND NOT (wd AND card)", "cangle", "'angle-classifier'", "cangle_s"), (f"cangle IS NULL AND {_tag('tangle')}", "tangle", "'tagger'", "tangle_s")),
    "shot_scale": _case(("scale <> 'abstain'", "scale", "lane", "scale_s")), "composition": _case(("wd AND comp <> 'abstain'", "comp", "basis", "0.5e0")),
    "people": _case(("people <> 'abstain'", "people", "CASE WHEN faces IS NULL OR counted = people THEN CASE WHEN faces IS NOT NULL AND faces <= 2 THEN 'tagger+faces' ELSE 'tagger' END ELSE 'faces' END", "people_s")),
    "lighting": _case((_tag("light"), "light", "'tagger'", "light_s"), ("pl <> 'abstain'", "pl", "'palette'", "pl_s")),
    "color_bias": _case(("wd AND bias = 'monochrome'", "bias", "'tagger'", "bias_s"), ("pb <> 'abstain'", "pb", "'palette'", "pb_s")), "saturation": _case(("ps <> 'abstain'", "ps", "'palette'", "ps_s")),
}


@query(EV + ", f AS (" + " UNION ALL ".join(f"SELECT id, '{f}' AS field, {c} AS s, {'lane' if f == 'shot_scale' else 'NULL'} AS lane, {'head' if f == 'shot_scale' else 'NULL'} AS head FROM e" for f, c in FIELDS.items()) + """)
SELECT id, field, s.value AS value, s.source AS source, round_even(s.score, 4) AS score, CASE WHEN lane = 'face-occupancy' AND s.value <> 'abstain' THEN head END AS head,
CASE WHEN lane = 'face-occupancy' AND head IS NOT NULL AND s.value <> 'abstain' THEN CASE s.value WHEN 'extreme-close-up' THEN 'close-up' WHEN 'extreme-wide' THEN 'wide' ELSE s.value END = head END AS agrees FROM f""")
def proposal_fields(spark, sf):
    return pr.fields(evidence(spark, sf)).select("id", F.explode("fields").alias("field", "f")).select("id", "field", "f.value", "f.source", "f.score", "f.head", "f.agrees")


_ts = lambda c: f"CASE WHEN {_tag(c)} THEN {c}_s ELSE 0e0 END"
_tv = lambda c: f"CASE WHEN {_tag(c)} THEN {c} ELSE 'abstain' END"


@query(EV + f""", g AS (SELECT id, scale, scale_s, people, people_s, {FIELDS["angle"]} AS a, {FIELDS["lighting"]} AS l, {FIELDS["color_bias"]} AS c, {FIELDS["saturation"]} AS sa,
  greatest(pb_s, {_ts("bias")}) AS cs, ps_s AS ss, greatest(pl_s, {_ts("light")}) AS ls, {_ts("setting")} AS x1, {_ts("time")} AS x2, {_ts("weather")} AS x3, {_tv("setting")} AS v1, {_tv("time")} AS v2, {_tv("weather")} AS v3 FROM e),
n AS (SELECT *, CAST(cs > 0 AS INTEGER) + CAST(ss > 0 AS INTEGER) + CAST(ls > 0 AS INTEGER) AS n FROM g)
SELECT id, 'setting-time-weather' AS family, CASE WHEN x1 >= x2 AND x1 >= x3 THEN v1 WHEN x2 >= x3 THEN v2 ELSE v3 END AS label, round_even(greatest(x1, x2, x3), 4) AS score FROM n
UNION ALL SELECT id, 'lighting-color-character', CASE WHEN n = 0 THEN 'abstain' WHEN cs >= ss AND cs >= ls THEN c.value WHEN ss >= ls THEN sa.value ELSE l.value END, CASE WHEN n = 0 THEN 0e0 ELSE round_even((CASE WHEN cs > 0 THEN cs ELSE 0e0 END + CASE WHEN ss > 0 THEN ss ELSE 0e0 END + CASE WHEN ls > 0 THEN ls ELSE 0e0 END) / n, 4) END FROM n
UNION ALL SELECT id, 'shot-scale', scale, round_even(scale_s, 4) FROM n UNION ALL SELECT id, 'angle-composition', a.value, round_even(a.score, 4) FROM n
UNION ALL SELECT id, 'people', people, round_even(people_s, 4) FROM n UNION ALL SELECT id, 'quality', 'usable', 0.35e0 FROM n""")
def proposal_scores(spark, sf):
    return pr.scores(evidence(spark, sf))


@query(r"""WITH p AS (SELECT CASE page_id % 3 WHEN 0 THEN 'cand-' || lpad(CAST(page_id AS VARCHAR), 4, '0') WHEN 1 THEN url ELSE 'c-' || page_id END AS id, page_id % 4 = 1 AS bad, page_id % 5 = 2 AS worse FROM pages)
SELECT id, 'not an opaque id' AS problem FROM p WHERE NOT regexp_full_match(id, '[a-z]+-[a-z0-9][a-z0-9-]{2,63}') UNION ALL SELECT id, 'not a quality value' FROM p WHERE bad UNION ALL SELECT id, 'invalid selection disposition' FROM p WHERE worse""")
def refused_proposals(spark, sf):
    k = F.col("page_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("cand-"), F.lpad(k.cast("string"), 4, "0"))).when(k % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("c-"), k.cast("string")))
    return pr.refused(table(spark, sf, "pages").select(name.alias("id"), F.when(k % 4 == 1, F.array(F.lit("usable"), F.lit("blurred"))).otherwise(F.array(F.lit("usable"))).alias("quality"), F.when(k % 5 == 2, "perhaps").otherwise("review").alias("disposition")))


@query(with_views("vec") + """SELECT x.work % 3 AS series, x.work AS wa, x.id AS a, t.work AS wb, t.id AS b, round(list_dot_product(CAST(x.v AS DOUBLE[]), CAST(t.v AS DOUBLE[])), 6) AS similarity
FROM vec x JOIN vec t ON x.work < t.work AND x.work % 3 = t.work % 3 WHERE list_dot_product(CAST(x.v AS DOUBLE[]), CAST(t.v AS DOUBLE[])) >= 0.3e0""")
def repeats_refreshed(spark, sf):
    """Pairs after two imports: the second adds frames to series 1 and drops series 9, so series 0 and 2 stay as matched before."""
    v = vectors(spark, sf).withColumn("series", (F.col("work") % 3).cast("int"))
    first = v.where("series <> 1 OR id % 11 <> 0").unionByName(v.where("work < 2").withColumn("series", F.lit(9)))
    at = scratch(spark, "repeats")
    rp.refresh(first, at, 0.3)
    return rp.refresh(v, at, 0.3).select("series", "wa", "a", "wb", "b", F.round("similarity", 6).alias("similarity"))


def old_jobs(spark, sf):
    """Events as jobs: ten make a chain; every third has an identity of the old form."""
    k = F.col("event_id")
    identity = F.format_string('{"shoko_series_id": %d, "fixture_id": "w%d", "title": "t"}', F.col("user_id"), k % 50)
    kind = F.when(k % 3 == 0, identity).when(k % 3 == 1, F.lit('{"series_id": 5}')).otherwise(F.lit('"none"'))
    more = F.concat(F.when(k % 7 == 0, ', "purpose": "kept"').otherwise(""), F.when(k % 2 == 0, ', "reread": true').otherwise(""))
    params = F.when(k % 40 == 39, "[1, 2]").otherwise(F.concat(F.rtrim("props", F.lit("}")), F.lit(', "identity": '), kind, more, F.lit("}")))
    chain = F.when(k % 13 == 0, -k).otherwise(F.floor(k / 10))
    return table(spark, sf, "events").select(
        k.alias("id"), chain.alias("chain"), F.when((k % 10 != 0) & (k % 13 != 0), k - 1).alias("parent"), F.when(k % 13 == 0, "import").when(k % 60 == 10, "palette").otherwise(F.col("event_type")).alias("stage"),
        F.when(k % 4 == 0, "running").otherwise("committed").alias("state"), F.when(k % 5 == 0, "unraid").otherwise("analyze").alias("capability"), F.when(k % 3 == 0, "unraid").otherwise("gallery").alias("owner"), params.alias("params"),
    )


@query("""WITH j AS (SELECT event_id AS k, user_id, props, CASE WHEN event_id % 13 = 0 THEN -event_id ELSE event_id // 10 END AS chain, event_id % 13 = 0 OR event_id % 10 = 0 AS root,
  CASE WHEN event_id % 13 = 0 THEN 'import' WHEN event_id % 60 = 10 THEN 'palette' ELSE event_type END AS stage FROM events),
c AS (SELECT chain, CASE WHEN bool_or(stage = 'palette' AND root) THEN 'repalette' WHEN bool_or(stage = 'import' AND root) AND count(*) = 1 THEN 'reread' END AS purpose FROM j GROUP BY chain)
SELECT k AS id, CASE WHEN k % 5 = 0 THEN 'source' ELSE 'analyze' END AS capability, CASE WHEN k % 3 <> 0 THEN 'gallery' WHEN k % 4 = 0 THEN 'source' ELSE 'unraid' END AS owner,
  CASE WHEN k % 40 <> 39 THEN json_extract_string(props, '$.k') END AS k,
  CASE WHEN k % 40 = 39 THEN NULL WHEN k % 3 = 0 THEN CAST(user_id AS VARCHAR) WHEN k % 3 = 1 THEN '5' END AS series_id, CASE WHEN k % 40 <> 39 AND k % 3 = 0 THEN 'w' || k % 50 END AS work_id,
  CASE WHEN k % 40 <> 39 AND k % 3 = 0 THEN 't' END AS title, CAST(NULL AS VARCHAR) AS old,
  CASE WHEN k % 40 = 39 THEN NULL WHEN k % 7 = 0 THEN 'kept' WHEN c.purpose = 'repalette' OR c.purpose = 'reread' AND k % 2 = 0 THEN c.purpose END AS purpose FROM j JOIN c USING (chain)""")
def migrated_jobs(spark, sf):
    m = mg.migrate(old_jobs(spark, sf))
    part = lambda path, name: F.get_json_object("params", path).alias(name)
    return m.select("id", "capability", "owner", part("$.k", "k"), part("$.identity.series_id", "series_id"), part("$.identity.work_id", "work_id"), part("$.identity.title", "title"), part("$.identity.shoko_series_id", "old"), part("$.purpose", "purpose"))


GRID = with_views("vec") + """, cell AS (SELECT id, i // 8 AS r, i % 8 AS c, greatest(0e0, least(1e0, CAST(v[i + 1] AS DOUBLE) * 2 + 0.5e0)) AS y FROM vec, unnest(range(64)) AS g(i)),
side AS (SELECT id, r, c, y, lag(y) OVER x AS l, lead(y) OVER x AS n, lag(y) OVER z AS u, lead(y) OVER z AS d FROM cell WINDOW x AS (PARTITION BY id, r ORDER BY c), z AS (PARTITION BY id, c ORDER BY r)),
edge AS (SELECT *, CASE WHEN l IS NULL THEN n - y WHEN n IS NULL THEN y - l ELSE (n - l) / 2 END AS gx, CASE WHEN u IS NULL THEN d - y WHEN d IS NULL THEN y - u ELSE (d - u) / 2 END AS gy FROM side),
cut AS (SELECT *, sqrt(gx * gx + gy * gy) AS m, quantile_cont(sqrt(gx * gx + gy * gy), 0.8) OVER (PARTITION BY id) AS q FROM edge),
lean AS (SELECT id, count(*) AS n, sum(m * cos(4 * (atan2(gy, gx) + pi() / 2))) / sum(m) AS c, sum(m * sin(4 * (atan2(gy, gx) + pi() / 2))) / sum(m) AS s FROM cut WHERE m > q GROUP BY id),
base AS (SELECT id, avg(y) AS luma_mean, stddev_pop(y) AS luma_stddev, (avg(abs(n - y)) + avg(abs(d - y))) / 2 AS detail FROM side GROUP BY id),
mirror AS (SELECT x.id, 1 - avg(abs(x.y - t.y)) AS symmetry FROM cell x JOIN cell t ON t.id = x.id AND t.r = x.r AND t.c = 7 - x.c GROUP BY x.id),
bins AS (SELECT id, -sum(p * log2(p)) AS entropy FROM (SELECT id, count(*) / 64e0 AS p FROM cell GROUP BY id, least(CAST(floor(y * 16) AS INTEGER), 15)) GROUP BY id)
"""


@query(GRID + """SELECT id, round(luma_mean, 6) AS luma_mean, round(luma_stddev, 6) AS luma_stddev, round(detail, 6) AS detail, round(greatest(entropy, 0e0), 6) AS entropy, round(symmetry, 6) AS symmetry,
CASE WHEN n >= 8 THEN round(degrees(atan2(s, c)) / 4, 5) ELSE 0e0 END AS tilt, CASE WHEN n >= 8 THEN round(sqrt(c * c + s * s), 6) ELSE 0e0 END AS coherence FROM base JOIN mirror USING (id) JOIN bins USING (id) JOIN lean USING (id)""")
def grid_measures(spark, sf):
    """Each vector read as an 8 x 8 picture."""
    m = gr.measure(vector_grids(spark, sf))
    return m.select("id", *[F.round(c, 6).alias(c) for c in ("luma_mean", "luma_stddev", "detail", "entropy", "symmetry")], F.round("tilt", 5).alias("tilt"), F.round("coherence", 6).alias("coherence"))


def vector_grids(spark, sf):
    return vectors(spark, sf).select("id", F.transform("v", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") * 2 + 0.5))).alias("grid"))


@query(GRID + """, k AS (SELECT id, a, b, sum(y * cos(pi() * (2 * r + 1) * a / 16) * cos(pi() * (2 * c + 1) * b / 16)) AS x FROM cell, range(8) AS p(a), range(8) AS q(b) GROUP BY id, a, b),
m AS (SELECT *, median(x) OVER (PARTITION BY id) AS mid FROM k) SELECT id, string_agg(CASE WHEN x > mid THEN '1' ELSE '0' END, '' ORDER BY a, b) AS hash FROM m GROUP BY id""")
def grid_hashes(spark, sf):
    return gr.measure(vector_grids(spark, sf)).select("id", "hash")


def bundle_tables(spark, sf):
    """Orders as bundles, their lines as frames; some of each are spoiled."""
    li = table(spark, sf, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    own = F.concat(k.cast("string"), F.lit("-"), n.cast("string"))
    listed = li.select(
        k.alias("bundle"), n.alias("place"), F.when((k % 31 == 7) & (n == 2), "../up").when((k % 37 == 5) & (n == 3), F.concat(k.cast("string"), F.lit("-1"))).otherwise(F.concat(F.lit("c-"), own)).alias("id"),
        F.concat(own, F.lit(".png")).alias("name"), F.col("l_quantity").cast("long").alias("bytes"), F.sha2(own, 256).alias("sha256"), F.col("l_partkey").alias("asked"),
        F.when((k % 23 == 3) & (n == 1), -1).otherwise(F.col("l_partkey")).alias("found"), F.when(n != 4, n * 10).alias("width"), F.when(n != 4, n * 6).alias("height"),
    )
    files = li.where(~((k % 29 == 1) & (n == 2))).select(
        k.alias("bundle"), F.concat(own, F.lit(".png")).alias("name"), (F.col("l_quantity").cast("long") + F.when(k % 19 == 4, 1).otherwise(0)).alias("size"),
        F.when((k % 17 == 6) & (n == 1), "x").otherwise(F.sha2(own, 256)).alias("sha256"), (n * 10 + F.when(k % 13 == 2, 1).otherwise(0)).alias("width"), (n * 6).alias("height"),
    )
    return listed, files


@query(r"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_orderkey || '-' || l_linenumber AS own, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
ids AS (SELECT k, CASE WHEN k % 31 = 7 AND n = 2 THEN '../up' WHEN k % 37 = 5 AND n = 3 THEN k || '-1' ELSE 'c-' || own END AS id FROM l),
f AS (SELECT k, min(CASE WHEN k % 31 = 7 AND n = 2 THEN 3 WHEN k % 29 = 1 AND n = 2 THEN 5 WHEN k % 19 = 4 THEN 6 WHEN k % 17 = 6 AND n = 1 THEN 7 WHEN k % 23 = 3 AND n = 1 THEN 8 WHEN k % 13 = 2 AND n <> 4 THEN 9 ELSE 10 END) AS frame, count(*) AS frames FROM l GROUP BY k),
d AS (SELECT DISTINCT k FROM (SELECT k, id FROM ids GROUP BY k, id HAVING count(*) > 1)),
b AS (SELECT o_orderkey AS k, least(CASE WHEN o_orderkey % 41 = 9 THEN 0 ELSE 10 END, CASE WHEN o_orderkey % 43 = 8 THEN 1 ELSE 10 END, CASE WHEN f.k IS NULL THEN 2 ELSE 10 END, CASE WHEN d.k IS NOT NULL THEN 4 ELSE 10 END, coalesce(frame, 10)) AS p, coalesce(frames, 0) AS frames
  FROM orders LEFT JOIN f ON f.k = o_orderkey LEFT JOIN d ON d.k = o_orderkey)
SELECT k AS bundle, ['not finished', 'changed list', 'no frames', 'unsafe id', 'listed twice', 'missing frame', 'wrong size', 'wrong digest', 'other timestamp', 'other dimensions', 'accepted'][p + 1] AS verdict, frames FROM b""")
def bundle_verdicts(spark, sf):
    listed, files = bundle_tables(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("bundle"))
    k = F.col("bundle")
    closed = F.when(k % 41 == 9, F.lit(None)).when(k % 43 == 8, "stale").otherwise(F.coalesce("digest", F.sha2(F.lit(""), 256)))
    bundles = o.join(bn.list_digest(listed), "bundle", "left").select("bundle", F.concat(F.lit("bundle-"), k.cast("string")).alias("name"), closed.alias("closed"))
    return bn.verdicts(bundles, listed, files)


@query()
def file_checksums(spark, sf):
    """Every document as a file, hashed in chunks of 4,096 bytes."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("content"))
    return fh.checksums(d, 4096).select("id", "crc32", "md5", "sha1", "sha256", F.array_join("ed2k", ",").alias("ed2k"))
