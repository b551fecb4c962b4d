"""Queries over measured frames: publishing, palettes, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.functions import descriptor as de
from stillwater.operators import palettes as pal
from stillwater.operators import publish as pub
from stillwater.operators.keep import kept
from stillwater.plans.registry import query
from stillwater.sources.tables import table, vectors, with_views


def shot_frames(spark, sf):
    """Vectors as frames: five ids make a shot, the first eight numbers are the signature; some frames are blank, and the plans
    of some works end at four fifths of the ids."""
    v = vectors(spark, sf)
    k = F.col("id")
    last = F.broadcast(v.agg(F.max("id").alias("last")))  # one row
    return v.crossJoin(last).select(
        F.col("work").alias("src"), F.floor(k / 5).alias("shot"), F.floor(k / 5).alias("turn"), "id", F.col("ts").alias("t"), (k * 37 % 101).cast("double").alias("detail"),
        F.transform(F.slice("v", 1, 8), lambda x: x.cast("double")).alias("v"), (~((F.col("work") % 3 == 0) & (k * 5 > F.col("last") * 4))).alias("planned"),
        F.when(k % 23 == 5, "blank_luma_extreme").alias("blank"),
    )


@query(with_views("vec").replace("WITH", "WITH RECURSIVE") + """,
fr AS (SELECT work AS src, id // 5 AS shot, id // 5 AS turn, id, ts AS t, CAST(id * 37 % 101 AS DOUBLE) AS detail, list_transform(v[1:8], lambda x: CAST(x AS DOUBLE)) AS v,
  NOT (work % 3 = 0 AND id * 5 > 4 * (SELECT max(vec_id) FROM embeddings)) AS planned, CASE WHEN id % 23 = 5 THEN 'blank_luma_extreme' END AS blank FROM vec),
o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY turn, detail DESC, abs(t - mid), t, id) AS n FROM
  (SELECT *, (min(t) OVER s + max(t) OVER s) / 2 AS mid, min(CASE WHEN NOT planned THEN turn END) OVER (PARTITION BY src) AS fin FROM fr WINDOW s AS (PARTITION BY src, shot))),
c AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n) AS k FROM o WHERE planned AND blank IS NULL AND (fin IS NULL OR turn <= fin)),
step(src, k, pub, got) AS (
  SELECT DISTINCT src, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, shot BIGINT, n BIGINT, v DOUBLE[])[]), FALSE FROM c
  UNION ALL
  SELECT src, k, CASE WHEN ok THEN list_append(pub, {'id': id, 'shot': shot, 'n': n, 'v': v}) ELSE pub END, ok FROM (
    SELECT c.src, c.k, c.id, c.shot, c.n, c.v, pub, len(list_filter(pub, lambda p: p.shot = c.shot)) AS held,
      held < 2 AND coalesce(list_min(list_transform(pub, lambda p: sqrt(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 8))), 1e0) >= CASE WHEN held > 0 THEN 0.17e0 ELSE 0.1e0 END AS ok
    FROM step s JOIN c ON c.src = s.src AND c.k = s.k + 1 WHERE len(pub) < 20)),
pubs AS (SELECT src, arg_max(pub, len(pub)) AS pub FROM step GROUP BY src),
p AS (SELECT src, q.id, q.shot, q.n, q.v FROM (SELECT src, unnest(pub) AS q FROM pubs)),
stops AS (SELECT p.src, max(p.n) AS stop, max(o.turn) AS stop_turn FROM p JOIN o ON o.src = p.src AND o.n = p.n GROUP BY p.src HAVING count(*) >= 20),
h AS (SELECT o.*, stop, stop_turn, (SELECT count(*) FROM p WHERE p.src = o.src AND p.shot = o.shot AND p.n < o.n) AS held, EXISTS (SELECT 1 FROM p WHERE p.src = o.src AND p.n = o.n) AS pub FROM o LEFT JOIN stops USING (src)),
own AS (SELECT *, CASE WHEN NOT planned THEN 'outside_the_extraction_plan' WHEN blank IS NOT NULL THEN blank WHEN pub THEN 'published' WHEN held >= 2 THEN 'shot_publish_limit'
  WHEN n > stop THEN 'prepared_bundle_candidate_limit' WHEN held > 0 THEN 'same_shot_near_twin' ELSE 'repeated_framing' END AS own FROM h),
met AS (SELECT DISTINCT src FROM own WHERE turn = fin AND own = 'prepared_bundle_candidate_limit'),
told AS (SELECT *, CASE WHEN turn > fin THEN CASE WHEN stop_turn < fin OR src IN (SELECT src FROM met) THEN 'prepared_bundle_candidate_limit' ELSE 'outside_the_extraction_plan' END
  WHEN turn > stop_turn THEN 'prepared_bundle_candidate_limit' ELSE own END AS outcome FROM own),
d AS (SELECT t.src, t.id, arg_min(p.id, (dd, p.n)) AS "by", round(min(dd), 9) AS distance FROM (
  SELECT told.src, told.id, p.id AS pid, p.n, sqrt(list_sum(list_transform(list_zip(p.v, told.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 8) AS dd
  FROM told JOIN p ON p.src = told.src AND p.n < told.n WHERE outcome IN ('same_shot_near_twin', 'repeated_framing')) t JOIN p ON p.src = t.src AND p.n = t.n GROUP BY t.src, t.id)
SELECT told.src, told.id, outcome, "by", distance FROM told LEFT JOIN d USING (src, id)""")  # fmt: skip
def published_frames(spark, sf):
    return pub.publish(shot_frames(spark, sf), budget=20, block=64).withColumn("distance", F.round("distance", 9))


def pixels(spark, sf):
    """The lines of a supplier as the pixels of its picture: flat fields of three colours and a spread of others."""
    li = table(spark, sf, "lineitem")
    flat = {"A": (18, 20, 16), "N": (204, 61, 40), "R": (60, 93, 200)}
    spread = ((F.col("l_quantity").cast("int") * 5), F.round(F.col("l_tax") * 100).cast("int") * 30, F.col("l_linenumber") * 36)
    part = lambda k: F.when(F.col("l_discount") < 0.045, F.coalesce(*[F.when(F.col("l_returnflag") == f, c[k]) for f, c in flat.items()])).otherwise(spread[k])
    return li.select(F.col("l_suppkey").alias("img"), *[part(k).cast("int").alias(n) for k, n in enumerate("rgb")])


def _flat(k: int) -> str:
    return "CASE l_returnflag WHEN 'A' THEN " + ("18", "20", "16")[k] + " WHEN 'N' THEN " + ("204", "61", "40")[k] + " WHEN 'R' THEN " + ("60", "93", "200")[k] + " END"


_SPREAD = ("CAST(l_quantity AS INTEGER) * 5", "CAST(round(l_tax * 100) AS INTEGER) * 30", "l_linenumber * 36")
_luma = lambda c: f"({c}r / 255 * 0.2126e0 + {c}g / 255 * 0.7152e0 + {c}b / 255 * 0.0722e0)"
_sat = lambda c: f"(CASE WHEN greatest({c}r, {c}g, {c}b) <= 0 THEN 0e0 ELSE (greatest({c}r, {c}g, {c}b) - least({c}r, {c}g, {c}b)) / greatest({c}r, {c}g, {c}b) END)"
HISTOGRAM = f"""WITH px AS (SELECT l_suppkey AS img, {", ".join(f"CASE WHEN l_discount < 0.045e0 THEN {_flat(k)} ELSE {_SPREAD[k]} END AS {n}" for k, n in enumerate("rgb"))} FROM lineitem),
sn AS (SELECT img, {", ".join(f"CAST(CASE WHEN greatest(r, g, b) / 255e0 < 0.085e0 THEN 0 WHEN least(r, g, b) / 255e0 > 0.985e0 THEN 255 ELSE {n} END AS DOUBLE) AS {n}" for n in "rgb")} FROM px),
ys AS (SELECT *, {_luma("")} AS y, {_sat("")} AS s FROM sn),
ws AS (SELECT *, CAST(round((s * 0.85e0 + 0.15e0) * (greatest(0e0, 1e0 - abs(y - 0.5e0) * 1.4e0) + 0.35e0) * 1e6) AS BIGINT) AS w,
  CAST(floor(r / 16) * 256 + floor(g / 16) * 16 + floor(b / 16) AS INTEGER) AS bin,
  list_filter(['all', CASE WHEN y < 0.33e0 THEN 'shadows' END, CASE WHEN y >= 0.25e0 AND y < 0.72e0 THEN 'midtones' END, CASE WHEN y >= 0.67e0 THEN 'highlights' END], lambda t: t IS NOT NULL) AS tones FROM ys),
hist AS (SELECT img, tone, bin, CAST(sum(w) AS BIGINT) AS w, CAST(sum(r * w) AS BIGINT) AS sr, CAST(sum(g * w) AS BIGINT) AS sg, CAST(sum(b * w) AS BIGINT) AS sb FROM ws, unnest(tones) AS t(tone) GROUP BY img, tone, bin)
"""


@query(HISTOGRAM + "SELECT * FROM hist")
def color_histogram(spark, sf):
    return pal.histogram(pixels(spark, sf))


_hue = lambda c: (
    f"(CASE WHEN greatest({c}r, {c}g, {c}b) = least({c}r, {c}g, {c}b) THEN 0e0 ELSE fmod((CASE WHEN greatest({c}r, {c}g, {c}b) = {c}r THEN ({c}g - {c}b) / (greatest({c}r, {c}g, {c}b) - least({c}r, {c}g, {c}b)) "
    f"WHEN greatest({c}r, {c}g, {c}b) = {c}g THEN ({c}b - {c}r) / (greatest({c}r, {c}g, {c}b) - least({c}r, {c}g, {c}b)) + 2e0 ELSE ({c}r - {c}g) / (greatest({c}r, {c}g, {c}b) - least({c}r, {c}g, {c}b)) + 4e0 END) * 60e0 + 360e0, 360e0) END)"
)
_apart = lambda x, y: f"sqrt({' + '.join(f'({x}{n} - {y}{n}) * ({x}{n} - {y}{n})' for n in 'rgb')})"
_anchor = lambda c: f"(greatest({c}r, {c}g, {c}b) < 8 OR least({c}r, {c}g, {c}b) > 247)"
_colored = lambda c: f"({_sat(c)} >= 0.08e0 AND {_luma(c)} BETWEEN 0.1e0 AND 0.94e0)"
_turn = lambda x, y: f"least(abs({x} - {y}), 360e0 - abs({x} - {y}))"
_unlike = lambda x, y: f"(least({_turn(_hue(x), _hue(y))} / 55e0, 2e0) + abs({_luma(x)} - {_luma(y)}) / 0.2e0 + least({_apart(x, y)} / 70e0, 1.5e0))"
_worth = lambda c: f"(power(CAST({c}w AS DOUBLE), 0.62e0) * ({_sat(c)} + 0.35e0) * greatest(0.25e0, least(1e0, 1e0 - abs({_luma(c)} - 0.45e0) * 1.6e0)))"
_best = lambda xs: f"list_transform(list_sort(list_transform({xs}, lambda c: {{'s': -{_worth('c.')}, 'n': -c.w, 'k': c.bin, 'c': c}})), lambda x: x.c)"
_heavy = lambda xs: f"list_transform(list_sort(list_transform({xs}, lambda c: {{'n': -c.w, 'k': c.bin, 'c': c}})), lambda x: x.c)"
_take = lambda xs, start, most, fits: f"list_reduce({xs}, lambda acc, c: CASE WHEN len(acc) < {most} AND {fits} THEN list_append(acc, c) ELSE acc END, {start})"
_BINS = "STRUCT(w BIGINT, bin INTEGER, r DOUBLE, g DOUBLE, b DOUBLE)[]"
_mean = lambda g: f"{{'w': {g}w, 'bin': {g}bin, 'r': {g}r / greatest(CAST({g}w AS DOUBLE), 1e-6), 'g': {g}g / greatest(CAST({g}w AS DOUBLE), 1e-6), 'b': {g}b / greatest(CAST({g}w AS DOUBLE), 1e-6)}}"
_off = " + ".join(f"(g.{n} - g.w * c.{n}) * (g.{n} - g.w * c.{n})" for n in "rgb")
_sum = lambda c: f"{{'w': {c}w, 'bin': {c}bin, 'r': {c}r * {c}w, 'g': {c}g * {c}w, 'b': {c}b * {c}w}}"
_FIRST = f"list_position(list_transform(acc, lambda g: {_off} < g.w * g.w * 1764e0), TRUE)"
_GROUPS = f"""list_transform(list_reduce(small, lambda acc, c: CASE WHEN coalesce({_FIRST}, 0) = 0 THEN list_append(acc, {_sum("c.")})
  ELSE list_transform(acc, lambda g, i: CASE WHEN i = {_FIRST} THEN {{'w': g.w + c.w, 'bin': g.bin, 'r': g.r + c.r * c.w, 'g': g.g + c.g * c.w, 'b': g.b + c.b * c.w}} ELSE g END) END, CAST([] AS {_BINS})), lambda g: {_mean("g.")})"""
_NOT_NEAR = lambda least: f"len(list_filter(acc, lambda p: {_unlike('p.', 'c.')} < {least})) = 0"
PICKS = HISTOGRAM + f""", bins AS (SELECT img, tone, sum(w) AS total, list({{'w': w, 'bin': bin, 'r': CAST(sr AS DOUBLE) / greatest(w, 1), 'g': CAST(sg AS DOUBLE) / greatest(w, 1), 'b': CAST(sb AS DOUBLE) / greatest(w, 1)}} ORDER BY w DESC, bin) AS bins FROM hist GROUP BY img, tone),
split AS (SELECT img, tone, total, list_filter(bins, lambda c: c.w >= total * 0.006e0) AS large, list_filter(bins, lambda c: c.w > 0 AND c.w < total * 0.006e0) AS small FROM bins),
found AS (SELECT *, {_take("large", f"CAST([] AS {_BINS})", "8", f"({_anchor('c.')} OR len(list_filter(acc, lambda p: NOT {_anchor('p.')} AND {_apart('p.', 'c.')} < 42e0)) = 0)")} AS dom,
  list_filter(list_filter({_GROUPS}, lambda g: g.w >= total * 0.006e0), lambda g: len(list_filter(large, lambda s: {_apart("s.", "g.")} < 42e0)) = 0) AS acc_all,
  list_filter(large, lambda c: {_anchor("c.")})[1:2] AS fixed FROM split),
plain AS (SELECT *, {_take(f"list_filter({_best('list_filter(large, lambda c: NOT list_contains(fixed, c))')}, lambda c: {_colored('c.')})", "fixed", "8", _NOT_NEAR("1e0"))} AS plain FROM found),
more AS (SELECT *, {_take(_best(f"list_filter(acc_all, lambda c: {_colored('c.')} AND {_sat('c.')} >= 0.35e0)"), "plain", "len(plain) + 2", _NOT_NEAR("2e0"))} AS more FROM plain),
rep AS (SELECT img, tone, total, dom, {_heavy("plain")} AS plain, {_heavy("more[len(plain) + 1:]")} AS accents FROM more),
rows AS (SELECT img, tone, 'dominant' AS kind, unnest(range(len(dom))) AS place, unnest(dom) AS c, CAST(list_sum(list_transform(dom, lambda x: x.w)) AS DOUBLE) AS mass, FALSE AS accent FROM rep
  UNION ALL SELECT img, tone, 'representative', unnest(range(len(plain))), unnest(plain), CAST(list_sum(list_transform(plain, lambda x: x.w)) AS DOUBLE), FALSE FROM rep
  UNION ALL SELECT img, tone, 'representative', unnest(range(len(plain), len(plain) + len(accents))), unnest(accents), CAST(total AS DOUBLE), TRUE FROM rep),
bytes AS (SELECT img, tone, kind, place, accent, c.w / mass AS weight, CAST(floor(c.r + 0.5e0) AS DOUBLE) AS r, CAST(floor(c.g + 0.5e0) AS DOUBLE) AS g, CAST(floor(c.b + 0.5e0) AS DOUBLE) AS b FROM rows),
cols AS (SELECT *, {_hue("")} AS hue, {_sat("")} AS sat, {_luma("")} AS luma FROM bytes)
"""


@query(PICKS + "SELECT img, tone, kind, CAST(place AS INTEGER) AS place, printf('#%02X%02X%02X', CAST(r AS INTEGER), CAST(g AS INTEGER), CAST(b AS INTEGER)) AS hex, round(weight, 9) AS weight, accent FROM cols")
def palette_picks(spark, sf):
    """Dominant and representative colours of every picture and tone, accents last."""
    p = pal.palettes(pixels(spark, sf))
    each = lambda kind: p.select("img", "tone", F.lit(kind).alias("kind"), F.posexplode(kind).alias("place", "c"))
    both = each("dominant").unionByName(each("representative"))
    return both.select("img", "tone", "kind", "place", "c.hex", F.round("c.weight", 9).alias("weight"), "c.accent")


_PROX = lambda x, y, reach: f"greatest(0e0, 1e0 - {_turn(x, y)} / {reach})"


@query(PICKS + f""", rp AS (SELECT img, place, hue, sat, weight * (0.25e0 + sat) AS w FROM cols WHERE tone = 'all' AND kind = 'representative' AND sat >= 0.08e0 AND luma BETWEEN 0.1e0 AND 0.94e0),
imgs AS (SELECT DISTINCT img FROM px),
band AS (SELECT * FROM (VALUES {", ".join(f"({i}, {h}e0)" for i, h in enumerate(de.BANDS))}) AS b(band, mid)),
raw AS (SELECT imgs.img, band, coalesce(sum({_PROX("mid", "hue", "75e0")} * w), 0e0) AS s FROM imgs CROSS JOIN band LEFT JOIN rp ON rp.img = imgs.img GROUP BY imgs.img, band),
norm AS (SELECT img, band, CASE WHEN sum(s) OVER (PARTITION BY img) > 1e-6 THEN s / sum(s) OVER (PARTITION BY img) ELSE s END AS s FROM raw),
l1 AS (SELECT y.img, 0.5e0 * sum(abs(x.s - y.s)) AS d FROM norm x JOIN norm y ON y.img = x.img + 1 AND x.band = y.band GROUP BY y.img),
near AS (SELECT y.img, y.place, any_value(y.w) AS w, max({_PROX("x.hue", "y.hue", "70e0")}) AS p FROM rp x JOIN rp y ON y.img = x.img + 1 GROUP BY y.img, y.place),
mass AS (SELECT img, sum((1e0 - p) * w) / sum(w) AS m FROM near GROUP BY img),
chroma AS (SELECT imgs.img, coalesce(sum(sat * w) / sum(w), 0e0) AS c FROM imgs LEFT JOIN rp USING (img) GROUP BY imgs.img)
SELECT l1.img, round(d, 6) AS hue_family_l1, round(coalesce(m, 0e0), 6) AS out_of_palette_mass, round(y.c - x.c, 6) AS source_chroma_delta FROM l1 LEFT JOIN mass USING (img) JOIN chroma y ON y.img = l1.img JOIN chroma x ON x.img = l1.img - 1""")
def palette_distances(spark, sf):
    """How far each picture's palette is from that of the picture before."""
    p = kept(pal.palettes(pixels(spark, sf), tones=("all",)).select("img", "representative"))
    before = p.select((F.col("img") + 1).alias("img"), F.col("representative").alias("reference"))
    d = p.join(before, "img").select("img", pal.palette_distance(F.col("reference"), F.col("representative")).alias("d"))
    return d.select("img", *[F.round(f"d.{c}", 6).alias(c) for c in ("hue_family_l1", "out_of_palette_mass", "source_chroma_delta")])
