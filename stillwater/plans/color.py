"""Queries by colour."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.functions import color
from stillwater.operators import palette as op
from stillwater.plans.registry import query
from stillwater.sources.tables import swatches, with_views


def _lin(c: str) -> str:
    return f"CASE WHEN {c} <= 0.04045e0 THEN {c} / 12.92e0 ELSE power(({c} + 0.055e0) / 1.055e0, 2.4e0) END"


def _row(m, names) -> str:
    return " + ".join(f"{x!r}e0 * {n}" for x, n in zip(m, names, strict=True))


def lab_views(source: str = "swatch", to: str = "lab") -> str:
    """CTEs that add l, a, b to a relation with a hex column."""
    byte = lambda at: f"CAST(CAST('0x' || substr(hex, {at}, 2) AS BIGINT) AS DOUBLE) / 255e0"
    return f""", {to}0 AS (SELECT *, {byte(2)} AS r_, {byte(4)} AS g_, {byte(6)} AS b_ FROM {source}),
{to}1 AS (SELECT *, {_lin("r_")} AS lr, {_lin("g_")} AS lg, {_lin("b_")} AS lb FROM {to}0),
{to}2 AS (SELECT *, cbrt({_row(color.TO_LMS[0], ("lr", "lg", "lb"))}) AS x1, cbrt({_row(color.TO_LMS[1], ("lr", "lg", "lb"))}) AS x2, cbrt({_row(color.TO_LMS[2], ("lr", "lg", "lb"))}) AS x3 FROM {to}1),
{to} AS (SELECT *, {_row(color.TO_LAB[0], ("x1", "x2", "x3"))} AS l, {_row(color.TO_LAB[1], ("x1", "x2", "x3"))} AS a, {_row(color.TO_LAB[2], ("x1", "x2", "x3"))} AS b FROM {to}2)
"""


def hex_sql(l: str, a: str, b: str) -> str:  # noqa: E741
    lms = [f"power({_row(m, (l, a, b))}, 3e0)" for m in color.FROM_LAB]
    out = []
    for m in color.FROM_LMS:
        x = f"({_row(m, lms)})"
        v = f"(CASE WHEN {x} <= 0.0031308e0 THEN 12.92e0 * {x} ELSE 1.055e0 * power(greatest({x}, 0e0), 1e0 / 2.4e0) - 0.055e0 END)"
        out.append(f"lpad(upper(to_hex(CAST(floor(greatest(0e0, least(1e0, {v})) * 255 + 0.5e0) AS BIGINT))), 2, '0')")
    return "'#' || " + " || ".join(out)


HUE = "((degrees(atan2(b, a)) + 360) - 360 * floor((degrees(atan2(b, a)) + 360) / 360))"
CHROMA = "sqrt(a * a + b * b)"
TONE = f"CASE WHEN {CHROMA} < 0.03 THEN 'neutral' WHEN {HUE} >= 15 AND {HUE} < 110 THEN 'warm' WHEN {HUE} >= 110 AND {HUE} < 175 THEN 'green' WHEN {HUE} >= 175 AND {HUE} < 300 THEN 'cool' ELSE 'magenta' END"
LIGHT = "CASE " + " ".join(f"WHEN l < {b} THEN '{w}'" for b, w in color.LIGHTS) + " END"
HUE_WORD = "CASE " + " ".join(f"WHEN {HUE} < {b} THEN '{w}'" for b, w in color.HUES) + " END"
NAME = f"""CASE WHEN {CHROMA} < 0.03 THEN CASE WHEN l < 0.2 THEN 'black' WHEN l > 0.9 THEN 'white' ELSE trim({LIGHT} || ' gray') END
ELSE trim(regexp_replace({LIGHT} || ' ' || CASE WHEN {CHROMA} < 0.07 THEN 'muted ' ELSE '' END || {HUE_WORD}, ' +', ' ', 'g')) END"""
SW = with_views("digest", "swatch") + lab_views()


@query(SW + "SELECT id, lane, rank, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b FROM lab")
def hex_to_oklab(spark, sf):
    return op.with_lab(swatches(spark, sf)).select("id", "lane", "rank", *[F.round(F.col("lab")[n], 6).alias(n) for n in "lab"])


@query(SW + f"SELECT hex, {NAME} AS name FROM (SELECT DISTINCT hex, l, a, b FROM lab)")
def color_names(spark, sf):
    return op.with_lab(swatches(spark, sf).select("hex").distinct()).select("hex", color.color_name(F.col("lab")).alias("name"))


@query(SW + f"SELECT lane, {TONE} AS tone, count(*) AS n FROM lab GROUP BY 1, 2")
def tone_names(spark, sf):
    return op.with_lab(swatches(spark, sf)).groupBy("lane", color.tone_name(F.col("lab")).alias("tone")).agg(F.count(F.lit(1)).alias("n"))


LUM = "(0.2126e0 * lr + 0.7152e0 * lg + 0.0722e0 * lb)"


@query(SW + f"""SELECT id, rank, lane, round({LUM}, 6) AS luminance,
CASE WHEN (greatest({LUM}, 0.005605391624202723e0) + 0.05e0) / (least({LUM}, 0.005605391624202723e0) + 0.05e0) >= (greatest({LUM}, 0.9046611743911496e0) + 0.05e0) / (least({LUM}, 0.9046611743911496e0) + 0.05e0) THEN '#111' ELSE '#f4f4f4' END AS ink
FROM lab""")
def swatch_ink(spark, sf):
    return swatches(spark, sf).select("id", "rank", "lane", F.round(color.luminance(F.col("hex")), 6).alias("luminance"), color.text_on(F.col("hex")).alias("ink"))


CELLS = SW + f""", cell AS (SELECT id, CASE WHEN weight > 0 THEN weight ELSE 0.01e0 END AS w, l, a, b, floor(l / 0.09e0 + 0.5e0) AS c1, floor(a / 0.05e0 + 0.5e0) AS c2, floor(b / 0.05e0 + 0.5e0) AS c3 FROM lab WHERE lane = 'swatches'),
mean AS (SELECT sum(w) AS weight, count(DISTINCT id) AS n, sum(l * w) / sum(w) AS l, sum(a * w) / sum(w) AS a, sum(b * w) / sum(w) AS b FROM cell GROUP BY c1, c2, c3 HAVING count(DISTINCT id) >= 3),
mix0 AS (SELECT {hex_sql("l", "a", "b")} AS hex, weight, n, l AS ml, a AS ma, b AS mb FROM mean),
mix1 AS (SELECT hex, arg_max(ml, weight) AS ml, arg_max(ma, weight) AS ma, arg_max(mb, weight) AS mb FROM mix0 GROUP BY hex)
{lab_views("mix1", "chip")}, sw AS (SELECT id, l, a, b FROM lab WHERE lane = 'swatches'),
counted AS (SELECT c.hex, c.ml AS l, c.ma AS a, c.mb AS b, count(DISTINCT s.id) AS n FROM chip c JOIN sw s
  ON s.l BETWEEN c.l - 0.045e0 AND c.l + 0.045e0 AND sqrt((s.l - c.l) * (s.l - c.l) + (s.a - c.a) * (s.a - c.a) + (s.b - c.b) * (s.b - c.b)) <= 0.045e0 GROUP BY c.hex, c.ml, c.ma, c.mb HAVING count(DISTINCT s.id) >= 3),
top AS (SELECT *, {CHROMA} < 0.035 AS neutral FROM counted ORDER BY n DESC, hex LIMIT 60)
"""


@query(CELLS + f"SELECT hex, n, {NAME} AS name, neutral FROM top")
def color_cloud(spark, sf):
    return op.cloud(swatches(spark, sf)).drop("lab")


@query(CELLS + f"SELECT hex, row_number() OVER (ORDER BY CASE WHEN neutral THEN -1 ELSE floor({HUE} / 20 + 0.5e0) END, round(l, 9), hex) AS place FROM top")
def chip_order(spark, sf):
    return op.chip_order(op.cloud(swatches(spark, sf)))


LANE = SW + f""", cell AS (SELECT id, CASE WHEN weight > 0 THEN weight ELSE 0.01e0 END AS w, l, a, b, floor(l / 0.09e0 + 0.5e0) AS c1, floor(a / 0.05e0 + 0.5e0) AS c2, floor(b / 0.05e0 + 0.5e0) AS c3 FROM lab WHERE lane = 'shadows'),
mean AS (SELECT sum(w) AS weight, sum(l * w) / sum(w) AS l, sum(a * w) / sum(w) AS a, sum(b * w) / sum(w) AS b FROM cell GROUP BY c1, c2, c3 HAVING count(DISTINCT id) >= 3),
mix AS (SELECT {hex_sql("l", "a", "b")} AS hex, weight, l AS ml, a AS ma, b AS mb FROM mean), own AS (SELECT '#404858' AS hex) {lab_views("own", "kept")},
offered AS (SELECT hex, arg_max(ml, weight) AS ml, arg_max(ma, weight) AS ma, arg_max(mb, weight) AS mb FROM mix WHERE hex <> '#404858' GROUP BY hex UNION ALL SELECT hex, l, a, b FROM kept)
{lab_views("offered", "chip")},
counted AS (SELECT c.hex, count(DISTINCT s.id) AS n FROM chip c JOIN lab s ON s.lane = 'shadows' AND s.id % 2 = 0 AND sqrt((s.l - c.l) * (s.l - c.l) + (s.a - c.a) * (s.a - c.a) + (s.b - c.b) * (s.b - c.b)) <= 0.07e0 GROUP BY c.hex),
out AS (SELECT o.hex, coalesce(n, 0) AS n, ml AS l, ma AS a, mb AS b FROM offered o LEFT JOIN counted c ON c.hex = o.hex)
"""


@query(LANE + f"SELECT hex, n, {TONE} AS tone FROM out WHERE n >= 3 OR hex = '#404858'")
def lane_chips(spark, sf):
    s = swatches(spark, sf)
    return op.lane_chips(s, "shadows", s.where("id % 2 = 0").select("id"), "#404858")


def pick_sql(hexes: list[str], limit: float, lane: str = "swatches") -> str:
    values = ", ".join(f"('{h}')" for h in hexes)
    return SW + f""", want AS (SELECT * FROM (VALUES {values}) AS v(hex)) {lab_views("want", "t")},
hit AS (SELECT s.id, t.hex, sqrt((s.l - t.l) * (s.l - t.l) + (s.a - t.a) * (s.a - t.a) + (s.b - t.b) * (s.b - t.b)) AS d, s.weight AS w FROM lab s, t WHERE s.lane = '{lane}'),
best AS (SELECT id, hex, d, w, row_number() OVER (PARTITION BY id, hex ORDER BY d, w DESC) AS r FROM hit WHERE d <= {limit}e0),
picked AS (SELECT id, sum(w * (1 - d / {limit}e0)) AS score FROM best WHERE r = 1 GROUP BY id HAVING count(*) = {len(hexes)})
"""


@query(pick_sql(["#8A6D5B"], op.STRICT) + "SELECT id, round(score, 6) AS score FROM picked")
def color_pick_strict(spark, sf):
    return op.pick(swatches(spark, sf), ["#8A6D5B"]).select("id", F.round("score", 6).alias("score"))


@query(pick_sql(["#8A6D5B", "#4060A0"], op.BROAD) + "SELECT id, round(score, 6) AS score FROM picked")
def color_pick_broad(spark, sf):
    return op.pick(swatches(spark, sf), ["#8A6D5B", "#4060A0"], op.BROAD).select("id", F.round("score", 6).alias("score"))


PAIRS = SW + f""", tone AS (SELECT id, work, lane, l, a, b, {TONE} AS tone FROM lab WHERE rank = 0 AND lane <> 'swatches'),
pair AS (SELECT s.id, s.work, s.tone AS shadow, h.tone AS highlight, s.l AS sl, s.a AS sa, s.b AS sb, h.l AS hl, h.a AS ha, h.b AS hb FROM tone s JOIN tone h USING (id) WHERE s.lane = 'shadows' AND h.lane = 'highlights'),
mean AS (SELECT shadow, highlight, count(*) AS n, avg(sl) AS sl, avg(sa) AS sa, avg(sb) AS sb, avg(hl) AS hl, avg(ha) AS ha, avg(hb) AS hb FROM pair GROUP BY shadow, highlight),
firsts AS (SELECT shadow, highlight, min(id) AS id, row_number() OVER (PARTITION BY shadow, highlight ORDER BY min(id)) AS r FROM pair GROUP BY shadow, highlight, work),
cover AS (SELECT shadow, highlight, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS covers FROM firsts WHERE r <= 3 GROUP BY shadow, highlight)
"""


@query(PAIRS + f"SELECT shadow, highlight, n, covers, {hex_sql('sl', 'sa', 'sb')} AS shadow_hex, {hex_sql('hl', 'ha', 'hb')} AS highlight_hex FROM mean JOIN cover USING (shadow, highlight) ORDER BY n DESC, shadow, highlight LIMIT 9")
def grade_pairs(spark, sf):
    return op.grade_pairs(swatches(spark, sf))


@query(pick_sql(["#404858"], op.GRADE, "shadows") + f"SELECT p.id, round(score + weight, 6) AS score FROM picked p JOIN (SELECT id, weight, {TONE} AS tone FROM lab WHERE lane = 'highlights' AND rank = 0) h ON h.id = p.id WHERE tone = 'warm'")
def grade_pick(spark, sf):
    return op.grade_pick(swatches(spark, sf), "#404858", "warm").select("id", F.round("score", 6).alias("score"))


@query(SW + f", m AS (SELECT work, avg(l) AS l, avg(a) AS a, avg(b) AS b FROM lab WHERE lane = 'shadows' AND rank = 0 GROUP BY work) SELECT work, {hex_sql('l', 'a', 'b')} AS hex FROM m")
def tone_swatch(spark, sf):
    return op.tone_swatch(swatches(spark, sf), "shadows")


def descriptors(spark, sf):
    s = op.with_lab(swatches(spark, sf).where("lane = 'swatches'"))
    step = F.floor(color.hue(F.col("lab")) / 45).cast("int")
    sums = [F.sum(F.when(step == k, F.col("weight")).otherwise(0.0)) / F.sum("weight") for k in range(8)]
    return s.groupBy("id").agg(F.array(*sums).alias("bands"), F.avg(color.luma709(F.col("hex"))).alias("luma"), F.avg(color.saturation(F.col("hex"))).alias("sat"))


BANDS = ", ".join(f"sum(CASE WHEN floor({HUE} / 45) = {k} THEN weight ELSE 0e0 END) / sum(weight) AS b{k}" for k in range(8))
GAP = " + ".join(f"abs(x.b{k} - t.b{k})" for k in range(8))


@query(SW + f""", desc_ AS (SELECT id, {BANDS}, avg(0.2126e0 * r_ + 0.7152e0 * g_ + 0.0722e0 * b_) AS luma,
  avg(CASE WHEN greatest(r_, g_, b_) > 0 THEN (greatest(r_, g_, b_) - least(r_, g_, b_)) / greatest(r_, g_, b_) ELSE 0e0 END) AS sat FROM lab WHERE lane = 'swatches' GROUP BY id)
SELECT x.id, round({GAP} + abs(x.luma - t.luma) + abs(x.sat - t.sat), 9) AS distance FROM desc_ x, desc_ t WHERE t.id = 7 AND x.id <> 7 ORDER BY distance, id LIMIT 24""")
def palette_nearest(spark, sf):
    d = descriptors(spark, sf)
    return op.nearest(d, d.where("id = 7"))
