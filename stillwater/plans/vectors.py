"""Queries over vectors and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.operators import similar as op
from stillwater.operators.keep import kept
from stillwater.plans.registry import query
from stillwater.sources.tables import table, vectors, with_views

VEC = with_views("vec")
DOT = "list_dot_product(CAST(x.v AS DOUBLE[]), CAST(t.v AS DOUBLE[]))"
PAIR = VEC + f""", p AS (SELECT x.work AS wa, x.id AS a, x.ts AS ta, t.work AS wb, t.id AS b, t.ts AS tb, {DOT} AS similarity FROM vec x JOIN vec t ON x.work < t.work),
hit AS (SELECT *, tb - ta AS shift FROM p WHERE similarity >= 0.3e0)
"""


@query(VEC + f"SELECT x.id, x.work, round({DOT}, 6) AS similarity FROM vec x, vec t WHERE t.id = 0 AND x.id <> 0 ORDER BY similarity DESC, x.id LIMIT 24")
def similar_topk(spark, sf):
    v = vectors(spark, sf)
    return op.top_k(v, v.where("id = 0"))


@query(VEC + f"SELECT x.id, x.work, round({DOT}, 6) AS similarity FROM vec x, vec t WHERE t.id = 3 AND x.id <> 3 AND x.work IN (1, 4, 7) ORDER BY similarity DESC, x.id LIMIT 60")
def search_in_pool(spark, sf):
    v = vectors(spark, sf)
    return op.in_pool(v, v.where("work IN (1, 4, 7)"), v.where("id = 3"))


@query(PAIR + "SELECT wa, a, wb, b, round(similarity, 6) AS similarity FROM hit")
def repeat_pairs(spark, sf):
    return op.pairs(vectors(spark, sf), 0.3).select("wa", "a", "wb", "b", F.round("similarity", 6).alias("similarity"))


RUN = PAIR + """, f AS (SELECT *, CASE WHEN shift - lag(shift) OVER (PARTITION BY wa, wb ORDER BY shift, a, b) <= 8 THEN 0 ELSE 1 END AS fresh FROM hit),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY wa, wb ORDER BY shift, a, b ROWS UNBOUNDED PRECEDING) AS run FROM f),
kept AS (SELECT wa, wb, run, count(DISTINCT a) AS na, count(DISTINCT b) AS nb, min(shift) AS lo, max(shift) AS hi FROM g GROUP BY wa, wb, run HAVING least(count(DISTINCT a), count(DISTINCT b)) >= 3)
"""


@query(RUN + "SELECT wa, wb, lo, hi, na, nb FROM kept")
def repeat_runs(spark, sf):
    return op.runs(op.pairs(vectors(spark, sf), 0.3), 8).select("wa", "wb", "lo", "hi", "na", "nb").distinct()


@query(RUN + ", h AS (SELECT g.* FROM g JOIN kept USING (wa, wb, run)) SELECT a AS id, wb AS other FROM h UNION SELECT b, wa FROM h")
def repeat_marks(spark, sf):
    return op.marks(op.runs(op.pairs(vectors(spark, sf), 0.3), 8))


@query(VEC + f""", pick AS (SELECT * FROM vec WHERE id % 10 = 0),
near AS (SELECT x.work, x.id, max({DOT}) AS s, max(CASE WHEN x.id <> t.id THEN {DOT} END) AS other, bool_or(x.id = t.id) AS own FROM vec x JOIN pick t ON x.work = t.work GROUP BY x.work, x.id),
cover AS (SELECT work, round(avg(s), 6) AS coverage, round(max(CASE WHEN own THEN other END), 6) AS closest FROM near GROUP BY work),
step AS (SELECT work, max(nxt - ts) AS gap FROM (SELECT work, ts, lead(ts) OVER (PARTITION BY work ORDER BY ts, id) AS nxt FROM pick) GROUP BY work)
SELECT work, coverage, closest, gap FROM cover JOIN step USING (work)""")
def selection_metrics(spark, sf):
    v = vectors(spark, sf)
    return op.selection_metrics(v, v.where("id % 10 = 0"))


def measured(spark, sf):
    """The vectors with a palette (none for some), a category, a scene score, and the duration of their work."""
    k = F.col("id")
    pal = F.when(k % 6 != 0, F.array(k % 7 / F.lit(7.0), k % 11 / F.lit(11.0), k % 5 / F.lit(5.0)))
    return vectors(spark, sf).withColumns({"pal": pal, "cat": F.when(k % 5 != 4, (k % 5).cast("string")), "score": k * 37 % 101 / F.lit(100.0), "duration": F.lit(2000.0)})


@query()
def stratified_pick(spark, sf):
    return op.stratified(measured(spark, sf), 8)


@query()
def breadth_select(spark, sf):
    return op.breadth(measured(spark, sf), 8)


NEAREST = VEC + """, pick AS (SELECT *, id AS turn FROM vec WHERE id % 10 = 0),
d AS (SELECT x.work, x.id, t.id AS "by", t.turn, list_distance(CAST(x.v AS DOUBLE[]), CAST(t.v AS DOUBLE[])) AS distance FROM vec x JOIN pick t ON x.work = t.work WHERE x.id % 10 <> 0),
m AS (SELECT work, id, arg_min("by", (distance, turn)) AS "by", round(min(distance), 6) AS distance FROM d GROUP BY work, id)
"""


@query(NEAREST + "SELECT * FROM m")
def displaced_frames(spark, sf):
    v = vectors(spark, sf)
    return op.displaced(v, v.where("id % 10 = 0").select("work", "id", F.col("id").alias("turn"))).withColumn("distance", F.round("distance", 6))


@query(NEAREST + "SELECT m.* FROM m WHERE id % 4 = 1 AND NOT EXISTS (SELECT 1 FROM pick p WHERE p.work = m.work AND p.id = m.id - 3)")
def relinked_frames(spark, sf):
    """Every fourth frame was stood for by the one three before it."""
    v = vectors(spark, sf)
    orphans = v.where("id % 4 = 1 AND id % 10 <> 0").select("work", "id", (F.col("id") - 3).alias("by"))
    return op.relinked(orphans, v, v.where("id % 10 = 0").select("work", "id", F.col("id").alias("turn")))


@query("""SELECT shot, id, place FROM (SELECT l_orderkey AS shot, l_orderkey * 10 + l_linenumber AS id,
row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_discount, 4) DESC, abs(l_linenumber - 3e0), l_linenumber, l_orderkey * 10 + l_linenumber) AS place FROM lineitem) WHERE place <= 2""")
def best_in_shot(spark, sf):
    li = table(spark, sf, "lineitem")
    f = li.select(F.col("l_orderkey").alias("shot"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").cast("double").alias("ts"), F.col("l_discount").alias("detail"), F.lit(3.0).alias("mid"))
    return op.best_in_shot(f)


def hashes(spark, sf):
    """60 bits of each text: bit k says whether an odd number of its words fall on k, so few changed words change few bits."""
    d = table(spark, sf, "documents")
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % 60).cast("int"))
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: w != "")
    return d.select(F.col("doc_id").alias("id"), F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(bit(w))).alias("h"))


HASH = """WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '') AS ws FROM documents),
h AS (SELECT id, coalesce(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(ws, lambda w: CAST(1 AS BIGINT) << CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 60 AS INTEGER))), lambda a, b: xor(a, b)), 0) AS h FROM w),
k AS (SELECT h, min(id) AS id, count(*) AS n FROM h GROUP BY h),
p AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance FROM k x JOIN k y ON x.id < y.id WHERE bit_count(xor(x.h, y.h)) <= 5)
"""


@query(HASH + "SELECT a, b, distance FROM p")
def hamming_pairs(spark, sf):
    return op.hamming_pairs(hashes(spark, sf), 5)


@query(HASH.replace("WITH w AS", "WITH RECURSIVE w AS") + """, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(id, seen) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
f AS (SELECT id, min(seen) AS family FROM r GROUP BY id)
SELECT h.id, coalesce(f.family, k.id) AS family FROM h JOIN k ON k.h = h.h LEFT JOIN f ON f.id = k.id WHERE k.n > 1 OR f.id IS NOT NULL""")
def dedup_families(spark, sf):
    h = kept(hashes(spark, sf))  # the texts are read once
    return op.families(h, op.hamming_pairs(h, 5))
