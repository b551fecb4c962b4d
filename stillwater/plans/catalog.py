"""Queries of the read model."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.operators import catalog as op
from stillwater.plans.registry import query
from stillwater.sources.tables import stills, table, with_views

SEEN, FACET = with_views("still", "seen"), with_views("still", "seen", "facet")


@query(SEEN + "SELECT id, work, ts, CAST(row_number() OVER (PARTITION BY work ORDER BY ts NULLS LAST, id) AS BIGINT) AS place FROM seen")
def visible_stills(spark, sf):
    return stills(spark, sf).where(op.visible()).select("id", "work", "ts", F.row_number().over(op.chronological()).cast("long").alias("place"))


@query(SEEN + "SELECT work, count(*) AS n FROM seen GROUP BY work")
def library_counts(spark, sf):
    return op.counts_by_work(stills(spark, sf))


@query(SEEN + "SELECT work, id, ts FROM (SELECT work, id, ts, row_number() OVER (PARTITION BY work ORDER BY ts NULLS LAST, id) AS r FROM seen) WHERE r = 1")
def library_covers(spark, sf):
    return op.covers(stills(spark, sf))


@query(SEEN + "SELECT franchise, season, work, CAST(grouping(franchise) * 4 + grouping(season) * 2 + grouping(work) AS INTEGER) AS level, count(*) AS n, max(ts) AS latest FROM seen GROUP BY ROLLUP (franchise, season, work)")
def library_tree(spark, sf):
    return op.tree(stills(spark, sf))


@query(SEEN + """SELECT w.work, n, id AS cover FROM (SELECT work, count(*) AS n FROM seen GROUP BY work) w
JOIN (SELECT work, id, row_number() OVER (PARTITION BY work ORDER BY ts NULLS LAST, id) AS r FROM seen) c ON c.work = w.work AND r = 1""")
def works_list(spark, sf):
    s = stills(spark, sf)
    return op.counts_by_work(s).join(op.covers(s).select("work", F.col("id").alias("cover")), "work")


@query(SEEN + """SELECT id, work, lag(id) OVER w AS prev, lead(id) OVER w AS next, row_number() OVER w AS position, count(*) OVER (PARTITION BY work) AS total
FROM seen WINDOW w AS (PARTITION BY work ORDER BY ts NULLS LAST, id)""")
def still_prev_next(spark, sf):
    return op.neighbours(stills(spark, sf))


@query("""WITH w AS (SELECT c_nationkey AS series, c_custkey AS work, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 50 END AS episode, c_name AS label FROM customer)
SELECT series, work, lag(work) OVER o AS prev, lead(work) OVER o AS next FROM w WINDOW o AS (PARTITION BY series ORDER BY coalesce(CAST(episode AS DOUBLE), 1e9), label, work)""")
def episode_neighbours(spark, sf):
    c = table(spark, sf, "customer")
    return op.sibling_works(c.select(F.col("c_nationkey").alias("series"), F.col("c_custkey").alias("work"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 50).alias("episode"), F.col("c_name").alias("label")))


@query(with_views("still") + """SELECT id, work, min(CASE WHEN review_state = 'unreviewed' THEN id END) OVER w AS next, count(CASE WHEN review_state = 'unreviewed' THEN id END) OVER w AS "left"
FROM still WHERE selected AND NOT excluded WINDOW w AS (PARTITION BY work ORDER BY ts NULLS LAST, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def next_unreviewed(spark, sf):
    return op.next_unreviewed(stills(spark, sf))


@query(FACET + "SELECT id, k, v FROM facet")
def facet_overlay(spark, sf):
    return stills(spark, sf).select("id", F.explode(op.overlay(F.col("facets"), F.col("facets_human"))).alias("k", "v"))


ARRIVED = "SELECT work, count(*) AS arrived FROM still GROUP BY work"


def arrived(s):
    return s.groupBy("work").agg(F.count(F.lit(1)).alias("arrived"))


@query(SEEN + f"""SELECT s.id, s.work, a.arrived, CAST(row_number() OVER (PARTITION BY s.work ORDER BY ts NULLS LAST, id) AS BIGINT) AS place
FROM seen s JOIN ({ARRIVED}) a ON a.work = s.work WHERE lang = 'en' AND size = 'long'""")
def explore_results(spark, sf):
    s = stills(spark, sf)
    return op.explore(s, arrived(s), {"lang": "en", "size": "long"})


@query(SEEN + f"""SELECT id, work, arrived, place FROM (SELECT s.id, s.work, a.arrived, CAST(row_number() OVER (PARTITION BY s.work ORDER BY ts NULLS LAST, id) AS BIGINT) AS place
FROM seen s JOIN ({ARRIVED}) a ON a.work = s.work WHERE lang = 'en') ORDER BY arrived DESC, work, place LIMIT 60 OFFSET 60""")
def explore_page(spark, sf):
    s = stills(spark, sf)
    return op.page(op.explore(s, arrived(s), {"lang": "en"}), 1)


@query(SEEN + """SELECT 'lang' AS family, lang AS value, count(*) AS n FROM seen WHERE size = 'long' GROUP BY lang
UNION ALL SELECT 'size', size, count(*) FROM seen WHERE lang = 'en' GROUP BY size""")
def explore_facet_counts(spark, sf):
    return op.facet_counts(stills(spark, sf), {"lang": "en", "size": "long"})


@query(with_views("still", "seen", "tag") + "SELECT t AS tag, count(*) AS n FROM tag JOIN seen USING (id) WHERE lang = 'en' AND id IN (SELECT id FROM tag WHERE t = 'that') AND t <> 'that' GROUP BY t ORDER BY n DESC, tag LIMIT 24")
def explore_tag_counts(spark, sf):
    s = stills(spark, sf, tags=True)
    return op.tag_counts(s.where(op.visible() & op.matches(F.col("facets"), F.col("tags"), {"lang": "en"}, "", ("that",))), ("that",))


@query(SEEN + """SELECT family, value FROM (SELECT 'lang' AS family, lang AS value FROM seen UNION SELECT 'size', size FROM seen)
WHERE lower(translate(value, '-_', '  ')) = 'long' ORDER BY family, value LIMIT 1""")
def explore_interpret(spark, sf):
    return op.interpret(stills(spark, sf), "Long")


@query(with_views("still", "seen", "tag") + """SELECT CASE WHEN EXISTS (SELECT 1 FROM seen JOIN tag USING (id) WHERE lang = 'en' AND contains(t, 'zzzzq')) THEN NULL ELSE (SELECT count(*) FROM seen WHERE lang = 'en') END AS n""")
def explore_without_query(spark, sf):
    s = stills(spark, sf, tags=True).where(op.visible() & op.matches(F.col("facets"), None, {"lang": "en"}))
    hit = F.exists("tags", lambda t: t.contains("zzzzq"))
    return s.agg(F.when(F.count_if(hit) == 0, F.count(F.lit(1))).alias("n"))


@query(with_views("still") + """SELECT DISTINCT family, value FROM (SELECT 'lang' AS family, lang AS value FROM still UNION ALL SELECT 'size', size FROM still
UNION ALL SELECT 'grade', 'poor' FROM still WHERE quality = 0 AND toxic <> 1) WHERE value <> ''""")
def facet_choices(spark, sf):
    return op.facet_choices(stills(spark, sf))


@query(with_views("still", "seen", "facet") + """SELECT k AS family, array_to_string(list_sort(list(DISTINCT v)), '|') AS "values" FROM facet WHERE id IN (SELECT id FROM seen) AND v <> '' GROUP BY k""")
def facet_families(spark, sf):
    """The visible stills' facets, a sorted list a family."""
    s = stills(spark, sf).where(op.visible())
    return op.facet_lists(s.select(F.explode(op.overlay(F.col("facets"), F.col("facets_human"))).alias("family", "value"))).select("family", F.array_join("values", "|").alias("values"))


@query(with_views("still") + """SELECT family, coalesce(array_to_string(list_sort(list(DISTINCT value)), '|'), '') AS "values" FROM (SELECT 'lang' AS family, lang AS value FROM still UNION ALL SELECT 'size', size FROM still
UNION ALL SELECT 'grade', 'poor' FROM still WHERE quality = 0 AND toxic <> 1 UNION ALL SELECT unnest(['lang', 'mood', 'angle']), NULL) WHERE value IS NULL OR value <> '' GROUP BY family""")
def facet_controls(spark, sf):
    """The editor's choices: machine's and human's values, and every family that the report scores."""
    return op.facet_lists(op.facet_choices(stills(spark, sf)), ("lang", "mood", "angle")).select("family", F.array_join("values", "|").alias("values"))


def with_reasons(s):
    cut = F.array(F.when(F.col("id") % 3 == 0, "text"), F.when(F.col("id") % 5 == 0, "rating"), F.when(F.col("id") % 7 == 0, "scale"), F.when(F.col("id") % 6 == 0, "text"))
    return s.withColumn("reasons", F.array_compact(cut))


REASON = with_views("still") + """, scope AS (SELECT * FROM still WHERE selected AND review_state = 'unreviewed' AND NOT excluded),
kind AS (SELECT id, work, 'text' AS k FROM scope WHERE id % 3 = 0 UNION ALL SELECT id, work, 'rating' FROM scope WHERE id % 5 = 0 UNION ALL SELECT id, work, 'scale' FROM scope WHERE id % 7 = 0)
"""


@query(REASON + "SELECT id, work, string_agg(k, ',' ORDER BY k) AS kinds FROM kind GROUP BY id, work HAVING bool_or(k IN ('text', 'rating', 'unsure', 'head', 'split'))")
def exceptions(spark, sf):
    return op.exceptions(with_reasons(stills(spark, sf)), ("text", "rating", "unsure", "head", "split"))


@query(REASON + "SELECT k AS kind, count(*) AS n FROM kind GROUP BY k")
def exception_count(spark, sf):
    return op.reason_counts(with_reasons(stills(spark, sf)))


HUMAN = "(quality = 0 OR toxic = 1)"


@query(with_views("still") + f"""SELECT work, count(*) FILTER (WHERE selected) AS picked, count(*) FILTER (WHERE selected AND review_state = 'unreviewed' AND NOT excluded) AS unreviewed,
count(*) FILTER (WHERE selected AND review_state = 'kept') AS kept, count(*) FILTER (WHERE selected AND review_state = 'culled') AS culled,
count(*) FILTER (WHERE selected AND excluded) AS hidden, count(*) FILTER (WHERE selected AND {HUMAN}) AS corrected FROM still GROUP BY work""")
def review_counts(spark, sf):
    return op.review_counts(stills(spark, sf))


@query(with_views("still") + f"""SELECT work, count(*) FILTER (WHERE selected) AS picked, count(*) FILTER (WHERE review_state = 'culled') AS culled, count(*) FILTER (WHERE excluded) AS hidden,
count(*) FILTER (WHERE {HUMAN}) AS corrected FROM still GROUP BY work""")
def review_overview(spark, sf):
    return op.review_overview(stills(spark, sf))


TILES = SEEN + """, f AS (SELECT id, work, ts, 'lang' AS family, lang AS value FROM seen UNION ALL SELECT id, work, ts, 'size', size FROM seen),
firsts AS (SELECT family, value, work, min(id) AS id, min(ts) AS ts, count(*) AS n FROM f GROUP BY family, value, work),
ranked AS (SELECT *, row_number() OVER (PARTITION BY family, value ORDER BY ts, id) AS r FROM firsts)
SELECT family, value, CAST(sum(n) AS BIGINT) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 3) AS covers FROM ranked GROUP BY family, value HAVING sum(n) >= 5"""


@query(TILES)
def technique_tiles(spark, sf):
    return op.technique_tiles(stills(spark, sf))


@query(SEEN + """, pool AS (SELECT id, work, row_number() OVER (PARTITION BY work ORDER BY ts, id) - 1 AS spot, count(*) OVER (PARTITION BY work) AS held FROM seen WHERE ts >= 120),
title AS (SELECT work, row_number() OVER (ORDER BY work) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT work FROM pool)),
pick AS (SELECT work, (t - (20000 * 7) % n + n) % n AS seat, round FROM title, (VALUES (0), (1), (2), (3)) AS r(round))
SELECT id, work, CAST(min(round) AS BIGINT) AS round FROM (SELECT pool.id, pool.work, pick.round, pick.seat FROM pool JOIN pick ON pool.work = pick.work AND spot = (20000 * 7 + round * 13) % held)
GROUP BY id, work ORDER BY min(round * 100000 + seat) LIMIT 24""")
def front_door_sample(spark, sf):
    return op.front_door(stills(spark, sf), day=20000)


def works_of(s, stale: str = ""):
    """Works with a bundle and the key their marks were made for; works named like `stale`% have an old one."""
    w = s.groupBy("season", "work").agg(F.max("id").cast("string").alias("bundle")).withColumnRenamed("season", "series")
    key = op.series_keys(w)
    old = F.col("work").startswith(stale) if stale else F.lit(False)
    return w.join(key, w["series"].cast("string") == key["grp"]).select("series", "work", "bundle", F.when(~old, F.col("key")).alias("repeats_key"))


KEYS = with_views("still") + """, w AS (SELECT season AS series, work, CAST(max(id) AS VARCHAR) AS bundle FROM still GROUP BY season, work),
k AS (SELECT CAST(series AS VARCHAR) AS grp, md5(string_agg(work || ':' || bundle, ',' ORDER BY work)) AS key FROM w GROUP BY series)
"""


@query(KEYS + "SELECT grp, key FROM k")
def series_keys(spark, sf):
    return op.series_keys(works_of(stills(spark, sf)))


@query(KEYS + "SELECT work, series, key FROM w JOIN k ON grp = CAST(series AS VARCHAR) WHERE work LIKE 'src1%'")
def series_due(spark, sf):
    return op.due(works_of(stills(spark, sf), stale="src1"))


@query(KEYS + "SELECT series, count(*) - 1 AS others FROM w GROUP BY series HAVING NOT bool_or(work = 'src13')")
def series_settled(spark, sf):
    return op.settled(works_of(stills(spark, sf), stale="src13"))


@query(KEYS + """, o AS (SELECT series, count(*) - 1 AS others FROM w GROUP BY series)
SELECT s.work, count(*) AS n FROM still s JOIN o ON o.series = s.season WHERE selected AND review_state = 'unreviewed' AND NOT excluded AND NOT locked
AND id % 4 >= greatest(2, ceil(others / 2e0)) GROUP BY s.work""")
def cullable_repeats(spark, sf):
    s = stills(spark, sf)
    s = s.withColumn("repeat_in", F.array_repeat("work", (F.col("id") % 4).cast("int")))
    return op.cullable(s, works_of(s))


@query(with_views("still") + "SELECT id FROM still WHERE NOT selected AND id NOT IN (SELECT id FROM still WHERE locked) AND work IN (SELECT work FROM still WHERE excluded)")
def pool_not_in_gallery(spark, sf):
    s = stills(spark, sf)
    gone = s.where("locked").select("id")
    return s.where("NOT selected").join(gone, "id", "left_anti").join(s.where("excluded").select("work"), "work", "left_semi").select("id")


@query("""SELECT c_custkey AS owner FROM customer WHERE c_acctbal > 9000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000""")
def owners_union(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.where("c_acctbal > 9000").select(F.col("c_custkey").alias("owner")).union(o.where("o_totalprice > 400000").select("o_custkey")).distinct()


@query("""SELECT c_custkey AS work, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS busy FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def exists_guards(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    kinds = o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("open"), F.bool_or(F.col("o_orderstatus") == "P").alias("part"))
    both = c.join(kinds, c["c_custkey"] == kinds["o_custkey"], "left").where(~F.coalesce("part", F.lit(False)))
    return both.select(F.col("c_custkey").alias("work"), F.coalesce("open", F.lit(False)).alias("busy"))


@query("""SELECT n_name AS name, r_name AS grp, CAST(row_number() OVER (PARTITION BY r_name ORDER BY lower(n_name)) AS BIGINT) AS place FROM nation JOIN region ON n_regionkey = r_regionkey""")
def local_catalogue(spark, sf):
    from pyspark.sql import Window

    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    both = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # regions are a fixed handful
    return both.select(F.col("n_name").alias("name"), F.col("r_name").alias("grp"), F.row_number().over(Window.partitionBy("r_name").orderBy(F.lower("n_name"))).cast("long").alias("place"))


@query(with_views("still", "seen") + """, a AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'src0' ELSE source END AS work FROM documents UNION SELECT -1, 'src1')
SELECT a.work, a.id, seen.id IS NOT NULL AS visible FROM a LEFT JOIN seen ON seen.id = a.id AND seen.work = a.work""")
def visibility_probes(spark, sf):
    """Every still asked for, some under a work that isn't theirs, and one that isn't there."""
    s = stills(spark, sf)
    asked = s.select(F.when(F.col("id") % 9 == 0, "src0").otherwise(F.col("work")).alias("work"), "id")
    return op.probes(s, asked.unionByName(spark.createDataFrame([("src1", -1)], "work string, id long")))


@query("""SELECT DISTINCT source AS work, CASE WHEN source = 'src7' THEN NULL ELSE CAST(substr(source, 4) AS INTEGER) % 5 END AS season FROM documents WHERE source = 'src7' OR CAST(substr(source, 4) AS INTEGER) % 5 = 3""")
def unplaced_works(spark, sf):
    """Works of season 3, which isn't known, and one without a season."""
    s = stills(spark, sf).select("work", F.when(F.col("work") != "src7", F.col("season")).alias("season")).distinct()
    return op.unplaced(s, s.where("season <> 3").select("season").distinct()).select("work", "season")


@query("""WITH w AS (SELECT o_orderkey AS work, o_custkey AS series, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS episode, o_orderstatus AS title, o_orderkey % 7 AS place FROM orders)
SELECT x.work, y.work AS sibling, coalesce(y.episode, y.title) AS name, y.place FROM w x JOIN w y ON x.series = y.series AND x.work <> y.work""")
def sibling_works(spark, sf):
    """Orders as works, a customer's orders as a series."""
    k = F.col("o_orderkey")
    works = table(spark, sf, "orders").select(k.alias("work"), F.col("o_custkey").alias("series"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("episode_title"), F.col("o_orderstatus").alias("title"), (k % 7).alias("place"))
    return op.siblings(works)


@query(with_views("still") + """, w AS (SELECT source AS work, CASE WHEN source <> 'src4' THEN max(doc_id) END AS imported FROM documents GROUP BY source)
SELECT work, id FROM still JOIN w USING (work) WHERE selected AND review_state = 'unreviewed' AND NOT excluded ORDER BY imported DESC NULLS FIRST, work, ts NULLS LAST, id LIMIT 1""")
def next_unreviewed_anywhere(spark, sf):
    s = stills(spark, sf)
    works = s.groupBy("work").agg(F.max("id").alias("imported")).withColumn("imported", F.when(F.col("work") != "src4", F.col("imported")))
    return op.next_anywhere(s, works)
