"""Queries of similarity in a scope, changes of tables, reading orders, and the queueing pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.functions import descriptor as de
from stillwater.functions import text as tx
from stillwater.operators import catalog as ca
from stillwater.operators import ingest as ing
from stillwater.operators import similar as si
from stillwater.operators import workflow as wf
from stillwater.plans.registry import query
from stillwater.sources.tables import stills, table, vectors, with_views


def placed_works(spark, sf):
    """Each label of the vectors as a work of a season; the seasons of every fourth have no franchise."""
    w, s = F.col("work"), F.col("work") % 4
    return vectors(spark, sf).select("work").distinct().select(w, s.alias("season"), F.when(s != 3, s % 2).alias("franchise"))


SCOPED = with_views("vec") + """, w AS (SELECT *, work % 4 AS season, CASE WHEN work % 4 <> 3 THEN work % 4 % 2 END AS franchise FROM vec)
"""
NEAR = """SELECT * FROM (SELECT '{0}' AS scope, x.id, x.work, x.season, x.franchise, round(list_dot_product(CAST(x.v AS DOUBLE[]), CAST(t.v AS DOUBLE[])), 6) AS similarity
 FROM w x, w t WHERE t.id = {1} AND x.id <> t.id AND {2} ORDER BY similarity DESC, x.id LIMIT 15)"""
SCOPES = {"all": "TRUE", "work": "x.work = t.work", "season": "x.season = t.season", "franchise": "CASE WHEN t.franchise IS NULL THEN x.season = t.season ELSE x.franchise = t.franchise END"}


@query(SCOPED + " UNION ALL ".join(NEAR.format(k, 5, c) for k, c in SCOPES.items()))
def similar_scoped(spark, sf):
    v, w = vectors(spark, sf), placed_works(spark, sf)
    out = None
    for scope in SCOPES:
        one = si.in_scope(v, w, v.where("id = 5"), scope, 15).select(F.lit(scope).alias("scope"), "id", "work", "season", "franchise", "similarity")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_views("tag") + """, m AS (SELECT id, t FROM tag WHERE t <> CASE WHEN id % 3 = 0 THEN 'that' ELSE '' END)
SELECT id, t AS tag FROM m UNION SELECT doc_id, 'added' FROM documents WHERE doc_id % 4 = 1 UNION SELECT doc_id, 'that' FROM documents WHERE doc_id % 12 = 5""")
def tag_overlay(spark, sf):
    """Tags after every third still lost one by hand, and others got one or two that they may have already."""
    k, lists = F.col("id"), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    human = F.struct(F.when(k % 3 == 0, lists("that")).alias("remove"), F.when(k % 12 == 5, lists("added", "that")).when(k % 4 == 1, lists("added")).alias("add"))
    return stills(spark, sf, tags=True).select("id", F.explode(ca.overlay_tags(F.col("tags"), human)).alias("tag"))


@query(with_views("still") + """SELECT 'visible' AS mode, id, work, row_number() OVER (PARTITION BY work ORDER BY ts, id) AS place FROM still WHERE selected AND review_state <> 'culled' AND NOT excluded
UNION ALL SELECT 'picked', id, work, row_number() OVER (PARTITION BY work ORDER BY ts, id) FROM still WHERE selected UNION ALL SELECT 'not_picked', id, work, row_number() OVER (PARTITION BY work ORDER BY ts, id) FROM still WHERE NOT selected""")
def work_stills_modes(spark, sf):
    s = stills(spark, sf)
    one = lambda m: ca.work_stills(s, m).select(F.lit(m).alias("mode"), "id", "work", "place")
    return one("visible").unionByName(one("picked")).unionByName(one("not_picked"))


LIBRARY = """WITH f AS (SELECT n_nationkey AS franchise, CASE WHEN n_nationkey % 4 <> 0 THEN lower(n_name) END AS sort_name, n_name AS name FROM nation),
s AS (SELECT s_suppkey AS season, s_nationkey AS franchise, CASE WHEN s_suppkey % 5 <> 0 THEN '19' || lpad(CAST(s_suppkey * 7 % 90 + 10 AS VARCHAR), 2, '0') END AS air, s_name AS name FROM supplier WHERE s_suppkey % 6 <> 1),
w AS (SELECT p_partkey AS work, (SELECT min(s_suppkey) FROM supplier) + p_partkey % (SELECT count(*) FROM supplier) AS season, CASE WHEN p_size % 7 <> 0 THEN p_size END AS episode, p_name AS label FROM part)
"""


@query(LIBRARY + """SELECT s.franchise, w.season, work, row_number() OVER (ORDER BY s.franchise IS NULL, CASE WHEN f.franchise IS NOT NULL THEN sort_name IS NULL END NULLS FIRST, sort_name NULLS FIRST, f.name NULLS FIRST, s.franchise NULLS FIRST, coalesce(air, CASE WHEN s.season IS NOT NULL THEN '9999' END) NULLS FIRST, s.name NULLS FIRST,
 w.season, coalesce(episode, 1e9), label, work) AS place FROM w LEFT JOIN s ON s.season = w.season LEFT JOIN f ON f.franchise = s.franchise""")
def library_order(spark, sf):
    n, s, p = (table(spark, sf, t) for t in ("nation", "supplier", "part"))
    k = F.col("n_nationkey")
    franchises = n.select(k.alias("franchise"), F.when(k % 4 != 0, F.lower("n_name")).alias("sort_name"), F.col("n_name").alias("name"))
    k = F.col("s_suppkey")
    air = F.when(k % 5 != 0, F.concat(F.lit("19"), F.lpad((k * 7 % 90 + 10).cast("string"), 2, "0")))
    seasons = s.where(k % 6 != 1).select(k.alias("season"), F.col("s_nationkey").alias("franchise"), air.alias("air_date"), F.col("s_name").alias("name"))
    edge = F.broadcast(s.agg(F.min("s_suppkey").alias("lo"), F.count(F.lit(1)).alias("all")))  # one row
    works = p.join(edge).select(F.col("p_partkey").alias("work"), (F.col("lo") + F.col("p_partkey") % F.col("all")).alias("season"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("episode"), F.col("p_name").alias("label"))
    return ca.library_order(works, seasons, franchises)


@query("""WITH w AS (SELECT c_custkey AS work, c_name AS label, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS unreviewed, max(o_orderdate) AS imported FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT work, row_number() OVER (ORDER BY unreviewed = 0, CASE WHEN unreviewed > 0 THEN -epoch_us(imported) END NULLS FIRST, CASE WHEN unreviewed = 0 THEN label END NULLS FIRST, work) AS place FROM w""")
def attention_order(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    n = o.groupBy(F.col("o_custkey").alias("work")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("unreviewed"), F.max("o_orderdate").cast("timestamp").alias("imported"))
    return ca.attention_order(c.select(F.col("c_custkey").alias("work"), F.col("c_name").alias("label")).join(n, "work", "left"))


@query("SELECT o_orderkey AS id, o_orderdate AS created FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12")
def recent_listings(spark, sf):
    """The report of the last twelve."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return ca.newest_first(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created")), "created")


def works_table(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("work"), F.col("c_name").alias("title"), F.lit("episode").alias("entry_type"), (k % 13).alias("episode"), F.when(k % 2 == 0, "old").alias("episode_title"), F.when(k % 6 != 5, k % 40).alias("series"),
        F.concat(F.lit("b"), (k % 7).cast("string")).alias("bundle"), F.lit("key").alias("repeats_key"), F.lit("typed").alias("title_human"), F.lit("2024-01-01").cast("timestamp").alias("imported_at"),
    )


@query("""WITH w AS (SELECT c_custkey AS k FROM customer), run AS (SELECT CASE WHEN k % 6 = 4 THEN k + (SELECT max(k) FROM w) ELSE k END AS k FROM w WHERE k % 3 = 1)
SELECT coalesce(w.k, r.k) AS work, CASE WHEN r.k IS NOT NULL THEN 'new' WHEN w.k % 2 = 0 THEN 'old' END AS episode_title, CASE WHEN r.k IS NULL THEN w.k % 13 WHEN r.k % 5 <> 0 THEN r.k % 11 END AS episode, CASE WHEN r.k IS NULL THEN 'key' END AS repeats_key, CASE WHEN w.k IS NOT NULL THEN 'typed' END AS title_human,
 CASE WHEN w.k IS NOT NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-06-01' END AS imported_at FROM w FULL JOIN run r ON r.k = w.k""")
def work_upsert(spark, sf):
    """A run over a third of the works, every other one of it under a new id; some come without an episode."""
    w = works_table(spark, sf)
    top = F.broadcast(w.agg(F.max("work").alias("top")))  # one row
    k = F.when(F.col("work") % 6 == 4, F.col("work") + F.col("top")).otherwise(F.col("work"))
    run = w.where("work % 3 = 1").join(top).withColumn("work", k).withColumns({"episode": F.when(F.col("work") % 5 != 0, F.col("work") % 11), "episode_title": F.lit("new")})
    return ing.upsert_works(w, run, F.lit("2024-06-01").cast("timestamp")).select("work", "episode_title", "episode", "repeats_key", "title_human", "imported_at")


LISTED = """WITH l AS (SELECT s_suppkey * CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE 1 END AS season, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, s_nationkey AS franchise FROM supplier WHERE s_suppkey % 3 <> 0),
f AS (SELECT franchise, count(*) AS n FROM l WHERE season >= 0 GROUP BY 1)
"""


@query(LISTED + """SELECT 'season' AS kind, coalesce(s.s_suppkey, l.season) AS id, CASE WHEN l.season IS NOT NULL THEN coalesce(l.name, CAST(l.season AS VARCHAR)) ELSE 'old' END AS name FROM (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) s FULL JOIN (SELECT * FROM l WHERE season >= 0) l ON l.season = s.s_suppkey
UNION ALL SELECT 'franchise', coalesce(n_nationkey, franchise), CASE WHEN franchise IS NOT NULL THEN CAST(franchise AS VARCHAR) ELSE n_name END FROM nation FULL JOIN f ON franchise = n_nationkey""")
def catalogue_sync(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    seasons = s.where(k % 2 == 0).select(k.alias("season"), F.lit(-1).cast("long").alias("franchise"), none.alias("kind"), none.alias("air_date"), F.lit("old").alias("name"))
    franchises = n.select(F.col("n_nationkey").cast("long").alias("franchise"), F.col("n_name").alias("name"), none.alias("sort_name"), F.lit(None).cast("timestamp").alias("synced_at"))
    listed = s.where(k % 3 != 0).select(
        (k * F.when(k % 7 == 0, -1).otherwise(1)).alias("season"), F.when(k % 4 != 0, F.col("s_name")).alias("name"), F.lit("TV").alias("kind"), F.lit("2001").alias("air_date"), F.col("s_nationkey").cast("long").alias("franchise"),
        none.alias("franchise_name"), none.alias("sort_name"),
    )
    a, b = ing.sync_catalogue(seasons, franchises, listed, F.lit("2024-01-01").cast("timestamp"))
    return a.select(F.lit("season").alias("kind"), F.col("season").alias("id"), "name").unionByName(b.select(F.lit("franchise").alias("kind"), F.col("franchise").alias("id"), "name"))


def repeating(spark, sf):
    """The stills with marks of the works that they repeat in, and their works; one series is not settled."""
    s = stills(spark, sf)
    marks = F.transform(F.sequence(F.lit(1), (F.col("id") % 7).cast("int")), lambda i: F.concat(F.lit("r"), i.cast("string")))
    s = s.withColumns({"repeat_in": F.when(F.col("id") % 7 > 0, marks).otherwise(F.array().cast("array<string>")), "reviewed_at": F.lit(None).cast("timestamp")})
    w = s.select("work", F.col("season").alias("series")).distinct().withColumn("bundle", F.lit("b"))
    keys = ca.series_keys(w).withColumnRenamed("key", "repeats_key")
    w = w.withColumn("grp", F.col("series").cast("string")).join(keys, "grp").withColumn("repeats_key", F.when(F.col("series") != 2, F.col("repeats_key")))
    return s, w.select("work", "series", "bundle", "repeats_key")


CULL = with_views("still") + """, o AS (SELECT season, count(DISTINCT work) - 1 AS others FROM still GROUP BY season HAVING season <> 2),
x AS (SELECT s.*, selected AND review_state = 'unreviewed' AND NOT excluded AND NOT locked AND work <> 'src1' AND others IS NOT NULL AND s.id % 7 >= greatest(2, ceil(others / 2)) AS take FROM still s LEFT JOIN o ON o.season = s.season)
"""


@query(CULL + "SELECT id, CASE WHEN coalesce(take, FALSE) THEN 'culled' ELSE review_state END AS review_state FROM x")
def cull_repeats(spark, sf):
    s, w = repeating(spark, sf)
    return ca.take_repeats(s, w, w.where("work <> 'src1'"), F.lit("2024-01-01").cast("timestamp")).select("id", "review_state")


@query(CULL + "SELECT id, CASE WHEN coalesce(take, FALSE) AND work = 'src3' THEN 'culled' ELSE review_state END AS review_state FROM x")
def cull_undone(spark, sf):
    """The batch is taken back in all works but one."""
    s, w = repeating(spark, sf)
    at = F.lit("2024-01-01").cast("timestamp")
    return ca.give_back(ca.take_repeats(s, w, w.where("work <> 'src1'"), at), w.where("work <> 'src3'"), at).select("id", "review_state")


STATES = ("committed", "cancelled", "dead_letter", "running", "blocked", "retry_wait", "queued")
KINDS = ("extract", "analyze", "derive", "discard", "import")
JOBS = f"""WITH j AS (SELECT o_orderkey AS id, o_custkey AS work, o_orderkey // 3 AS chain, [{", ".join(f"'{s}'" for s in KINDS)}][o_orderkey % 5 + 1] AS stage, [{", ".join(f"'{s}'" for s in STATES)}][o_orderkey * 11 % 7 + 1] AS state,
 o_orderkey % 4 AS attempt, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey - 1 END AS parent, o_orderpriority AS capability, o_orderkey * 2 AS file FROM orders)
"""


def jobs(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda i, of: F.element_at(F.array(*map(F.lit, of)), (i % len(of) + 1).cast("int"))
    return table(spark, sf, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("work"), F.floor(k / 3).alias("chain"), pick(k, KINDS).alias("stage"), pick(k * 11, STATES).alias("state"), (k % 4).alias("attempt"), F.when(k % 6 != 0, k - 1).alias("parent"),
        F.col("o_orderpriority").alias("capability"), (k * 2).alias("file"),
    )


def gallery(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").where(k % 3 == 0).select(k.alias("work"), (k * 4).alias("file"))


FILE_KINDS = ("Episode", "Special", "Credits", "Normal")


@query(JOBS + f""", f AS (SELECT l_orderkey // 2 AS episode, [{", ".join(f"'{s}'" for s in FILE_KINDS)}][l_orderkey // 2 % 4 + 1] AS kind, l_orderkey * 2 + l_linenumber % 2 AS file, bool_or(l_linenumber = 5) AS variation, bool_or(l_quantity > 48) AS blocked FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM f WHERE kind <> 'Credits'), c AS (SELECT file, min(chain) AS chain FROM j WHERE stage = 'extract' AND state NOT IN ('cancelled', 'dead_letter') GROUP BY file),
w AS (SELECT c_custkey AS work, c_custkey * 4 AS file FROM customer WHERE c_custkey % 3 = 0)
SELECT episode, g.file, work, chain, work IS NULL AND chain IS NULL AND NOT blocked AS open, work IS NULL AND chain IS NULL AND NOT blocked AND n = 1 AND NOT variation AS ready FROM g LEFT JOIN c ON c.file = g.file LEFT JOIN w ON w.file = g.file""")
def file_states(spark, sf):
    """Two lines of an order as files of an episode, which two orders share."""
    k = F.col("l_orderkey")
    e = F.floor(k / 2)
    kind = F.element_at(F.array(*map(F.lit, FILE_KINDS)), (e % 4 + 1).cast("int"))
    files = table(spark, sf, "lineitem").groupBy(e.alias("episode"), kind.alias("kind"), (k * 2 + F.col("l_linenumber") % 2).alias("file")).agg(F.bool_or(F.col("l_linenumber") == 5).alias("variation"), F.bool_or(F.col("l_quantity") > 48).alias("blocked"))
    return wf.file_states(files, gallery(spark, sf), jobs(spark, sf))


@query(JOBS + """, o AS (SELECT work, min(chain) AS lo, max(chain) AS hi FROM j WHERE stage = 'extract' AND state NOT IN ('cancelled', 'dead_letter') GROUP BY work), w AS (SELECT c_custkey AS work FROM customer WHERE c_custkey % 3 = 0)
SELECT id, CASE WHEN state NOT IN ('dead_letter', 'blocked', 'ineligible', 'retry_wait') THEN 'gone' WHEN stage = 'extract' AND state = 'dead_letter' AND (j.work IN (SELECT work FROM w) OR coalesce(lo <> chain OR hi <> chain, FALSE)) THEN 'taken'
 WHEN stage IN ('analyze', 'derive', 'import') AND j.work IN (SELECT work FROM j WHERE stage = 'discard' AND (state <> 'cancelled' OR attempt > 0)) THEN 'discarded' ELSE 'ok' END AS verdict FROM j LEFT JOIN o ON o.work = j.work""")
def retry_verdicts(spark, sf):
    return wf.retry_verdict(jobs(spark, sf), gallery(spark, sf))


@query(JOBS + """, live AS (SELECT DISTINCT capability FROM j WHERE state = 'running' AND id % 2 = 0 AND capability < '4')
SELECT j.id, CASE WHEN p.id IS NOT NULL AND p.state <> 'committed' THEN 'until done: ' || p.stage WHEN live.capability IS NULL THEN 'no worker is up: ' || j.capability WHEN j.state = 'retry_wait' THEN 'another try' ELSE 'a free worker' END AS text
FROM j LEFT JOIN j p ON p.id = j.parent LEFT JOIN live ON live.capability = j.capability WHERE j.state IN ('queued', 'retry_wait')""")
def waiting_texts(spark, sf):
    j = jobs(spark, sf)
    return wf.waiting_for(j, j.where("state = 'running' AND id % 2 = 0 AND capability < '4'").select("capability"))


@query("""WITH w AS (SELECT user_id AS worker, ts AS seen, event_id % 3 = 0 AS standby, unnest(CASE WHEN event_id % 4 = 0 THEN [event_type] ELSE [event_type, 'source'] END) AS capability FROM events)
SELECT capability, arg_max(worker, (seen, worker)) AS worker FROM w WHERE NOT standby AND seen > (SELECT max(ts) FROM events) - INTERVAL 172800 SECOND GROUP BY capability""")
def regular_workers(spark, sf):
    """The events as workers checking in; now is the last event, and two days count as just now."""
    e = table(spark, sf, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    caps = F.when(F.col("event_id") % 4 == 0, F.array("event_type")).otherwise(F.array("event_type", F.lit("source")))
    rows = e.join(now).select(F.col("user_id").alias("worker"), F.col("ts").alias("seen"), (F.col("event_id") % 3 == 0).alias("standby"), caps.alias("capabilities"), "now")
    return wf.regular_workers(rows, F.col("now"), 172_800)


@query("""SELECT DISTINCT 'root' || event_type || event_id % 17 AS name FROM events WHERE event_id % 4 <> 0 AND event_id % 5 <> 0 AND event_id % 17 <> 3""")
def source_roots(spark, sf):
    k = F.col("event_id")
    name = F.concat(F.when(k % 17 == 3, "-").otherwise(""), F.lit("root"), "event_type", (k % 17).cast("string"))
    caps = F.when(k % 4 == 0, F.array("event_type")).otherwise(F.array("event_type", F.lit("source")))
    return wf.source_roots(table(spark, sf, "events").select(caps.alias("capabilities"), F.when(k % 5 != 0, F.array(name)).alias("roots")))


@query("""WITH f AS (SELECT l_suppkey AS work, l_orderkey * 10 + l_linenumber AS name, CAST(l_quantity AS BIGINT) AS bytes, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AS k FROM lineitem)
SELECT work, count(*) FILTER (WHERE k) AS kept, CAST(coalesce(sum(bytes) FILTER (WHERE k), 0) AS BIGINT) AS kept_bytes, count(*) FILTER (WHERE NOT k) AS extra, CAST(coalesce(sum(bytes) FILTER (WHERE NOT k), 0) AS BIGINT) AS extra_bytes FROM f GROUP BY work""")
def disk_usage(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    files = li.select("l_orderkey", F.col("l_suppkey").alias("work"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("name"), F.col("l_quantity").cast("long").alias("bytes"))
    return wf.frames_on_disk(files.drop("l_orderkey"), files.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"))


@query("""SELECT c_custkey AS work, count(o_orderkey) AS stills, count(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS picked, count(o_orderkey) FILTER (WHERE o_orderkey * 11 % 7 >= 3) AS open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def held_counts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("work"), (F.col("o_orderkey") % 2 == 0).alias("selected"))
    return wf.held_counts(table(spark, sf, "customer").select(F.col("c_custkey").alias("work")), o, jobs(spark, sf))


OUTCOMES = ("published", "held", "duplicate", "capacity")


@query(f"""SELECT l_suppkey AS src, {", ".join(f"count(*) FILTER (WHERE l_linenumber % 5 = {i}) AS {k}" for i, k in enumerate(OUTCOMES))} FROM lineitem GROUP BY 1""")
def extraction_tally(spark, sf):
    k = F.col("l_linenumber") % 5
    outcome = F.element_at(F.array(*map(F.lit, (*OUTCOMES, "unprocessed"))), (k + 1).cast("int"))
    return wf.tally(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), outcome.alias("outcome")), OUTCOMES)


@query("""SELECT o_orderkey AS id, o_totalprice / 1000 > 0 AND o_orderkey % 40 * 10 > o_totalprice / 1000 AS whole FROM orders""")
def decode_choice(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), wf.whole_decode(F.col("o_orderkey") % 40, F.col("o_totalprice") / 1000).alias("whole"))


@query()
def held_picks(spark, sf):
    """Suppliers as sources, parts as shots, lines as samples; a third of them does not resolve and some shots share frames."""
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return wf.held_picks(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("shot"), k.alias("id"), k.cast("double").alias("ts"), F.when(k % 3 != 0, k % 50).alias("pts")))


def palettes(spark, sf):
    """The lines of an order as its colours."""
    li = table(spark, sf, "lineitem")
    c = F.struct(
        F.col("l_linenumber").alias("k"), (F.col("l_partkey") * 37 % 360).cast("double").alias("hue"), (F.col("l_discount") * 9.71 + 0.0131).alias("sat"), (F.col("l_suppkey") % 101 / F.lit(100.0)).alias("luma"),
        ((F.col("l_quantity") + F.col("l_partkey") % 7) / F.lit(93.0)).alias("weight"), (F.col("l_tax") * 1.013 - 0.0413).alias("cb"), (F.col("l_tax") * F.lit(-0.5037)).alias("cr"), (F.col("l_linenumber") % 3 == 0).alias("accent"),
    )
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(c)).alias("c"))


COLOURS = """WITH c AS (SELECT l_orderkey AS id, l_linenumber AS k, CAST(l_partkey * 37 % 360 AS DOUBLE) AS hue, l_discount * 9.71e0 + 0.0131e0 AS sat, l_suppkey % 101 / 100e0 AS luma, (l_quantity + l_partkey % 7) / 93e0 AS weight, l_tax * 1.013e0 - 0.0413e0 AS cb, l_tax * -0.5037e0 AS cr, l_linenumber % 3 = 0 AS accent FROM lineitem),
live AS (SELECT *, weight * (0.25e0 + sat) AS w FROM c WHERE sat >= 0.08e0 AND luma BETWEEN 0.1e0 AND 0.94e0)
"""


@query(COLOURS + f""", band AS (SELECT band, hue AS mid FROM (VALUES {", ".join(f"({i}, {h}e0)" for i, h in enumerate(de.BANDS))}) AS b(band, hue)), ids AS (SELECT DISTINCT id FROM c),
raw AS (SELECT ids.id, band, coalesce(sum(greatest(0e0, 1e0 - least(abs(mid - hue), 360e0 - abs(mid - hue)) / 75e0) * w), 0e0) AS s FROM ids CROSS JOIN band LEFT JOIN live ON live.id = ids.id GROUP BY ids.id, band)
SELECT id, band, round(CASE WHEN sum(s) OVER (PARTITION BY id) > 1e-6 THEN s / sum(s) OVER (PARTITION BY id) ELSE s END, 9) AS support FROM raw""")
def hue_supports(spark, sf):
    p = palettes(spark, sf).select("id", F.posexplode(de.hue_supports(F.col("c"))).alias("band", "support"))
    return p.withColumn("support", F.round("support", 9))


@query(COLOURS + """SELECT ids.id, round(coalesce(sum(sat * w) / sum(w), 0e0), 6) AS chroma, round(coalesce(sum(cb * w) / sum(w), 0e0) + 1, 6) AS cb, round(coalesce(sum(cr * w) / sum(w), 0e0) + 1, 6) AS cr FROM (SELECT DISTINCT id FROM c) ids LEFT JOIN live ON live.id = ids.id GROUP BY ids.id""")
def palette_temperature(spark, sf):
    """Mean chroma, and temperature as blue and red difference from 1 on."""
    mean = lambda n: de.weighted_mean(F.col("c"), n)
    return palettes(spark, sf).select("id", F.round(mean("sat"), 6).alias("chroma"), F.round(mean("cb") + 1, 6).alias("cb"), F.round(mean("cr") + 1, 6).alias("cr"))


@query(COLOURS + ", s AS (SELECT *, CASE WHEN accent THEN greatest(weight, 0.06e0) ELSE weight END AS w FROM c) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k, hue, sat, luma, weight, cb, cr) - 1 AS INTEGER) AS place, round(w / sum(w) OVER (PARTITION BY id), 9) AS share FROM s")
def strip_shares(spark, sf):
    p = palettes(spark, sf).select("id", F.posexplode(de.strip_shares(F.col("c"))).alias("place", "share"))
    return p.withColumn("share", F.round("share", 9))


NAMED = """WITH n AS (SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'The ' WHEN 1 THEN 'an  ' WHEN 2 THEN 'Theory ' ELSE '' END || replace(url, '/', CASE WHEN page_id % 3 = 0 THEN '\\' ELSE '/' END) || CASE WHEN page_id % 5 = 0 THEN ' ..' ELSE '' END AS name FROM pages)
"""


@query(NAMED + r"""SELECT id, regexp_replace(name, '^(?i:the|an?)\s+', '') AS sort_name, trim(substr(regexp_replace(regexp_replace(regexp_replace(name, '[<>:"/\\|?*\x00-\x1f\x7f]', '-', 'g'), '\s+', '-', 'g'), '-{2,}', '-', 'g'), 1, 60), '-. ') AS folder,
 CASE WHEN NOT list_has_any(string_split(replace(name, '\', '/'), '/'), ['.', '..']) THEN array_to_string(list_filter(string_split(trim(replace(name, '\', '/')), '/'), lambda p: p <> ''), '/') END AS path FROM n""")
def cleaned_names(spark, sf):
    k = F.col("page_id")
    first = F.when(k % 4 == 0, "The ").when(k % 4 == 1, "an  ").when(k % 4 == 2, "Theory ").otherwise("")
    name = F.concat(first, F.translate("url", "/", "\\"), F.when(k % 5 == 0, " ..").otherwise("")), F.concat(first, "url", F.when(k % 5 == 0, " ..").otherwise(""))
    rows = table(spark, sf, "pages").select(k.alias("id"), F.when(k % 3 == 0, name[0]).otherwise(name[1]).alias("name"))
    return rows.select("id", tx.sort_name(F.col("name")).alias("sort_name"), tx.folder_name(F.col("name")).alias("folder"), tx.clean_path(F.col("name")).alias("path"))
