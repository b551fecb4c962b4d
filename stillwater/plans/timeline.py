"""Queries over time and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.operators import intervals as op
from stillwater.operators import jobs as jb
from stillwater.plans.registry import query
from stillwater.sources.tables import jobs, table, with_views

DAY = 86400.0


def seconds(c="ts"):
    """Seconds since the month's start."""
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6) - F.lit(1704067200.0)


SEC = "(epoch_us(ts) / 1e6 - 1704067200e0)"


def spans(spark, sf, kind: str):
    """Two-hour intervals of each user's events of a kind."""
    e = table(spark, sf, "events").where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("src"), F.col("event_id").alias("id"), seconds().alias("s"), (seconds() + 7200).alias("e"), F.col("event_id").alias("ord"))


IV = f"WITH iv AS (SELECT user_id AS src, event_id AS id, {SEC} AS s, {SEC} + 7200 AS e, event_type AS kind FROM events)"
MERGED = """, m0 AS (SELECT src, id, greatest(0e0, s - {m}) AS s, e + {m} AS e FROM iv WHERE kind = 'view'),
m1 AS (SELECT *, max(e) OVER (PARTITION BY src ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m0),
m2 AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY src ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS island FROM m1),
merged AS (SELECT src, min(s) AS s, max(e) AS e, string_agg(CAST(id AS VARCHAR), ',' ORDER BY s, e, id) AS ids FROM m2 GROUP BY src, island)
"""


@query(IV + MERGED.format(m="0e0") + "SELECT src, round(s, 3) AS s, round(e, 3) AS e, ids FROM merged")
def interval_merge(spark, sf):
    return op.merge(spans(spark, sf, "view")).select("src", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"), "ids")


FREE = IV + MERGED.format(m="0e0") + """, span AS (SELECT DISTINCT src, 2678400e0 AS duration FROM iv),
f0 AS (SELECT src, e AS s, lead(s) OVER (PARTITION BY src ORDER BY s) AS e FROM merged UNION ALL SELECT span.src, 0e0, (SELECT min(s) FROM merged m WHERE m.src = span.src) FROM span),
free AS (SELECT src, s, least(coalesce(e, 2678400e0), 2678400e0) AS e FROM f0 WHERE least(coalesce(e, 2678400e0), 2678400e0) > s)
"""


def durations(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("src")).distinct().withColumn("duration", F.lit(31 * DAY))


@query(FREE + "SELECT src, round(s, 3) AS s, round(e, 3) AS e FROM free")
def free_regions(spark, sf):
    return op.free(op.merge(spans(spark, sf, "view")), durations(spark, sf)).select("src", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


@query(IV + MERGED.format(m="2e0") + """, t AS (SELECT src, id, s AS t FROM iv WHERE kind = 'click'),
k AS (SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.src = t.src AND t.t BETWEEN m.s AND m.e)),
h AS (SELECT k.src, k.id, min(p.id) AS held_by FROM k LEFT JOIN (SELECT * FROM iv WHERE kind = 'signup') p ON p.src = k.src AND k.t BETWEEN p.s AND p.e GROUP BY k.src, k.id)
SELECT src, id, CASE WHEN held_by IS NULL THEN 'cleared' ELSE 'held_unresolved' END AS status, held_by FROM h""")
def exclusion_status(spark, sf):
    t = spans(spark, sf, "click").select("src", "id", F.col("s").alias("t"))
    return op.status(t, spans(spark, sf, "view"), spans(spark, sf, "signup"))


def cuts(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("src"), seconds().alias("t"), F.col("value").alias("score"))


SHOTS = f""", cut AS (SELECT user_id AS src, {SEC} AS t, value AS score FROM events WHERE event_type = 'purchase'),
ends AS (SELECT * FROM cut UNION ALL SELECT DISTINCT user_id, 2678400e0, 0e0 FROM events),
s0 AS (SELECT src, lag(t, 1, 0e0) OVER w AS s, t AS e, lag(score, 1, 0e0) OVER w AS score FROM ends WINDOW w AS (PARTITION BY src ORDER BY t, score)),
shot AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY s) - 1 AS INTEGER) AS shot, s, e, score FROM s0 WHERE e > s)
"""


@query("WITH z AS (SELECT 1)" + SHOTS + "SELECT src, shot, round(s, 3) AS s, round(e, 3) AS e, score FROM shot")
def shots_from_boundaries(spark, sf):
    return op.shots(cuts(spark, sf), durations(spark, sf)).select("src", "shot", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"), "score")


@query(FREE + SHOTS + """, part AS (SELECT t.src, shot, greatest(t.s, f.s) + 0.5e0 AS a, least(t.e, f.e) - 0.5e0 AS b FROM shot t JOIN free f ON f.src = t.src AND t.s < f.e AND t.e > f.s),
n AS (SELECT *, CAST(greatest(1, least(3, 1 + floor((b - a) / 2e0))) AS INTEGER) AS n FROM part WHERE b > a)
SELECT src, shot, k, round(a + (b - a) / n * (k + 0.5e0), 3) AS t FROM n, (VALUES (0), (1), (2)) AS x(k) WHERE k < n""")
def shot_samples(spark, sf):
    out = op.samples(op.shots(cuts(spark, sf), durations(spark, sf)), op.free(op.merge(spans(spark, sf, "view")), durations(spark, sf)))
    return out.select("src", "shot", "k", F.round("t", 3).alias("t"))


@query(IV + """SELECT t.src, t.id, round(min(f.s), 3) AS frame FROM (SELECT * FROM iv WHERE kind = 'click') t LEFT JOIN (SELECT * FROM iv WHERE kind = 'view') f ON f.src = t.src AND f.s >= t.s GROUP BY t.src, t.id""")
def asof_next_frame(spark, sf):
    t, f = spans(spark, sf, "click"), spans(spark, sf, "view")
    return op.next_frame(t.select("src", "id", F.col("s").alias("t")), f.select("src", F.col("s").alias("f"))).withColumn("frame", F.round("frame", 3))


@query("""WITH c AS (SELECT l_orderkey AS src, l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN 'OP ' || l_linenumber WHEN 1 THEN 'Ending' WHEN 2 THEN 'Optional' ELSE '' END AS title,
  (l_linenumber - 1) * 200e0 AS s, (l_linenumber - 1) * 200e0 + 60 + l_quantity AS e, 1420e0 AS duration FROM lineitem),
k AS (SELECT *, CASE WHEN e - s >= 20 AND NOT (duration - (e - s) < 60) THEN
  CASE WHEN regexp_matches(title, '(?i)^(op|opening)(\\b|\\d)') THEN 'opening_theme:named' WHEN regexp_matches(title, '(?i)^(ed|ending|outro|credits?)(\\b|\\d)') THEN 'ending_theme:named'
  WHEN e - s BETWEEN 85 AND 95 AND s <= 360 THEN 'opening_theme:length-and-position' WHEN e - s BETWEEN 85 AND 95 AND duration - e <= 360 THEN 'ending_theme:length-and-position' END END AS kind FROM c)
SELECT src, id, kind, kind IS NOT NULL AND NOT (duration - sum(CASE WHEN kind IS NOT NULL THEN e - s ELSE 0e0 END) OVER (PARTITION BY src) < 60) AS held FROM k""".replace("\\\\", "\\"))
def chapter_classify(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    title = F.when(n % 4 == 0, F.concat(F.lit("OP "), n.cast("string"))).when(n % 4 == 1, "Ending").when(n % 4 == 2, "Optional").otherwise("")
    s = (n - 1) * F.lit(200.0)
    return op.chapters(li.select(F.col("l_orderkey").alias("src"), n.alias("id"), title.alias("title"), s.alias("s"), (s + 60 + F.col("l_quantity")).alias("e"), F.lit(1420.0).alias("duration")))


JOB = with_views("job")


@query(JOB + "SELECT stage, units % 2 = 0 AS film, round(percentile_cont(0.1) WITHIN GROUP (ORDER BY seconds), 6) AS low, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY seconds), 6) AS high FROM job GROUP BY stage, units % 2 = 0 HAVING count(*) >= 5")
def stage_percentiles(spark, sf):
    j = jobs(spark, sf).select("stage", (F.col("units") % 2 == 0).alias("film"), F.col("seconds").alias("rate"))
    return jb.usual_rates(j).select("stage", "film", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""WITH r AS (SELECT CASE event_type WHEN 'view' THEN 'extract' WHEN 'click' THEN 'analyze' WHEN 'signup' THEN 'derive' WHEN 'error' THEN 'import' ELSE 'palette' END AS stage, CASE WHEN event_id % 11 <> 0 THEN value END AS seconds,
  CAST(json_extract_string(props, '$.k') AS BIGINT) * 60e0 AS video, event_id % 30 AS selected FROM events WHERE event_id % 5 <> 0 AND event_id % 4 <> 3),
k AS (SELECT stage, count(*) AS n, sum(seconds) / (sum(video) / 60) AS rate, sum(selected) / (sum(video) / 60) AS stills FROM r WHERE seconds IS NOT NULL AND video > 0 GROUP BY stage)
SELECT max(n) FILTER (WHERE stage = 'analyze') AS runs, round(sum(rate) FILTER (WHERE stage <> 'palette'), 6) AS seconds_per_minute, round(max(stills) FILTER (WHERE stage = 'analyze'), 6) AS stills_per_minute FROM k HAVING bool_or(stage = 'extract') AND bool_or(stage = 'analyze')""")
def batch_estimates(spark, sf):
    """Onboarding stages by their cost; palette runs beside them don't count."""
    k = F.col("id")
    names = {"view": "extract", "click": "analyze", "signup": "derive", "error": "import"}
    stage = F.coalesce(*[F.when(F.col("stage") == a, b) for a, b in names.items()], F.lit("palette"))
    runs = jobs(spark, sf).select(
        stage.alias("stage"), F.when(k % 5 != 0, "committed").otherwise("running").alias("state"), F.when(k % 4 == 3, 2).otherwise(1).alias("attempt"),
        F.when(k % 11 != 0, F.col("seconds")).alias("seconds"), (F.col("units") * 60).alias("video"), (k % 30).alias("selected"),
    )
    return jb.batch_estimates(runs, ("extract", "analyze", "derive", "import"), "extract", "analyze").select("runs", F.round("seconds_per_minute", 6).alias("seconds_per_minute"), F.round("stills_per_minute", 6).alias("stills_per_minute"))


def queue(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*map(F.lit, ("queued", "retry_wait", "leased", "running", "committed", "dead_letter"))), (k % 6 + 1).cast("int"))
    day = lambda n: F.col("o_orderdate") + F.make_dt_interval(n)
    return o.select(
        k.alias("id"), F.when(k % 4 != 0, k - 1).alias("parent"), F.col("o_orderpriority").alias("capability"), state.alias("state"),
        F.when(k % 5 == 0, day(F.lit(30))).alias("not_before"), F.when(k % 6 >= 2, day(F.lit(10))).alias("lease"), F.col("o_orderdate").alias("created"), F.col("o_custkey").alias("work"),
    )


QUEUE = """WITH q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - 1 END AS parent, o_orderpriority AS capability,
  CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'retry_wait' WHEN 2 THEN 'leased' WHEN 3 THEN 'running' WHEN 4 THEN 'committed' ELSE 'dead_letter' END AS state,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS not_before, CASE WHEN o_orderkey % 6 >= 2 THEN o_orderdate + INTERVAL 10 DAY END AS lease, o_orderdate AS created, o_custkey AS work FROM orders),
ready AS (SELECT q.id, q.capability, q.created FROM q LEFT JOIN q p ON p.id = q.parent
  WHERE ((q.state IN ('queued', 'retry_wait') AND (q.not_before IS NULL OR q.not_before <= TIMESTAMP '1997-01-01')) OR (q.state IN ('leased', 'running') AND q.lease < TIMESTAMP '1997-01-01'))
  AND (q.parent IS NULL OR p.state = 'committed'))
"""


def now():
    return F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))


@query(QUEUE + "SELECT id, capability FROM ready")
def runnable_stages(spark, sf):
    return jb.runnable(queue(spark, sf), now()).select("id", "capability")


@query(QUEUE + "SELECT id, capability, row_number() OVER (PARTITION BY capability ORDER BY created, id) AS position, count(*) OVER (PARTITION BY capability) AS waiting FROM ready")
def machine_line(spark, sf):
    return jb.line(jb.runnable(queue(spark, sf), now()))


STATES = ("committed", "committed", "committed", "cancelled", "queued", "retry_wait", "running", "cancel_requested", "committed", "leased", "committed", "blocked", "committed")
STAGES = f"""WITH c AS (SELECT o_custkey AS work, o_custkey * 10 + o_orderkey % 3 AS chain, o_orderkey AS id, o_orderdate AS created, [{", ".join(f"'{s}'" for s in STATES)}][o_orderkey * 7 % {len(STATES)} + 1] AS state FROM orders)
"""


def stages(spark, sf):
    """The orders of a customer as up to three chains of its work, an order a stage."""
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*map(F.lit, STATES)), (k * 7 % len(STATES) + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("work"), (F.col("o_custkey") * 10 + k % 3).alias("chain"), k.alias("id"), F.col("o_orderdate").alias("created"), state.alias("state"))


@query(STAGES + """, g AS (SELECT chain, min(id) FILTER (WHERE state IN ('dead_letter', 'blocked', 'ineligible')) AS stuck, min(id) FILTER (WHERE state IN ('leased', 'running', 'cancel_requested')) AS live, min(id) FILTER (WHERE state NOT IN ('committed', 'cancelled')) AS next,
  bool_and(state = 'committed') AS done, bool_or(state = 'cancelled') AS cut, bool_or(state IN ('queued', 'leased', 'running', 'retry_wait', 'blocked', 'cancel_requested')) AS open, count(*) AS stages FROM c GROUP BY chain)
SELECT chain, CASE WHEN stuck IS NOT NULL THEN 'attention' WHEN live IS NOT NULL THEN 'running' WHEN done THEN 'done' WHEN cut AND NOT open THEN 'cancelled' ELSE 'waiting' END AS status, coalesce(stuck, live, next) AS current, stages FROM g""")
def chain_rollup(spark, sf):
    return jb.chain_group(stages(spark, sf).select("chain", F.col("id").alias("depth"), "id", "state"))


@query(STAGES + """, k AS (SELECT work, chain, max(created) AS created FROM c WHERE state = 'committed' GROUP BY work, chain)
SELECT work, chain, earlier FROM (SELECT work, chain, row_number() OVER (PARTITION BY work ORDER BY created DESC, chain) AS r, count(*) OVER (PARTITION BY work) - 1 AS earlier FROM k) WHERE r = 1""")
def newest_chain(spark, sf):
    return jb.newest(stages(spark, sf))


@query(QUEUE.replace("WITH q", "WITH RECURSIVE q") + """, up(id, node, parent, depth) AS (SELECT id, id, parent, 0 FROM q UNION ALL SELECT up.id, q.id, q.parent, depth + 1 FROM up JOIN q ON q.id = up.parent)
SELECT id, arg_max(node, depth) AS root, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY id""")
def chain_roots(spark, sf):
    return jb.roots(queue(spark, sf))


@query("""SELECT o_custkey AS target, string_agg(o_orderkey || ':' || n, ';' ORDER BY o_orderkey) AS removed FROM
(SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 200000 GROUP BY o_custkey, o_orderkey) GROUP BY o_custkey""")
def removals_nested(spark, sf):
    o, li = table(spark, sf, "orders").where("o_totalprice > 200000"), table(spark, sf, "lineitem")
    n = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    each = o.join(n, o["o_orderkey"] == n["l_orderkey"], "left").select("o_custkey", "o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "n"))), lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["n"].cast("string")))
    return each.groupBy(F.col("o_custkey").alias("target")).agg(F.array_join(listed, ";").alias("removed"))


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf):
    """An extra: tumbling windows."""
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, sf):
    """An extra: session windows."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = least(n - 1, round(0.05e0 * n)) THEN value END) AS p05, max(CASE WHEN i = least(n - 1, round(0.5e0 * n)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, round(0.95e0 * n)) THEN value END) AS p95 FROM r GROUP BY event_type""")
def luma_percentiles(spark, sf):
    """Nearest-rank percentiles, index round(p n): never between two values. Places are counted over ranges, so a common type is many tasks."""
    from stillwater.operators.catalog import placed
    from stillwater.operators.keep import few, kept

    r = kept(placed(table(spark, sf, "events").select("event_type", "value"), "event_type", "value"))
    n = r.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start"))
    at = lambda p: F.max(F.when(F.col("place") - F.col("start") == F.least(F.col("n") - 1, F.round(F.col("n") * F.lit(p))), F.col("value")))
    return r.join(few(n), "event_type").groupBy("event_type").agg(at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.95).alias("p95"))
