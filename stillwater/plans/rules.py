"""Queries of label rules, names, accuracy, imports and the job protocol."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.functions import detect as dt
from stillwater.functions import labels as lb
from stillwater.functions import text as tx
from stillwater.operators import accuracy as ac
from stillwater.operators import frames as fr
from stillwater.operators import ingest as ing
from stillwater.operators import review as rv
from stillwater.operators.keep import few
from stillwater.plans.registry import query
from stillwater.sources.tables import stills, table, with_views
from stillwater.streaming import jobs as jobs_stream


def checks(spark, sf):
    """Labels as checks: quality is what the machine said, toxic what the reviewer said where they answered."""
    x, d = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "lang", "source")
    word = lambda c: F.when(F.col(c) == 1, "yes").when(F.col("doc_id") % 4 != 1, "no")
    return x.join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("family"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"), word("quality").alias("machine"), (F.col("doc_id") % 3 != 0).alias("answered"), word("toxic").alias("human"))


CHECK = """WITH c0 AS (SELECT l.doc_id AS id, lang AS family, coalesce(CASE WHEN l.doc_id % 5 <> 0 THEN source END, 'not recorded') AS source,
  CASE WHEN quality = 1 THEN 'yes' WHEN l.doc_id % 4 <> 1 THEN 'no' END AS machine, l.doc_id % 3 <> 0 AS answered, CASE WHEN toxic = 1 THEN 'yes' WHEN l.doc_id % 4 <> 1 THEN 'no' END AS human
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
c AS (SELECT *, CASE WHEN answered THEN human ELSE machine END AS truth FROM c0),
j AS (SELECT *, CASE WHEN machine IS NOT NULL AND truth = machine THEN 'agreed' WHEN machine IS NOT NULL AND truth IS NOT NULL THEN 'corrected' WHEN machine IS NOT NULL THEN 'cleared' WHEN truth IS NOT NULL THEN 'missed' ELSE 'none' END AS kind FROM c)
"""
KINDS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("agreed", "corrected", "cleared", "missed", "none"))


@query(CHECK + f"SELECT family, count(*) AS checked, count(machine) AS proposed, {KINDS}, round(count(*) FILTER (WHERE kind = 'agreed') / CAST(nullif(count(machine), 0) AS DOUBLE), 6) AS agreement FROM j GROUP BY family")
def label_accuracy(spark, sf):
    return ac.report(checks(spark, sf))


@query(CHECK + """SELECT family, source, machine, count(*) AS n, count(*) FILTER (WHERE kind = 'agreed') AS agreed, CAST(grouping(family) * 4 + grouping(source) * 2 + grouping(machine) AS INTEGER) AS level
FROM j WHERE machine IS NOT NULL GROUP BY ROLLUP (family, source, machine) HAVING grouping(family) = 0""")
def label_accuracy_by_value(spark, sf):
    return ac.by_value(checks(spark, sf))


@query(CHECK + """SELECT family, source, machine, coalesce(truth, 'none') AS "to", count(*) AS n FROM j WHERE machine IS NOT NULL AND kind <> 'agreed' GROUP BY 1, 2, 3, 4""")
def label_corrections(spark, sf):
    return ac.corrections(checks(spark, sf))


@query(CHECK + """, r AS (SELECT doc_id AS id, lang AS family, CASE WHEN n_chars % 3 = 0 THEN 'yes' WHEN n_chars % 3 = 1 THEN 'no' END AS label FROM documents WHERE doc_id % 11 <> 0),
b AS (SELECT c.*, r.label, r.id IS NOT NULL AS known FROM c LEFT JOIN r ON r.id = c.id AND r.family = c.family)
SELECT family, count(label) AS answered, count(*) FILTER (WHERE label = truth) AS "right", count(*) FILTER (WHERE known AND label IS NULL AND truth IS NOT NULL) AS missed,
count(*) FILTER (WHERE known AND truth IS NOT NULL) AS truths, count(*) FILTER (WHERE NOT known) AS unmatched FROM b GROUP BY family""")
def candidate_score(spark, sf):
    d = table(spark, sf, "documents").where("doc_id % 11 <> 0")
    run = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("family"), F.when(F.col("n_chars") % 3 == 0, "yes").when(F.col("n_chars") % 3 == 1, "no").alias("label"))
    return ac.score(checks(spark, sf), run)


@query(CHECK + "SELECT family, truth AS value, count(*) AS n FROM j WHERE kind = 'missed' GROUP BY 1, 2")
def label_filled(spark, sf):
    return ac.filled(checks(spark, sf))


@query(CHECK + """, s AS (SELECT *, CASE WHEN id % 3 <> 1 THEN CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END END AS suggested, CASE WHEN answered THEN human END AS said FROM c)
SELECT family, count(*) AS n, count(*) FILTER (WHERE said = suggested) AS accepted, count(*) FILTER (WHERE said <> suggested) AS changed, count(*) FILTER (WHERE said IS NULL) AS unanswered
FROM s WHERE machine IS NULL AND suggested IS NOT NULL GROUP BY family""")
def label_suggestions(spark, sf):
    c = checks(spark, sf)
    return ac.suggestions(c.withColumn("suggested", F.when(F.col("id") % 3 != 1, F.when(F.col("id") % 2 == 0, "yes").otherwise("no"))))


@query("""SELECT lang AS taxonomy, CASE WHEN l.doc_id % 3 <> 0 THEN source END AS allowlist, CAST(l.doc_id % 2 AS VARCHAR) AS fusion, CASE WHEN l.doc_id % 5 <> 0 THEN l.doc_id % 4 / 10e0 END AS tag_cut, CASE WHEN l.doc_id % 5 <> 0 THEN 0.25e0 END AS scene_cut, count(*) AS n
FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, 2, 3, 4, 5""")
def check_runs(spark, sf):
    k = F.col("doc_id")
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    cuts = lambda x: F.when(k % 5 != 0, x)
    return ac.runs(rows.select(F.col("lang").alias("taxonomy"), F.when(k % 3 != 0, F.col("source")).alias("allowlist"), (k % 2).cast("string").alias("fusion"), cuts(k % 4 / F.lit(10.0)).alias("tag_cut"), cuts(F.lit(0.25)).alias("scene_cut")))


@query("""SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_quantity - 45 <= 0 THEN 'zero' WHEN l_quantity = 46 THEN 'one' WHEN l_quantity = 47 THEN 'two' WHEN l_quantity <= 50 THEN 'small-group' ELSE 'crowd' END AS people FROM lineitem""")
def people_bucket(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), lb.people_bucket(F.col("l_quantity") - 45).alias("people"))


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'medium' ELSE 'abstain' END AS tag, p_size / 100e0 AS ts, CASE WHEN p_size % 3 = 0 THEN p_size * p_size / 5000e0 END AS face, p_size % 7 = 0 AS scenery, CASE WHEN p_size % 2 = 0 THEN p_size / 50e0 END AS head FROM part)
SELECT id, CASE WHEN tag <> 'abstain' THEN tag WHEN face > 0 THEN CASE WHEN face >= 0.14e0 THEN 'close-up' WHEN face >= 0.009e0 THEN 'medium' ELSE 'wide' END WHEN scenery THEN 'wide'
 WHEN head > 0 THEN CASE WHEN head >= 0.72e0 THEN 'close-up' WHEN head >= 0.19e0 THEN 'medium' ELSE 'wide' END ELSE 'abstain' END AS value,
CASE WHEN tag <> 'abstain' THEN ts WHEN face > 0 THEN CASE WHEN abs(log10(face) - log10(0.14e0)) < 0.15e0 OR abs(log10(face) - log10(0.009e0)) < 0.15e0 THEN 0.35e0 ELSE 0.55e0 END WHEN scenery THEN 0.3e0
 WHEN head > 0 THEN CASE WHEN abs(head - 0.72e0) < 0.05e0 OR abs(head - 0.19e0) < 0.05e0 THEN 0.25e0 ELSE 0.3e0 END ELSE 0e0 END AS score,
CASE WHEN tag <> 'abstain' THEN 'tagger' WHEN face > 0 THEN 'face-occupancy' WHEN scenery THEN 'scenery' WHEN head > 0 THEN 'head-height' ELSE 'none' END AS lane FROM p""")
def shot_scale_lane(spark, sf):
    k = F.col("p_size")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(k % 5 == 0, "medium").otherwise("abstain").alias("tag"), (k / F.lit(100.0)).alias("ts"), F.when(k % 3 == 0, k * k / F.lit(5000.0)).alias("face"), (k % 7 == 0).alias("scenery"), F.when(k % 2 == 0, k / F.lit(50.0)).alias("head"))
    return p.select("id", lb.shot_scale(*[F.col(c) for c in ("tag", "ts", "face", "scenery", "head")]).alias("s")).select("id", "s.*")


@query("""WITH b AS (SELECT l_orderkey AS id, l_linenumber % 4 = 0 AS text, l_discount * 60 AS entropy, l_linenumber % 5 = 0 AS sym, l_quantity AS w, l_suppkey % 90 AS x FROM lineitem),
best AS (SELECT id, bool_or(text) AS text, min(entropy) AS entropy, bool_or(sym) AS sym, arg_max((x + x + w) / 2 / 100e0, w * w * 1000 + x) AS x FROM b GROUP BY id)
SELECT id, CASE WHEN text AND entropy < 3 THEN 'abstain' WHEN sym THEN 'symmetrical' WHEN abs(x - 0.5e0) <= 0.06e0 THEN 'centered' WHEN least(abs(x - 1e0 / 3), abs(x - 2e0 / 3)) <= 0.06e0 THEN 'rule-of-thirds' ELSE 'abstain' END AS composition FROM best""", also=("composition_verdict_all",))
def composition_verdict(spark, sf):
    """From all lines of an order."""
    return verdicts_of(table(spark, sf, "lineitem"))


def verdicts_of(li):
    x, w = (F.col("l_suppkey") % 90).cast("double"), F.col("l_quantity")
    box = F.struct(x.alias("x0"), F.lit(0.0).alias("y0"), (x + w).alias("x1"), w.alias("y1"))
    g = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_or(F.col("l_linenumber") % 4 == 0).alias("text"), F.min(F.col("l_discount") * 60).alias("entropy"), F.bool_or(F.col("l_linenumber") % 5 == 0).alias("sym"), F.collect_list(box).alias("boxes"))
    return g.select("id", lb.composition(F.col("text"), F.col("entropy"), F.col("sym"), lb.largest_box_x(F.col("boxes"), 100.0)).alias("composition"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size / 100e0 AS w1, (50 - p_size) / 100e0 AS c1, p_size % 11 / 10e0 AS sat, p_size / 50e0 AS mean FROM part),
q AS (SELECT *, w1 + 0.1e0 AS warm, c1 + 0.1e0 AS cool FROM p)
SELECT id, CASE WHEN sat < 0.12e0 THEN 'monochrome' WHEN warm >= 0.25e0 AND cool >= 0.25e0 THEN 'mixed' WHEN warm - cool >= 0.35e0 THEN 'warm' WHEN warm - cool <= -0.35e0 THEN 'cool' ELSE 'neutral' END AS bias,
CASE WHEN sat < 0.3e0 THEN 'muted' WHEN sat > 0.6e0 THEN 'vivid' ELSE 'balanced' END AS saturation,
CASE WHEN mean < 0.3e0 AND mean + 0.2e0 < 0.75e0 THEN 'low-key' WHEN mean > 0.65e0 AND mean - 0.2e0 > 0.3e0 THEN 'high-key' ELSE 'abstain' END AS lighting FROM q""")
def palette_labels(spark, sf):
    k, z = F.col("p_size"), F.lit(0.0)
    bands = F.array(k / F.lit(100.0), F.lit(0.1), z, F.lit(0.3), (50 - k) / F.lit(100.0), F.lit(0.1), z, z)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), bands.alias("bands"), (k % 11 / F.lit(10.0)).alias("sat"), (k / F.lit(50.0)).alias("mean"))
    return p.select("id", lb.color_bias(F.col("bands"), F.col("sat"))["value"].alias("bias"), lb.saturation_word(F.col("sat")).alias("saturation"), lb.lighting(F.col("mean"), F.col("mean") - 0.2, F.col("mean") + 0.2).alias("lighting"))


@query("""WITH f AS (SELECT l_orderkey AS id, l_linenumber AS n, l_discount * 9.7e0 AS luma, l_tax / 7 AS spread, l_tax / 11 AS detail, l_quantity / 10 AS entropy FROM lineitem)
SELECT id, n, CASE WHEN luma > 0.1e0 AND luma < 0.9e0 OR detail >= 0.005e0 AND entropy >= 2.5e0 THEN 'cleared' WHEN spread > 0.005e0 THEN 'review' ELSE 'blank' END AS disposition FROM f""")
def quality_floor(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), lb.quality_floor(F.col("l_discount") * 9.7, F.col("l_tax") / 7, F.col("l_tax") / 11, F.col("l_quantity") / 10).alias("disposition"))


@query("""SELECT id, k FROM (SELECT p_partkey AS id, unnest([CASE WHEN p_size % 4 = 0 THEN 'text' END, CASE WHEN p_size % 10 / 50e0 >= 0.1e0 THEN 'rating' END, CASE WHEN p_size % 3 = 0 AND p_size / 100e0 < 0.35e0 THEN 'unsure' END,
 CASE WHEN p_size % 5 <> 0 THEN CASE WHEN p_size % 20 / 40e0 < 0.35e0 THEN CASE WHEN p_size % 2 = 0 THEN 'head' ELSE 'scale' END WHEN p_size % 7 = 0 THEN 'split' END END]) AS k FROM part) WHERE k IS NOT NULL""")
def review_reasons(spark, sf):
    k = F.col("p_size")
    tags = F.when(k % 4 == 0, F.array(F.lit("logo"))).otherwise(F.array().cast("array<string>"))
    kinds = lb.review_reasons(tags, k % 10 / F.lit(50.0), F.when(k % 3 == 0, "night").otherwise("abstain"), k / F.lit(100.0), F.when(k % 5 != 0, "wide").otherwise("abstain"), k % 20 / F.lit(40.0), F.when(k % 2 == 0, "head-height").otherwise("scenery"), k % 7 != 0)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(kinds).alias("k"))


@query("""WITH w AS (SELECT p_partkey AS id, p_size * 47 AS width, p_size * 26 AS height FROM part)
SELECT DISTINCT id, least(t, width) AS tier, CAST(CASE WHEN least(t, width) = width THEN height ELSE greatest(1, round_even(CAST(height * least(t, width) AS DOUBLE) / width, 0)) END AS INTEGER) AS height FROM w, (VALUES (320), (640), (960), (1920)) AS x(t)""")
def tier_ladder(spark, sf):
    w = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 47).alias("width"), (F.col("p_size") * 26).alias("h"))
    w = w.select("id", "width", "h", F.explode(lb.tier_widths(F.col("width"))).alias("tier"))
    return w.select("id", "tier", lb.tier_height(F.col("width"), F.col("h"), F.col("tier")).alias("height"))


SLUG = r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(lower(strip_accents(translate(url, 'eow', 'éÔw'))), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g') AS s FROM pages),
t AS (SELECT page_id, regexp_replace(trim(s, '-'), '^the-', '') AS s FROM n),
slug AS (SELECT page_id, CASE WHEN s = '' THEN 'work' WHEN length(s) > 60 THEN regexp_replace(substr(s, 1, 61), '-[^-]*$', '') ELSE s END AS s FROM t)
"""


def accented(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.translate("url", "eow", "éÔw").alias("name"))


@query(SLUG + "SELECT page_id AS id, s AS slug FROM slug")
def work_slug(spark, sf):
    return accented(spark, sf).select("id", tx.slug(F.col("name")).alias("slug"))


@query(SLUG + """SELECT page_id AS id, s || CASE WHEN page_id % 3 = 0 AND page_id % 5 <> 0 THEN printf('-e%02d', page_id % 120) WHEN page_id % 3 = 1 AND page_id % 2 = 0 THEN '-part-' || page_id % 9
 WHEN page_id % 3 = 1 AND page_id % 5 <> 0 THEN '-part-' || page_id % 120 ELSE '' END AS work FROM slug""")
def work_ids(spark, sf):
    """Episodes with and without a number; films with a named part, with one of signs alone, with none of both."""
    k = F.col("id")
    kind = F.when(k % 3 == 0, "episode").when(k % 3 == 1, "movie").otherwise("clip")
    part = F.when(k % 2 == 0, F.concat(F.lit("Part "), (k % 9).cast("string"))).otherwise("!")
    return accented(spark, sf).select("id", tx.work_id(F.col("name"), kind, F.when(k % 5 != 0, k % 120), part).alias("work"))


NAMES = ("'[Grp] Title S01E' || lpad(n, 2, '0') || ' (1080p).mkv'", "'Title - ' || n || ' [x].mkv'", "'Show Ep ' || n || ' 4K.mp4'", "'Film 1999 2160p 12 7.mkv'", "'Show.s2e' || n || '.720p.mkv'", "'Show #' || n || ' 5.1.mkv'", "'Show ' || n || ' 60 fps.mkv'", "'Show – ' || lpad(n, 2, '0') || 'v2.mkv'")


@query("""SELECT p_partkey AS id, CASE p_size % 8 WHEN 3 THEN NULL ELSE p_size END AS episode, p_size % 8 = 5 AS extra FROM part""")
def episode_guess(spark, sf):
    """File names of eight kinds; the fourth has several bare numbers and tells none."""
    p = table(spark, sf, "part").select("p_partkey", "p_size").repartition("p_partkey").withColumn("n", F.col("p_size").cast("string"))  # a small file is one task, and names are slow
    name = F.element_at(F.array(*map(F.expr, NAMES)), (F.col("p_size") % 8 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), tx.guess_episode(name).alias("episode"), tx.looks_extra(F.when(F.col("p_size") % 8 == 5, F.concat(F.lit("[G] NCOP2 "), name)).otherwise(name)).alias("extra"))


@query("""SELECT event_id AS id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock, printf('E%02d', event_id % 130) AS code
FROM (SELECT event_id, CAST(floor(value * 40 + 0.5e0) AS BIGINT) AS s FROM events)""")
def time_format(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), tx.clock(F.col("value") * 40).alias("clock"), tx.episode_code(F.col("event_id") % 130).alias("code"))


@query("""SELECT 'fam' || event_type AS kind, CAST(greatest(35, least(300, round_even(count(DISTINCT user_id) * 0.15e0 * 1.1e0, 0))) AS INTEGER) AS budget FROM events GROUP BY event_type""")
def publish_budget(spark, sf):
    return table(spark, sf, "events").groupBy(F.concat(F.lit("fam"), "event_type").alias("kind")).agg(lb.publish_budget(F.count_distinct("user_id")).alias("budget"))


@query(r"""WITH k AS (SELECT page_id, url, array_to_string(list_transform(regexp_extract_all(lower(url), '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN CASE WHEN length(p) > 10 THEN '0000000000' || p ELSE lpad(p, 10, '0') END ELSE p END), '') AS key FROM pages)
SELECT page_id AS id, row_number() OVER (ORDER BY key, url, page_id) AS place FROM k""", also=("natural_order_all",))
def natural_order(spark, sf):
    return in_natural_order(table(spark, sf, "pages"))


def in_natural_order(pages):
    from stillwater.operators.catalog import placed

    rows = pages.select(F.col("page_id").alias("id"), "url", tx.natural_key(F.col("url")).alias("key"))
    return placed(rows, "key", "url", "id").select("id", "place")


@query(with_views("still") + """, run AS (SELECT CASE WHEN id % 8 = 2 THEN id + (SELECT max(id) + 1 FROM still) ELSE id END AS id, CASE WHEN id % 2 = 0 THEN work ELSE 'src0' END AS work, ts + 1 AS ts, TRUE AS selected FROM still WHERE id % 3 <> 2 AND work <> 'src3')
, works AS (SELECT DISTINCT work FROM run)
SELECT coalesce(t.id, r.id) AS id, coalesce(r.work, t.work) AS work, coalesce(r.ts, t.ts) AS ts,
CASE WHEN r.id IS NOT NULL THEN r.selected WHEN t.work IN (SELECT work FROM works) THEN FALSE ELSE t.selected END AS selected,
coalesce(t.review_state, 'unreviewed') AS review_state, coalesce(t.locked, FALSE) AS locked
FROM still t FULL JOIN run r ON r.id = t.id
WHERE NOT (r.id IS NULL AND t.work IN (SELECT work FROM works) AND t.review_state = 'unreviewed' AND NOT t.locked AND NOT t.excluded)
""", also=("import_merge_all",))
def import_merge(spark, sf):
    """A run into the whole table: every eighth still of the run comes under a new id, every third has gone."""
    s = stills(spark, sf)
    top = F.broadcast(s.agg((F.max("id") + 1).alias("top")))  # one row
    k = F.col("id")
    run = s.where("id % 3 <> 2 AND work <> 'src3'").join(top).select(F.when(k % 8 == 2, k + F.col("top")).otherwise(k).alias("id"), F.when(k % 2 == 0, F.col("work")).otherwise("src0").alias("work"), (F.col("ts") + 1).alias("ts"), "facets", F.lit(True).alias("selected"))
    return ing.merge(s.select("id", *ing.PIPELINE, *ing.REVIEW), run).select("id", "work", "ts", "selected", "review_state", "locked")


@query("""WITH m AS (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 1 THEN 'x' ELSE sha256(text) END AS sha, CASE WHEN doc_id % 60 = 2 THEN 0 ELSE octet_length(encode(text)) END AS bytes FROM documents WHERE doc_id % 40 <> 3)
SELECT d.doc_id AS id, CASE WHEN m.id IS NULL THEN 'not listed' WHEN bytes <> octet_length(encode(text)) THEN 'size' ELSE 'digest' END AS problem FROM documents d LEFT JOIN m ON m.id = d.doc_id
WHERE m.id IS NULL OR bytes <> octet_length(encode(text)) OR sha <> sha256(text)""")
def verify_bundle(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))
    n = F.col("id")
    listed = d.where(n % 40 != 3).select("id", F.when(n % 50 == 1, "x").otherwise(F.sha2("content", 256)).alias("sha256"), F.when(n % 60 == 2, 0).otherwise(F.octet_length("content")).cast("long").alias("bytes"))
    return ing.verify(d, listed)


@query("""SELECT id, CAST(min(rank) AS INTEGER) AS rank FROM (SELECT doc_id AS id, 0 AS rank FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY id""")
def pool_sources(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return ing.first_source(d.where("id % 2 = 0"), d.where("id % 3 = 0"), table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


def protocol(spark, sf):
    """Each user's events as one job's events."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "queue").when(F.col("event_type") == "view", "lease").when(F.col("event_type") == "click", "beat").when(F.col("event_type") == "purchase", "commit").otherwise("fail")
    detail = F.element_at(F.array(*map(F.lit, ("", "input", "source", "", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"), kind.alias("kind"), detail.alias("detail"))


@query()
def job_replay(spark, sf):
    return jobs_stream.replay(protocol(spark, sf))


def boxes(spark, sf):
    """The lines of an order as its frame's boxes."""
    li = table(spark, sf, "lineitem")
    x, y = (F.col("l_suppkey") % 20).cast("double"), (F.col("l_partkey") % 20).cast("double")
    b = F.struct((F.col("l_extendedprice") / 1e5).alias("score"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + F.col("l_quantity")).alias("y1"))
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(b).alias("boxes"))


OVERLAP = "greatest(0e0, least(f.x1, b.x1) - greatest(f.x0, b.x0) + 1) * greatest(0e0, least(f.y1, b.y1) - greatest(f.y0, b.y0) + 1)"
AREA = "({0}.x1 - {0}.x0 + 1) * ({0}.y1 - {0}.y0 + 1)"


@query(f"""WITH RECURSIVE box AS (SELECT l_orderkey AS id, l_extendedprice / 1e5 AS s, CAST(l_suppkey % 20 AS DOUBLE) AS x0, CAST(l_partkey % 20 AS DOUBLE) AS y0, l_suppkey % 20 + l_quantity AS x1, l_partkey % 20 + l_quantity AS y1 FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, x0, y0 DESC, x1 DESC, y1 DESC) AS k FROM box),
w(id, k, kept) AS (SELECT DISTINCT id, CAST(0 AS BIGINT), CAST([] AS STRUCT(s DOUBLE, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) FROM b
 UNION ALL SELECT w.id, b.k, CASE WHEN len(list_filter(w.kept, lambda f: {OVERLAP} / ({AREA.format("f")} + {AREA.format("b")} - {OVERLAP}) > 0.3e0)) > 0 THEN w.kept
  ELSE list_append(w.kept, {{'s': b.s, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}}) END FROM w JOIN b ON b.id = w.id AND b.k = w.k + 1)
SELECT id, CAST(max(len(kept)) AS BIGINT) AS n, max(list_aggregate(list_transform(kept, lambda f: f.s), 'max')) AS best FROM w GROUP BY id""", also=("suppress_boxes_all",))
def suppress_boxes(spark, sf):
    """Every box of each frame after chained suppression; boxes of equal score go by their left edge."""
    kept = dt.suppress(F.sort_array("boxes", asc=False), 0.3)
    return boxes(spark, sf).select("id", F.size(kept).cast("long").alias("n"), kept[0]["score"].alias("best"))


@query("""WITH b AS (SELECT l_orderkey AS id, l_linenumber AS n, l_extendedprice / 1e5 AS s, l_suppkey % 20 AS x0, l_partkey % 20 AS y0, l_suppkey % 20 + l_quantity AS x1, l_partkey % 20 + l_quantity AS y1 FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (x1 - x0) * (y1 - y0) DESC, s DESC) AS k FROM b)
SELECT f.id, max(h.s) AS head FROM f JOIN b h ON h.id = f.id AND (f.x0 + f.x1) / 2 BETWEEN h.x0 AND h.x1 AND (f.y0 + f.y1) / 2 BETWEEN h.y0 AND h.y1 WHERE k = 1 GROUP BY f.id""")
def head_over_face(spark, sf):
    b = F.col("boxes")
    return boxes(spark, sf).select("id", dt.over_centre(b, dt.largest(b))["score"].alias("head"))


def reviewed(spark, sf):
    return stills(spark, sf).withColumn("reviewed_at", F.lit(None).cast("timestamp"))


@query(with_views("still") + "SELECT id, CASE WHEN work IN ('src1', 'src2') AND selected AND review_state = 'unreviewed' AND NOT excluded THEN 'kept' ELSE review_state END AS review_state FROM still")
def keep_rest(spark, sf):
    s = reviewed(spark, sf)
    return rv.keep_rest(s, s.where("work IN ('src1', 'src2')").select("work"), F.lit("2024-01-01").cast("timestamp")).select("id", "review_state")


@query(with_views("still") + "SELECT id, CASE WHEN id % 7 = 3 THEN 'kept' ELSE review_state END AS review_state FROM still")
def keep_rest_undone(spark, sf):
    """A batch taken back after some of its stills, and some others, were reviewed again: those stay as they are now."""
    s, at, later = reviewed(spark, sf), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")
    kept = rv.keep_rest(s, s.select("work"), at)
    again = rv.set_review(kept, s.where("id % 7 = 3"), "kept", later)
    return rv.undo(again, "kept", at).select("id", "review_state")


@query(with_views("still", "facet") + ", m AS (SELECT * FROM facet WHERE NOT (k = 'size' AND id % 3 = 0)) SELECT id, k, v FROM m UNION ALL SELECT id, 'size', 'fixed' FROM still WHERE id % 3 = 0")
def corrected_facets(spark, sf):
    from stillwater.operators.catalog import overlay

    s = stills(spark, sf)
    fixes = s.where("id % 3 = 0").select("id", F.create_map(F.lit("size"), F.lit("fixed")).alias("fix"))
    return rv.correct(s, fixes).select("id", F.explode(overlay(F.col("facets"), F.col("facets_human"))).alias("k", "v"))


@query(with_views("still") + "SELECT id, locked OR id % 5 = 0 AND NOT (work = 'src3' AND id % 2 = 0) AS locked FROM still")
def set_locks(spark, sf):
    s = stills(spark, sf).withColumn("tiers", F.when(F.col("id") % 2 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(320))))
    out, _ = rv.set_locks(s, s.where("id % 5 = 0"), s.where("work = 'src3'"))
    return out.select("id", "locked")


@query("""SELECT o_custkey AS work, CASE WHEN o_custkey % 10 = 3 THEN 0 ELSE count(*) END AS jobs, CASE WHEN o_custkey % 10 = 3 THEN 1 ELSE 0 END AS scrubs FROM orders GROUP BY o_custkey""")
def remove_works(spark, sf):
    j = table(spark, sf, "orders").select(F.col("o_custkey").alias("work"), F.lit("import").alias("stage"))
    w = j.select("work").distinct()
    _, _, left = rv.remove(w, w, j, w.where("work % 10 = 3"))
    return left.groupBy("work").agg(F.count_if(F.col("stage") == "import").alias("jobs"), F.count_if(F.col("stage") == "scrub").cast("int").alias("scrubs"))


@query("""WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS episode, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS minutes, o_orderstatus = 'F' AS known, o_orderstatus = 'P' AS live FROM orders),
c AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM f)
SELECT id, problem FROM (SELECT id, unnest([CASE WHEN known THEN 'already a work' END, CASE WHEN live THEN 'already queued' END, CASE WHEN coalesce(minutes, 0) <= 0 THEN 'no duration' END, CASE WHEN episode IS NOT NULL AND n > 1 THEN 'several files of the episode' END]) AS problem FROM c) WHERE problem IS NOT NULL""")
def file_problems(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    return rv.file_problems(o.select(k.alias("id"), F.when(k % 3 != 0, F.col("o_custkey")).alias("episode"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("minutes"), (F.col("o_orderstatus") == "F").alias("known"), (F.col("o_orderstatus") == "P").alias("live")))


@query("""SELECT lower(c_mktsegment) AS name, count(*) AS n FROM customer GROUP BY 1""")
def local_names(spark, sf):
    """Segments as names in several spellings: one id each, the same for all spellings."""
    c = table(spark, sf, "customer")
    spelt = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("name"))
    ids = rv.new_local(spelt, spelt.limit(0).select("name", F.col("c_custkey").alias("id")))
    return spelt.join(few(ids.select(F.lower("name").alias("k"), "id")), F.lower(spelt["name"]) == F.col("k")).groupBy("k", "id").agg(F.count(F.lit(1)).alias("n")).select(F.col("k").alias("name"), "n")


def tagged(spark, sf):
    k = F.col("p_size")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), pick(5, "bt709", None, "bt2020nc", "smpte170m", "bt470bg").alias("space"), pick(4, "bt709", None, "smpte2084", "bt2020-10").alias("transfer"),
        pick(3, "bt709", None, "bt2020").alias("primaries"), (k * 30).alias("height"),
    )


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'bt709' WHEN 2 THEN 'bt2020nc' WHEN 3 THEN 'smpte170m' WHEN 4 THEN 'bt470bg' END AS s, CASE p_size % 4 WHEN 0 THEN 'bt709' WHEN 2 THEN 'smpte2084' WHEN 3 THEN 'bt2020-10' END AS t,
 CASE p_size % 3 WHEN 0 THEN 'bt709' WHEN 2 THEN 'bt2020' END AS p, p_size * 30 AS h FROM part)
SELECT id, CASE WHEN t = 'smpte2084' THEN 'hdr-bt2390' WHEN s = 'bt2020nc' AND t = 'bt2020-10' AND p = 'bt2020' THEN 'sdr-bt2020'
 WHEN coalesce(s, 'bt709') = 'bt709' AND coalesce(t, 'bt709') = 'bt709' AND coalesce(p, 'bt709') = 'bt709' AND (h >= 720 OR (s = 'bt709' AND t = 'bt709' AND p = 'bt709')) THEN 'sdr-bt709'
 WHEN s = 'smpte170m' AND coalesce(t, 'bt709') = 'bt709' AND p IS NULL THEN 'sdr-bt601' WHEN s = 'bt470bg' AND coalesce(t, 'bt709') = 'bt709' AND p IS NULL THEN 'sdr-bt601'
 WHEN s IS NULL AND t IS NULL AND p IS NULL THEN 'sdr-bt601' END AS rule FROM t""")
def color_rule(spark, sf):
    return tagged(spark, sf).select("id", fr.color_rule(*[F.col(c) for c in ("space", "transfer", "primaries", "height")]).alias("rule"))


def shot_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_suppkey")).alias("src"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int").alias("shot"), (F.col("l_orderkey") * 7.0 + F.col("l_linenumber")).alias("mid"), F.col("l_extendedprice").alias("score"), F.lit(420000.0).alias("duration"))


@query("SELECT l_suppkey AS src, CAST(l_orderkey * 8 + l_linenumber AS INTEGER) AS shot, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 7e0 + l_linenumber, l_orderkey * 8 + l_linenumber) - 1 AS INTEGER) AS turn FROM lineitem")
def rank_shots_plain(spark, sf):
    return fr.rank_shots(shot_rows(spark, sf), 40, 0)


@query()
def rank_shots_spread(spark, sf):
    return fr.rank_shots(shot_rows(spark, sf), 40)


@query()
def plan_extractions(spark, sf):
    ranked = fr.rank_shots(shot_rows(spark, sf), 40, 0).withColumn("frames", F.col("shot") % 5 + 1)
    return fr.plan(ranked, 100, 200)


@query("""SELECT c_custkey AS id, problem FROM (SELECT c_custkey, unnest([CASE WHEN c_custkey % 9 = 0 THEN 'missing series_title' END, CASE WHEN c_custkey % 4 = 3 THEN 'unknown entry type' END,
 CASE WHEN c_custkey % 4 = 1 AND c_custkey % 5 = 0 THEN 'an episode without an id' END]) AS problem FROM customer) WHERE problem IS NOT NULL""")
def identity_problems(spark, sf):
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 1, "episode").when(k % 4 == 3, "clip").otherwise("movie")
    rows = table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 9 != 0, F.col("c_name")).alias("series_title"), kind.alias("entry_type"), F.lit("f").alias("source_filename"), k.alias("series_id"), k.alias("file_id"), F.col("c_name").alias("work_id"),
        F.when(k % 5 == 0, F.array().cast("array<long>")).otherwise(F.array(k)).alias("episode_ids"),
    )
    return fr.identity_problems(rows)


@query("""WITH p AS (SELECT sha256(concat_ws(chr(10), 'm', 'p', c_mktsegment)) AS key, c_mktsegment AS phrase FROM customer)
SELECT key, count(*) + CASE WHEN phrase < 'C' THEN 5 ELSE 0 END AS hits FROM p GROUP BY key, phrase""")
def phrase_cache(spark, sf):
    import pandas as pd

    p = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("phrase")).withColumn("key", fr.phrase_key(F.lit("m"), F.lit("p"), F.col("phrase")))
    cache = p.where("phrase < 'C'").select("key", F.array(F.lit(1.0).cast("float")).alias("v"), F.lit(5).cast("long").alias("hits")).distinct()
    return fr.encode_missing(p, cache, lambda pdf: pd.DataFrame({"key": pdf["key"], "v": [[float(len(x))] for x in pdf["phrase"]]})).select("key", "hits")


@query(with_views("still", "seen") + "SELECT id, work, lang, size FROM seen WHERE NOT coalesce(toxic = 1, FALSE)")
def public_stills(spark, sf):
    """What a visitor may see of a still: no review marks."""
    from stillwater.operators import catalog

    s = stills(spark, sf).where(catalog.visible()).withColumn("f", catalog.overlay(F.col("facets"), F.col("facets_human")))
    return s.select("id", "work", F.col("f")["lang"].alias("lang"), F.col("f")["size"].alias("size"))


@query("""SELECT o_custkey AS work, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def batch_duplicates(spark, sf):
    """A work that comes twice in one day's batch."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("work"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
