"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.llm import (
    conversation_repair, decontamination, divergence_rules, exact_dedup, jaccard_join, license_scan, lm_interpolation, mixing, packing, periodic_runs, quality_crf, toxicity, url_filter,
)
from stillwater.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_from = F.concat_ws(":", F.input_file_name(), F.input_file_block_start().cast("string"))
    return lm_interpolation.lm_scores(table(spark, sf_dir, "documents"), portion=read_from)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.divergence_rules(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op10_url_filter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method's own list with each label also given as a host: the same verdicts."""
    bare = spark.createDataFrame([(b,) for b in url_filter.BLOCKED_LABELS], "host string")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), blocked_hosts=bare)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults by crc32 of `conv_id:turn`: a row goes, loses its text or its marks, comes twice, or is said by the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("k"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.digests(damaged(rows), rows.select("conv_id"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """The texts of every tenth id by crc32 made periodic from a word on; the others as they are. One array of words a text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    words = F.array(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    made = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")), ["doc_id"])
    more = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.expr("CAST(NULL AS struct<start:long,length:long,period:long>)"), more)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    ).select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_quality_crf, op3_lm_interpolation, op4_mix_sources, op5_toxicity,
        op6_exact_dedup, op7_best_fit_packing, op8_ngram_jaccard, op9_quality_rules, op10_url_filter, op10_url_filter_labels,
        op11_decontaminate, op12_conversation_repair, op13_periodic_runs,
    )
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"[^\x20\x09-\x0D]+"


def _license_sql() -> str:
    ls = license_scan
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    notice = " OR ".join(f"regexp_matches(p, {quoted(n)})" for n in ls.NOTICE)
    table = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in ls.SPELLINGS) + "}"
    known = dict(sorted((line.split("\t")[::-1] for line in (ls.FOLDER / "digests.tsv").read_text().splitlines()), reverse=True))
    rows = ", ".join(f"('{d}', '{k}')" for d, k in known.items())
    two = "w"
    for first in ("non", "sub"):
        for second in ("commercial", "license", "licenses", "licensed"):
            two = f"replace({two}, ' {first}  {second} ', ' {first}{second} ')"
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents),
own AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(t, {quoted(ls.BETWEEN)}), lambda p: NOT ({notice})), ' ') AS t FROM low),
words AS (SELECT doc_id, list_filter(string_split_regex(t, '{ls.OTHER}'), lambda w: w <> '') AS ws FROM own),
usual AS (SELECT doc_id, ' ' || array_to_string(list_transform(ws, lambda w: coalesce({table}[w], w)), '  ') || ' ' AS w FROM words),
c AS (SELECT doc_id, trim(regexp_replace({two}, ' +', ' ', 'g')) AS c FROM usual),
d AS (SELECT doc_id, CAST(length(c) AS INTEGER) AS n_chars, sha256(c) AS digest FROM c)
SELECT doc_id, n_chars, d.digest, licence FROM d LEFT JOIN (VALUES {rows}) AS k(digest, licence) ON d.digest = k.digest"""


_MIX_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS sk, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size,
         md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS rank
  FROM documents),
each AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY sk),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY CASE WHEN sk = '' THEN 1 ELSE 0 END, sk) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM each),
caps AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(cap) OVER r, 0) AS BIGINT) AS spent, CAST(sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS BIGINT) AS rest
  FROM ranked WINDOW r AS (ORDER BY CAST(cap AS DOUBLE) / w, CASE WHEN sk = '' THEN 1 ELSE 0 END, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, CAST(total - spent AS DOUBLE) / CAST(rest AS DOUBLE) AS level FROM caps),
targets AS (SELECT sk, source_size, coalesce(least(CAST(cap AS DOUBLE), max(level) OVER () * CAST(w AS DOUBLE)), 0e0) AS target FROM levels),
all_seats AS (SELECT CAST(round(sum(target) / 64) AS BIGINT) AS n FROM targets),
quotients AS (SELECT sk, row_number() OVER (ORDER BY target / (2e0 * k + 1e0) DESC, sk) AS place FROM targets, all_seats, range(n) AS r(k) WHERE target > 0),
seats AS (
  SELECT t.sk, t.source_size, t.target, count(q.place) AS seats
  FROM targets t LEFT JOIN (SELECT sk, place FROM quotients, all_seats WHERE place <= n) q ON q.sk = t.sk GROUP BY ALL),
docs AS (
  SELECT d.*, t.source_size, t.target, t.seats,
         CAST('0x' || substr(rank, 1, 15) AS BIGINT) % greatest(1, CAST(ceil(t.source_size / 2000000e0) AS BIGINT)) AS shard
  FROM sizes d JOIN seats t USING (sk)),
shards AS (SELECT sk, shard, CAST(sum(size) AS BIGINT) AS words, min(seats) AS seats, CAST(ceil(sum(size) / 64e0) AS BIGINT) AS blocks FROM docs GROUP BY sk, shard),
shard_quotients AS (SELECT sk, shard, seats, row_number() OVER (PARTITION BY sk ORDER BY words / (2e0 * k + 1e0) DESC, shard) AS place FROM shards, unnest(range(seats)) AS r(k) WHERE words > 0),
quota AS (
  SELECT s.sk, s.shard, s.blocks, s.words, count(q.place) * 64 AS due
  FROM shards s LEFT JOIN (SELECT * FROM shard_quotients WHERE place <= seats) q ON q.sk = s.sk AND q.shard = s.shard GROUP BY ALL),
draws AS (
  SELECT sk, shard, blocks, CASE WHEN words > 0 THEN least(due // words, 3) ELSE 0 END AS rounds,
         CASE WHEN words > 0 AND due // words < 3 THEN (2 * (due - due // words * words) + 64) // 128 ELSE 0 END AS extra FROM quota),
lots AS (SELECT sk, shard, extra, b, row_number() OVER (PARTITION BY sk, shard ORDER BY substr(md5('12:' || sk || ':' || shard || ':' || b), 1, 15), b) AS place FROM draws, unnest(range(blocks)) AS r(b)),
drawn AS (SELECT sk, shard, b FROM lots WHERE place <= extra),
placed AS (
  SELECT row_number() OVER () AS row, d.*, CAST(coalesce(sum(size) OVER (PARTITION BY sk, shard ORDER BY rank, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo FROM docs d),
part AS (
  SELECT row, sum(least(lo + size, b * 64 + 64) - greatest(lo, b * 64)) AS words
  FROM placed JOIN drawn USING (sk, shard) WHERE b * 64 < lo + size AND b * 64 + 64 > lo GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(rounds * size + coalesce(words, 0) AS BIGINT) AS taken
FROM placed JOIN draws USING (sk, shard) LEFT JOIN part USING (row)"""

_DEDUP_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)"""

_BLOCKED = ", ".join(f"'{b}'" for b in url_filter.BLOCKED_LABELS)
_RULES = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{a}')" for r, a in url_filter.RULES)
_URL_SQL = rf"""
WITH w AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
p AS (SELECT page_id, translate(regexp_extract(u, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM w),
rules(rule, rhost, rpath, action) AS (VALUES {_RULES}),
hits AS (SELECT page_id, host, path, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k
         FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN list_has_any(string_split(host, '.'), [{_BLOCKED}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM hits WHERE k = 1"""

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LEAK_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_ITEM_WORD}') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_ITEM_WORD}') AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[i + 1:i + least(len(ws), 10)], ' ') AS g
  FROM b, unnest(range(len(ws) - least(len(ws), 10) + 1)) AS r(i) WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT k FROM w),
grams AS (SELECT row, i, k, array_to_string(ws[i + 1:i + k], ' ') AS g FROM d, lengths, unnest(range(len(ws) - k + 1)) AS r(i)),
hits AS (SELECT row, i, grams.k, item FROM grams JOIN w ON grams.k = w.k AND grams.g = w.g),
n AS (SELECT row, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT row, i, k FROM hits), unnest(range(k)) AS r(j) GROUP BY row),
items AS (SELECT row, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN items USING (row)"""

# The polynomial of crc32 is a fixed value.
_CRC = """
crc_table AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i))"""
_CRC_OF = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _repair_sql() -> str:
    # The state machine as text: each place holds its least "cost letters", costs in eight digits.
    plus = lambda place, n, x: f"lpad(CAST(CAST(left({place}, 8) AS BIGINT) + {n} AS VARCHAR), 8, '0') || substr({place}, 9) || '{x}'"
    keep = lambda place, to: f"CASE WHEN NOT must AND i = '{to}' THEN {plus(place, 'cut', 'K')} END"
    change = lambda place: f"CASE WHEN NOT must THEN {plus(place, '2 + cut', 'R')} END"
    filled = lambda src: f"""
    SELECT row, n, p0, ps, least(pu, {plus("p0", 2, "I")}, {plus("ps", 2, "I")}, {plus("pa", 2, "I")}) AS pu, least(pa, {plus("pu", 2, "I")}, {plus("least(p0, ps)", 4, "II")}) AS pa FROM ({src})"""  # noqa: E731
    step = f"""
    SELECT w.row, n + 1 AS n, {plus("p0", 3, "D")} AS p0, least({plus("ps", 3, "D")}, {keep("p0", "s")}) AS ps,
           least({plus("pu", 3, "D")}, {keep("p0", "u")}, {keep("ps", "u")}, {keep("pa", "u")}, {change("p0")}, {change("ps")}, {change("pa")}) AS pu,
           least({plus("pa", 3, "D")}, {keep("pu", "a")}, {change("pu")}) AS pa
    FROM ways w JOIN f ON f.row = w.row AND f.pos = w.n + 1"""
    return rf"""
WITH RECURSIVE {_CRC},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC_OF.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc_table),
rows AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS r(j) WHERE k <> 0),
ids AS (SELECT row_number() OVER () AS row, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT row, turn, role, text, row_number() OVER (PARTITION BY row ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM rows JOIN ids ON ids.conv_id IS NOT DISTINCT FROM rows.conv_id),
m AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY row, role, text ORDER BY pos) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS open, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY row ORDER BY pos) AS before FROM o),
f AS (SELECT *, blank OR again AS must, CAST(open AND NOT blank AND NOT again AS INTEGER) AS cut FROM m),
ways AS (
  {filled("SELECT row, CAST(0 AS BIGINT) AS n, '00000000' AS p0, '99000000' AS ps, '99000000' AS pu, '99000000' AS pa FROM ids")}
  UNION ALL {filled(step)}),
best AS (SELECT row, substr(least(p0, pa), 9) AS audit, CAST(left(least(p0, pa), 8) AS BIGINT) AS cost FROM ways QUALIFY row_number() OVER (PARTITION BY row ORDER BY n DESC) = 1),
letters AS (SELECT row, j, audit[j] AS x, len(replace(left(audit, j), 'I', '')) AS pos, len(replace(left(audit, j), 'D', '')) AS out FROM best, unnest(range(1, len(audit) + 1)) AS r(j)),
said AS (
  SELECT l.row, l.j, x, CASE WHEN x = 'I' THEN '' ELSE text END AS text, role, out,
         max(CASE WHEN out = 1 AND x = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.row) AS s
  FROM letters l LEFT JOIN f ON x <> 'I' AND f.row = l.row AND f.pos = l.pos WHERE x <> 'D'),
fixed AS (SELECT row, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (out - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS repaired_sha256 FROM said GROUP BY row),
sums AS (
  SELECT row, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, CAST(sum(cut) AS BIGINT) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY row)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost, audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM ids JOIN best USING (row) LEFT JOIN sums USING (row) LEFT JOIN fixed USING (row)"""


_RUNS_SQL = rf"""
WITH {_CRC},
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws, CASE WHEN doc_id IS NOT NULL THEN {_CRC_OF.format("CAST(doc_id AS VARCHAR)")} END AS h FROM documents, crc_table),
a AS (SELECT row, doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS made, CASE WHEN len(ws) > 0 THEN h // 10 % len(ws) END AS a, h // 10 AS g FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (
  SELECT row, n, i, CASE WHEN made AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS word
  FROM p, unnest(range(n)) AS r(i)),
same AS (SELECT x.row, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM same),
long AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY row, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT row, start, length, min(q) AS period FROM long GROUP BY row, start, length),
best AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM runs),
lines AS (SELECT row, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY row),
gone AS (SELECT DISTINCT row, i FROM runs, unnest(range(start + period, start + length)) AS r(i)),
kept AS (SELECT row, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM w ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (row) LEFT JOIN lines USING (row) LEFT JOIN kept USING (row)"""

ORACLES = {"op1_license_scan": _license_sql(), "op4_mix_sources": _MIX_SQL, "op6_exact_dedup": _DEDUP_SQL, "op10_url_filter": _URL_SQL, "op10_url_filter_labels": _URL_SQL, "op11_decontaminate": _LEAK_SQL, "op12_conversation_repair": _repair_sql(), "op13_periodic_runs": _RUNS_SQL}
