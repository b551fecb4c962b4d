"""The training-data operators against brute force, their SQL, and odd inputs."""

import math
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import base_score, best_fit, components, fold, js, lm_counts, lower, rule_counts, sainte_lague, words
from oracle import compare, rows_of_sql
from pyspark.sql import functions as F

from stillwater.llm import divergence_rules, exact_dedup, jaccard_join, license_scan, lm_interpolation, mixing, packing, quality_crf, queries, toxicity, url_filter
from stillwater.llm import textblocks as tb
from stillwater.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    compare(queries.QUERIES[name](spark, small), queries.ORACLES[name], small)


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]


def test_words_and_hashes():
    texts = ["", "  a\tB\u00a0c\vd ", "é" * 200 + " É", "x", "日本 語\n", "a" * 9000 + "b", "A" * 9000 + "b"]
    data, offs = tb.buffers(pa.array(texts))
    s, e, d = tb.tokens(data, offs)
    assert [(int(k), bytes(data[a:b]).decode()) for a, b, k in zip(s, e, d, strict=True)] == [(k, w) for k, t in enumerate(texts) for w in words(t)]
    h = tb.span_hashes(data, s, e, tb.FOLD)
    assert len(set(h.tolist())) == len({lower(w) for t in texts for w in words(t)})
    assert h[-1] == h[-2]


# 1 ------------------------------------------------------------------


def test_licences(spark):
    mit = (license_scan.FOLDER / "MIT.txt").read_text()
    docs = spark.createDataFrame(
        [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(".", "")), (3, mit + " more"), (4, None), (5, ""), (6, "..."), (7, "THIS WORK IS LICENCED under the GNU general public LICENCE -- version 3")], "doc_id long, text string"
    )
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert [got[i].licence for i in range(1, 8)] == ["MIT", "MIT", None, None, None, None, "GPL-3-notice"]
    assert got[4].digest == got[5].digest == got[6].digest
    own = spark.createDataFrame([("Mine", "some text")], "licence string, text string")
    assert license_scan.license_scan(spark.createDataFrame([(1, "Some: TEXT!")], "doc_id long, text string"), license_scan.licence_digests(own), small=0).first().licence == "Mine"


def rewrapped(text, width):
    """Each paragraph filled anew; another holder and another year."""
    text = re.sub(r"(?m)^( *copyright) .*\b(?:[0-9]{4}|donald|kim)\b.*$", r"\1 (c) 1999-2031, Another Holder Ltd.", text, flags=re.I)
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in re.split(r"\n[ \t]*\n", text))


def test_licences_in_any_wrapping(spark):
    whole = [p for p in sorted(license_scan.FOLDER.glob("*.txt")) if "notice" not in p.stem]
    assert len(whole) == 10
    rows = [(f"{p.stem}|{w}", rewrapped(p.read_text(), w)) for p in whole for w in (60, 72, 100)] + [(f"{p.stem}|0", p.read_text().upper().replace("\n", "\r\n")) for p in whole]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r.doc_id for r in got if r.licence != r.doc_id.split("|")[0]] == []


def test_canonical_forms(spark):
    texts = [
        "Copyright 2020 A B\nAll rights reserved.\n\nThe end", "the end", "(c) <year> x\n\nthe END.", "All rights reserved.\n\n* the\n* end", "# Copyright The Authors\n#\n# the end",
        "Copyright holders may not be held to more than what this long sentence says.", "a non-\ncommercial non commercial sub\nlicence non-commercial", "Licence licence licences, fulfil fulfil", "“Straße” – é É",
        "(c) under no\nclaim", "keep the\ncopyright notice in 2020",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", license_scan.canonical(F.col("text")).alias("c")).collect()
    c = [r.c for r in sorted(rows)]
    assert c[:5] == ["the end"] * 5 and c[5] == "copyright holders may not be held to more than what this long sentence says"
    assert c[6:] == ["a noncommercial noncommercial sublicense noncommercial", "license license licenses fulfill fulfill", "straße é É", "c under no claim", "keep the copyright notice in 2020"]


def test_digest_file(spark):
    texts = spark.createDataFrame([(p.stem, p.read_text()) for p in license_scan.FOLDER.glob("*.txt")], "licence string, text string")
    assert {(r.licence, r.digest) for r in license_scan.licence_digests(texts).collect()} == {(r.licence, r.digest) for r in license_scan.known_digests(spark).collect()}


# 2 ------------------------------------------------------------------


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    scores, trans, doc = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 0, 0, 2, 2, 2, 2])
    p, z, pairs = quality_crf.marginals(scores, doc, 3, trans)
    want, total, logs = np.zeros(7), np.zeros((2, 2)), []
    for d in (0, 2):
        at = np.flatnonzero(doc == d)
        w = {}
        for code in range(1 << len(at)):
            y = [code >> k & 1 for k in range(len(at))]
            w[tuple(y)] = np.exp(sum(scores[i] * v for i, v in zip(at, y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        s = sum(w.values())
        logs.append(np.log(s))
        for y, v in w.items():
            want[at] += np.array(y) * v / s
            for a, b in zip(y, y[1:], strict=False):
                total[a, b] += v / s
    assert np.allclose(p, want) and np.allclose(z, logs) and np.allclose(pairs, total)


def plain_lines(text):
    """Own features of each line of a text, in plain Python."""
    lines, kinds = text.split("\n"), quality_crf.KINDS
    of = lambda b: (
        "lower" if 97 <= b < 123 else "upper" if 65 <= b < 91 else "high" if b > 127 else "digit" if 48 <= b < 58 else "space" if b in b" \t\n\r\v\f" else
        "stop" if b in b".,;:'\"()-" else "bang" if b in b"!?" else "symbol" if b in b"#*$%&|<>" else "other"
    )
    out = []
    for line in lines:
        raw, w = line.encode(), words(line)
        low = [lower(x) for x in w]
        share = [sum(of(b) == k for b in raw) / max(len(raw), 1) for k in kinds]
        per = max(len(w), 1)
        out.append([*share, sum(len(x.encode()) for x in w) / per / 20, sum(a == b for a, b in zip(low, low[1:], strict=False)) / per, len(set(low)) / per,
                    math.log1p(len(raw)) / 8, float(not raw), float(bool(raw) and lines.count(line) > 1)])
    return out


def test_line_features_and_scores_by_hand(docs):
    texts = ["", "one\n\ntwo two Two\none", "É ü! 9#\n", *[t or "" for _, t in docs[:40]]]
    x, size, doc = quality_crf.line_features(*tb.buffers(pa.array(texts)))
    want, at = [], []
    for i, t in enumerate(texts):
        own = plain_lines(t)
        none = [0.0] * len(own[0])
        for k, f in enumerate(own):
            want.append([1.0, *f, *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none), float(k == 0), float(k == len(own) - 1)])
            at.append(i)
    assert doc.tolist() == at and np.allclose(x, np.array(want), atol=1e-6)
    good = np.random.default_rng(3).random(len(at))
    scores = quality_crf.document_scores(good, size, doc, len(texts))
    for i, t in enumerate(texts):
        weights = [len(line.encode()) + 1 for line in t.split("\n")]
        assert abs(scores[i] - sum(w * g for w, g in zip(weights, good[np.array(at) == i], strict=True)) / sum(weights)) < 1e-9


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_quality_crf(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97 and len(rows) > 50
    assert all(r.predicted == (r.score >= 0.3) and fold(r.doc_id, 5) == 0 for r in rows)


# 3 ------------------------------------------------------------------


def test_lm_counts_and_base(spark, small, docs):
    n, v, uni, bi, ctx = lm_counts(docs)
    got = {r.doc_id: r for r in lm_interpolation.lm_scores(table(spark, small, "documents"), block_bytes=60_000, owner_bytes=80_000).collect()}
    for i, t in docs:
        k, known, base = base_score(t, n, v, uni)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (k, known, n, fold(i, 10) == 0)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base))
    # The same weights give the same score by plain counts.
    again = {r.doc_id: r.score for r in lm_interpolation.lm_scores(table(spark, small, "documents")).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-6 * abs(again[i]) for i, _ in docs)
    tune = [(i, t) for i, t in docs if fold(i, 10) == 1]
    rest = [(i, t) for i, t in docs if fold(i, 10) > 1]
    nr, _, ur, br, cr = lm_counts(rest)
    hist = []
    for _, t in tune:
        w = [*words(lower(t)), None]
        for h, x in zip(["<s>", *w], w, strict=False):
            c = cr[h]
            q = lambda r: 2.0 ** (round(np.log2(r) * 4) / 4) if r else 0.0
            hist.append((int(lm_interpolation.context_bucket(np.array([c]))[0]), q(br[h, x] / c * (v + 1) if c else 0), q(ur[x] / nr * (v + 1)), 1))
    a = lm_interpolation.learn_weights(hist)
    for i, t in docs[:40]:
        w = [*words(lower(t)), None]
        s = 0.0
        for h, x in zip(["<s>", *w], w, strict=False):
            k = a[lm_interpolation.context_bucket(np.array([ctx[h]]))[0]]
            s += np.log10(k[0] * (bi[h, x] / ctx[h] if ctx[h] else 0) + k[1] * uni[x] / n + k[2] / (v + 1))
        assert abs(s - got[i].score) < 1e-6 * abs(s)


def test_lm_equal_rows_go_to_many_blocks(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit("the same words again").alias("text"), (F.col("id") % 40).alias("k"))
    most = lambda portion: lm_interpolation.dealt(rows, 8, 1, portion).groupBy("block").count().agg(F.max("count")).first()[0]
    assert most(None) >= 1000 > 600 > most(F.col("k"))
    score = lambda portion: sorted((str(r.doc_id), r.n_tokens, r.train_tokens, round(r.score, 9)) for r in lm_interpolation.lm_scores(rows, 4000, 4000, portion).collect())
    assert score(None) == score(F.col("k"))


def test_lm_beats_base_on_held_out(spark):
    r = queries.op3_lm_interpolation(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# 4 ------------------------------------------------------------------


def test_apportion_is_highest_quotients(spark):
    rng = random.Random(4)
    rows = [(p, k, rng.choice([0, 3, 5, 17, 100, 2500])) for p in range(30) for k in range(rng.randint(1, 9))]
    seats = {p: rng.randint(0, 60) for p in range(30)}
    df = spark.createDataFrame([(p, k, n, seats[p]) for p, k, n in rows], "p int, k int, n long, seats long")
    got = {(r.p, r.k): r.q for r in mixing.apportion(df, ["p"], "n", "k", "q").collect()}
    for p in range(30):
        votes = [(k, n) for q, k, n in rows if q == p]
        want = sainte_lague(votes, seats[p]) if sum(n for _, n in votes) else {k: 0 for k, _ in votes}
        assert {k: got[p, k] for k, _ in votes} == want


def test_apportion_with_a_long_tail(spark):
    rng = random.Random(14)
    votes = {0: [4000] + [30] * 200, 1: [rng.choice([1, 2, 7, 90, 10**6]) for _ in range(200)], 2: [30, 90, 10, 30], 3: [1] * 50, 4: [10**12, 3, 3]}
    seats = {0: 100, 1: 333, 2: 5, 3: 7, 4: 40}
    df = spark.createDataFrame([(p, k, n, seats[p]) for p, ns in votes.items() for k, n in enumerate(ns)], "p int, k int, n long, seats long")
    got = {(r.p, r.k): r.q for r in mixing.apportion(df, ["p"], "n", "k", "q").collect()}
    for p, ns in votes.items():
        assert {k: got[p, k] for k in range(len(ns))} == sainte_lague(list(enumerate(ns)), seats[p])
    assert got[0, 0] == 67
    one = {r.k: r.q for r in mixing.apportion(df.where("p = 0").drop("p"), [], "n", "k", "q").collect()}
    assert one == {k: got[0, k] for k in one} and len(one) == 201


def test_mix_meets_targets(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    mixed = mixing.mix_sources(docs, shard_words=5000).cache()
    by = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.max("shard").alias("shard"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.t - r.want) <= 96 * (r.shard + 2) and r.over <= 0 for r in by)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7), shard_words=5000).collect()))
    again = mixing.repeat_documents(docs, mixed).cache()
    assert again.columns == docs.columns and again.where("n_chars <> length(text)").isEmpty()
    n = again.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()
    assert {r.source: r.n for r in n} == {r.source: r.t for r in by if r.t}


# 5 ------------------------------------------------------------------


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op5_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    bad, good = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert np.mean(bad) > 0.8 and np.mean(good) < 0.03


def test_identity_terms_are_neutral(spark):
    """Labels are tied to a group's name; the penalty takes its weight away, the insult keeps its."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        toxic = i % 2
        w = [f"w{rng.randint(0, 300)}" for _ in range(12)]
        w.insert(3, rng.choice(["moron", "scum"]) if toxic and rng.random() < 0.9 else "tree")
        w.insert(5, "muslims" if toxic == (rng.random() < 0.9) else "christians")
        rows.append((i, " ".join(w), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    test = spark.createDataFrame([(1, "the muslims ate a tree"), (2, "the christians ate a tree"), (3, "the moron ate a tree")], "doc_id long, text string")
    model = lambda swap: toxicity.train(df, df.select("doc_id", "toxic"), 600, swap, 1e-4, 20.0)
    data, offs = tb.buffers(pa.array([r.text for r in test.orderBy("doc_id").collect()]))
    z = lambda m: np.log(1 / (1 / toxicity.score_block(m, data, offs) - 1))
    plain, fair = z(model(0.0)), z(model(20.0))
    assert abs(fair[0] - fair[1]) < 0.3 * abs(plain[0] - plain[1]) and fair[2] > fair[0] + 0.5


def test_loss_and_gradient():
    """The loss in plain Python, its gradient by differences."""
    rng = np.random.default_rng(6)
    n, m = 12, 5
    ones = [(i, j) for i in range(n) for j in range(m) if rng.random() < 0.4]
    x = toxicity.Rows(np.array([i for i, _ in ones]), np.array([j for _, j in ones]), n)
    y, weight, pairs = rng.integers(0, 2, n).astype(float), rng.random(n), np.array([[0, 1], [2, 5], [0, 7]])

    def loss(theta):
        z = [theta[m] + sum(theta[j] for i, j in ones if i == k) for k in range(n)]
        log = sum(weight[k] / sum(weight) * (math.log1p(math.exp(z[k])) - y[k] * z[k]) for k in range(n))
        return log + 0.7 * sum((z[a] - z[b]) ** 2 for a, b in pairs) / 3 + 0.05 / 2 * sum(w * w for w in theta[:m])

    theta = rng.normal(size=m + 1)
    got, grad = toxicity.loss_and_gradient(theta, x, y, weight, pairs, 0.7, 0.05)
    assert abs(got - loss(theta)) < 1e-12
    for k in range(m + 1):
        step = np.eye(m + 1)[k] * 1e-6
        assert abs((loss(theta + step) - loss(theta - step)) / 2e-6 - grad[k]) < 1e-6
    best = toxicity.fit(x, m, y, weight, pairs, 0.7, 0.05, steps=4000)
    assert np.abs(toxicity.loss_and_gradient(best, x, y, weight, pairs, 0.7, 0.05)[1]).max() < 1e-4


@pytest.fixture(scope="module")
def toxic_models(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return [toxicity.train(docs, labels, 8000, swap, 1e-4, 20.0) for swap in (0.0, 1.0)]


def test_penalty_acts_on_the_given_texts(toxic_models):
    """In the query's own model neutral sentences that name a group score alike; without the penalty they do not."""
    neutral = ["the {} walked to the market in the morning", "yesterday {} read a long letter"]
    gaps = []
    for model in toxic_models:
        gap = 0.0
        for row in toxicity.IDENTITY:
            for sentence in neutral:
                data, offs = tb.buffers(pa.array([sentence.format(t) for t in row]))
                p = toxicity.score_block(model, data, offs)
                z = np.log(p / (1 - p))
                gap = max(gap, z.max() - z.min())
        gaps.append(gap)
    assert gaps[0] > 0.05 and gaps[1] < 0.5 * gaps[0]


def test_scores_by_hand(toxic_models, docs):
    model = toxic_models[1]
    weight = dict(zip(model["known"].tolist(), model["w"].tolist(), strict=True))

    def feature(word, salt):
        data, offs = tb.buffers(pa.array([word]))
        return int((tb.span_hashes(data, offs[:1], offs[1:], tb.FOLD) + toxicity.SALTS[salt])[0])

    texts = [t or "" for _, t in docs[:60]] + ["", "...", "Moron! he is. You moron scum", "x" * 5000, 'word ' * 700]
    data, offs = tb.buffers(pa.array(texts))
    got = toxicity.score_block(model, data, offs)
    for text, p in zip(texts, got, strict=True):
        best = model["b"]
        for sentence in re.split(rb"[\n.!?]", text.encode()):
            found = set()
            for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence):
                cuts = [(word, 0)] + [(word[:n], k + 1) for k, n in enumerate(toxicity.PREFIXES) if len(word) > n]
                for piece, salt in cuts:
                    h = tb.span_hashes(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]), tb.FOLD) + toxicity.SALTS[salt]
                    found.add(int(h[0]))
            if re.search(rb"[0-9A-Za-z\x80-\xff]", sentence):
                best = max(best, model["b"] + sum(weight.get(f, 0.0) for f in found))
        assert abs(p - 1 / (1 + math.exp(-best))) < 1e-9
    assert feature("he", 0) in weight


def test_swaps():
    assert toxicity.swapped("Women and men.") == ["men and girls.", "girls and boys.", "boys and women."] and toxicity.swapped("nobody") == []


# 6 ------------------------------------------------------------------


def test_directory(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(9000 + i, "Same") for i in range(900)], "doc_id long, text string")
    _, entries, _ = exact_dedup.index(docs, capacity=100)
    held = entries.groupBy("bucket", "depth").count().collect()
    assert all(r["count"] <= 100 for r in held) and len(held) > 30
    bits = exact_dedup.KEY_BITS
    spans = sorted((r.bucket, r.bucket + (1 << (bits - r.depth))) for r in held)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    # An entry lies in the bucket of its key, and a bucket in one file; two halves of an overfull bucket fit no more when joined.
    keyed = entries.withColumn("key", exact_dedup.key_of())
    assert keyed.where("key < bucket OR key >= bucket + shiftleft(1L, 60 - depth)").count() == 0
    assert len({b for b, _ in spans}) == entries.select("bucket", F.input_file_name()).distinct().count()
    size = {(r.bucket, r.depth): r["count"] for r in held}
    for (b, d), n in size.items():
        other = b ^ (1 << (bits - d)) if d else None
        assert (other, d) not in size or n + size[other, d] > 100


def test_directory_deepens_as_needed(spark, monkeypatch):
    """Keys that differ in their last bits alone: the directory doubles until they part."""
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda norm: {"digest": F.unhex(F.lpad(F.hex(F.xxhash64(norm).bitwiseAND(0xFF)), 15, "0")), "check": F.xxhash64(norm), "nbytes": F.octet_length(norm)})
    docs = spark.createDataFrame([(i, f"text {i % 200}") for i in range(400)], "doc_id long, text string")
    _, entries, _ = exact_dedup.index(docs, capacity=4)
    assert entries.agg(F.max("depth")).first()[0] > 52
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs, capacity=4).collect()} == {(i, i % 200 + 200) for i in range(400)}


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_equal_digests_are_told_apart_by_bytes(spark, monkeypatch, few):
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda norm: {"digest": F.unhex(F.rpad(F.hex(F.octet_length(norm)), 16, "0")), "check": F.lit(1).cast("long"), "nbytes": F.octet_length(norm)})
    rows = [(1, "aa"), (2, "AB"), (3, "ab"), (4, "aA"), (5, "ba"), (6, "abc"), (7, None), (8, "")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), most_broadcast=few).collect()}
    assert got == {1: (4, 2), 2: (3, 2), 3: (3, 2), 4: (4, 2), 5: (5, 1), 6: (6, 1), 7: (8, 2), 8: (8, 2)}


def chained(docs, capacity):
    _, entries, where = exact_dedup.index(docs, capacity)
    return exact_dedup.chains(docs, entries, where, 10**6)


def test_owners_decide(spark, monkeypatch):
    """The directory says which tasks decide, and a task that compares no bytes decides wrongly."""
    docs = spark.createDataFrame([(i, f"text {i % 150}") for i in range(600)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    fine, coarse = (chained(docs, c).withColumn("file", F.input_file_name()) for c in (5, 1000))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert coarse.select("file").distinct().count() == 1 == coarse.select("bucket").distinct().count()
    assert fine.select("file").distinct().count() > 1
    assert fine.groupBy("bucket").agg(F.count_distinct("file").alias("n")).where("n > 1").isEmpty()
    assert fine.count() == coarse.count() == 150
    sums = [(r.link, r.group_size) for r in coarse.collect()]
    assert all(n == 4 for _, n in sums)
    # Two texts with one fingerprint: told apart by the owner's comparison alone.
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda norm: {"digest": F.unhex(F.rpad(F.hex(F.octet_length(norm)), 16, "0")), "check": F.lit(1).cast("long"), "nbytes": F.octet_length(norm)})
    rows = spark.createDataFrame([(1, "ab"), (2, "AB"), (3, "cd"), (4, "cd"), (5, "cd")], "doc_id long, text string")
    right = {(1, 2, 2), (2, 2, 2), (3, 5, 3), (4, 5, 3), (5, 5, 3)}
    found = lambda: {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(rows).collect()}
    assert found() == right
    monkeypatch.setattr(exact_dedup, "BYTES", [])
    assert found() == {(i, 5, 5) for i in range(1, 6)}


def test_no_row_without_its_bucket(spark, monkeypatch):
    real = exact_dedup.directory
    docs = spark.createDataFrame([(i, f"text {i % 90}") for i in range(180)], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "directory", lambda e, c: ((d := real(e, c))[0].where("bucket > 0"), d[1]))
    assert 0 < exact_dedup.exact_dedup(docs, capacity=20).count() < 180


def test_hot_group(spark):
    docs = spark.createDataFrame([(i, "Hot Text" if i % 3 else f"t{i}") for i in range(3000)], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == 3000 and sum(r.kept for r in rows) == 1001
    assert {(r.keep_id, r.group_size) for r in rows if r.group_size > 1} == {(2999, 2000)}


def test_repeated_rows_leave_one(spark):
    rows = [(1, "A b", 1), (1, "a b", 2), (1, "a b", 2), (1, "other", 3), (None, "a b", 4), (None, "x", 5), (None, "x", 5), (2, None, 6), (2, None, 6), (3, "x y z x y z", 7), (3, "x y z x y z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long")
    for one in (exact_dedup.keep_first_copies(docs), jaccard_join.keep_one_each(docs.where("text IS NOT NULL"))):
        assert one.columns == docs.columns
        kept = [(r.doc_id, lower(r.text)) for r in one.collect()]
        assert len(kept) == len(set(kept)) and sorted(t for _, t in kept if t) == ["a b", "other", "x", "x y z x y z"]


# 7 ------------------------------------------------------------------


def test_best_fit_is_the_tightest():
    rng = random.Random(7)
    for _ in range(60):
        pieces = [(rng.choice([0, 3, 10, 25, 40, 60, 100]), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, None, "x", "y"])) for _ in range(80)]
        assert packing.best_fit(pieces, 100) == best_fit(pieces, 100)


def test_packing_whole(spark, small):
    docs = table(spark, small, "documents")
    rows = packing.pack(docs, capacity=700, shard_docs=60).collect()
    size = {i: len(words(t)) for i, t in docs.select("doc_id", "text").collect()}
    total, bins, seen = {}, {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.size
        assert r.source not in seen.setdefault(r.bin_id, set())
        seen[r.bin_id].add(r.source)
    assert total == size and max(bins.values()) <= 700 and all(bins[r.bin_id] == r.bin_used for r in rows)


def test_packing_of_equal_rows(spark):
    """Many equal rows without an id: all are placed, in several shards, no two of them in one bin."""
    docs = spark.createDataFrame([(None, "one two three", "a")] * 700 + [(i, "x " * (i % 40), f"s{i % 30}") for i in range(300)], "doc_id long, text string, source string")
    rows = packing.pack(docs, capacity=50, shard_docs=250).collect()
    none = [r for r in rows if r.doc_id is None]
    assert len(rows) == 1000 and len(none) == 700 == len({r.bin_id for r in none})
    assert len({r.bin_id // 10_000_000 for r in none}) > 1


def test_packing_fills_bins(spark, small):
    """Without conflicts the bins are as full as best fit makes them: all but one in each shard are more than half full."""
    docs = table(spark, small, "documents").withColumn("source", F.lit(None).cast("string"))
    rows = packing.pack(docs, capacity=700, shard_docs=60, cluster=F.lit(None)).collect()
    used = {r.bin_id: r.bin_used for r in rows}
    low = [b // 10_000_000 for b, n in used.items() if 2 * n <= 700]
    assert len(low) == len(set(low))


# 8 ------------------------------------------------------------------


def near_copies(n, seed=8):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(160)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
        out.append((i, " ".join(w)))
    shared = "a passage that many documents share word for word and that is rather long".split()
    out += [(n + i, " ".join(shared + [f"r{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30))])) for i in range(n)]
    return out + [(2 * n + i, " ".join(f"z{rng.randint(0, 9)}" for _ in range(rng.randint(0, 12)))) for i in range(n)]


def test_components_of_documents(spark, small, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(table(spark, small, "documents")).collect()}
    assert got == components(docs)


def test_components_of_near_copies(spark):
    rows = near_copies(120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), owner_keys=900, block=16).collect()}
    assert got == components(rows)


def test_split_keys_and_several_rounds(spark, monkeypatch):
    """Keys of more sets than one owner counts, small blocks and two of them a round: the same components."""
    monkeypatch.setattr(jaccard_join, "FAN", 2)
    rng = random.Random(88)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = common[: 40 + i % 20] if i % 3 == 0 else [f"v{rng.randrange(400)}" for _ in range(40)]
        w = list(w)
        if i % 2:
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i][1] + f" y{i}") for i in range(0, 60, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(frame, owner_keys=500, block=8, list_sets=15).collect()}
    assert got == components(rows)


def test_suffix_filter_never_rejects_a_link():
    rng = np.random.default_rng(9)
    for _ in range(400):
        pool = np.sort(rng.choice(10**6, rng.integers(1, 90), replace=False).astype(np.uint64))
        x, y = (pool[rng.random(len(pool)) < rng.choice([0.8, 0.9, 0.97])] for _ in range(2))
        if len(x) and len(y):
            n = len(np.intersect1d(x, y))
            assert jaccard_join.suffix_bound(x, y) <= len(x) + len(y) - 2 * n
            assert jaccard_join.alike(x, y, 3, 4) == (100 * n >= 75 * (len(x) + len(y) - n))


# 9 ------------------------------------------------------------------


def test_rule_counts(spark, small, docs):
    got = {r.doc_id: r for r in divergence_rules.divergence_rules(table(spark, small, "documents")).collect()}
    for i, t in docs:
        want = rule_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


@pytest.mark.parametrize("least", [1000, 10**9])
def test_kept_by_hand(spark, small, least):
    """References, distances and verdicts in plain Python; only the cell of a word is taken from the operator."""
    rows = table(spark, small, "documents").select("doc_id", "text", "lang").collect()
    rules = divergence_rules
    got = {r.doc_id: r for r in rules.divergence_rules(table(spark, small, "documents"), least_reference=least).collect()}
    cells = {}

    def cell(w):
        if w not in cells:
            data, offs = tb.buffers(pa.array([w]))
            cells[w] = int(tb.span_hashes(data, offs[:1], offs[1:])[0] >> tb.U(48))
        return cells[w]

    groups = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", None, "0123456789", " \t\r\v\f", "\n", ".,;:'\"()-", "!?", "#*$%&|<>"]
    kind = lambda c: 3 if ord(c) > 127 else next((k for k, g in enumerate(groups) if g and c in g), 10)
    shares = lambda counts: {k: n / sum(counts.values()) for k, n in counts.items()}
    seen = {r.doc_id: (Counter(map(kind, r.text or "")), Counter(cell(w) for w in words(lower(r.text)))) for r in rows}
    refs = []
    for lang in sorted({r.lang for r in rows}):
        c, w = (sum((seen[r.doc_id][i] for r in rows if r.lang == lang), Counter()) for i in (0, 1))
        if sum(w.values()) >= least:
            top = sorted(w, key=lambda x: (-w[x], x))[:64]
            slots = lambda n, top=set(top): Counter({x: m for x, m in n.items() if x in top}) + Counter({-1: sum(m for x, m in n.items() if x not in top)})
            refs.append((lang, shares(c), shares(slots(w)), slots))
    assert len(refs) == (4 if least == 1000 else 0)
    for r in rows:
        want = rule_counts(r.text)
        keep = want[0] >= 50 and 100 * want[4] <= 50 * want[0]
        if refs and want[0]:
            c, w = seen[r.doc_id]
            dc, dw, _ = min(((js(shares(c), x), js(shares(s(w)), y), k) for k, (_, x, y, s) in enumerate(refs)), key=lambda t: t[0] + t[1])
            keep &= not (want[1] >= 200 and dc > 0.3) and not (want[0] >= 60 and dw > 0.45)
            if want[1] >= 200:
                assert abs(got[r.doc_id].class_distance - dc) < 1e-9
        assert got[r.doc_id].kept == keep


def test_divergence(spark):
    b = divergence_rules.block(pa.record_batch([pa.array(["the cat and the dog", "Zz 9#"])], names=["text"]))
    assert np.isclose(divergence_rules.js_distance(np.array([[0.5, 0.5, 0.0]]), np.array([0.25, 0.25, 0.5]))[0], js({0: 0.5, 1: 0.5}, {0: 0.25, 1: 0.25, 2: 0.5}))
    c = divergence_rules.class_counts(b)
    assert c[0][[0, 1, 5]].tolist() == [5, 10, 4] and c[1].sum() == 5
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality]) > 0.99 and np.mean([r.kept for r in rows if not r.quality]) < 0.1


# 10 -----------------------------------------------------------------


def test_urls(spark):
    urls = ["http://A.example.NET/en/x?q#f", "https://example.net/en", "http://example.com/de/", "ftp://x.org/fr/a", "x.org/fr/a", None, "http://net/", "http://net", "http://a.ads-track.example.com/en", "http://bexample.net/", "a://b://c.org/fr/", "http://?x"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/en", "net/", "block")
    assert [got[k][3] for k in range(2, 12)] == ["block", "allow", "allow", "allow", "block", "allow", "block", "block", "allow", "allow"]
    assert got[4][:2] == got[5][:2] == ("", "") and got[7] == ("net", "", None, "allow") and got[10][:2] == ("b:", "//c.org/fr/")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_bad_names_under_any_domain(spark, sf):
    rows = queries.op10_url_filter(spark, f"/root/testdata/{sf}").collect()
    bad = {"ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x"}
    open_ = [r for r in rows if r.rule is None and r.host]
    assert all((r.verdict == "block") == bool(bad & set(r.host.split("."))) for r in open_)
    assert sum(r.verdict == "block" for r in open_) > 0


def test_labels_are_whole(spark):
    urls = ["http://a.casino-win.test/en", "http://casino-win/", "http://my-casino-win.test/", "http://casino-win2.test/", "http://test.dev/casino-win./", "http://example.net/en/casino-win"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages, blocked_labels=("casino-win",)).collect()}
    assert [got[k] for k in range(6)] == ["block", "block", "allow", "allow", "allow", "allow"]


def test_digest_collisions(tmp_path):
    """Equal keys are told apart by their strings."""
    strings = [b"a/", b"b/", b"c/"]
    np.zeros(3, np.uint64).tofile(tmp_path / "r.keys")
    np.cumsum([0, *map(len, strings)]).astype(np.int64).tofile(tmp_path / "r.ends")
    (tmp_path / "r.strings").write_bytes(b"".join(strings))
    np.array([1, 0, 1], np.uint8).tofile(tmp_path / "r.actions")
    index = url_filter.DigestIndex(str(tmp_path), "r")
    assert index.find(np.zeros(3, np.uint64), ["c/", "d/", "a/"]).tolist() == [2, -1, 0]
    assert index.find(np.array([7], np.uint64), ["a/"]).tolist() == [-1]


def test_index_of_a_table(spark):
    """Many rules from a table: sorted keys, every rule found, the first action of a rule given twice."""
    n = 5000
    rules = spark.createDataFrame([(f"H{i}.test/p{i % 7}/", "allow" if i % 3 else "block", i) for i in range(n)] + [("h1.test/p1/", "block", n)], "rule string, action string, place long")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.test/p{i % 7}/x") for i in range(0, 2 * n, 5)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages.repartition(6), rules=rules).collect()}
    assert all(got[i] == ((f"h{i}.test/p{i % 7}/", "allow" if i % 3 else "block") if i < n else (None, "allow")) for i in got)
    assert url_filter.url_filter(spark.createDataFrame([(1, "http://h1.test/p1/")], "page_id long, url string"), rules=rules).first().verdict == "allow"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files, held, lengths = url_filter.write_index(url_filter.checked(rules))
    assert len(files) > 1 and files == sorted(files, key=lambda f: f[1]) and held > 17 * n and lengths == [4]
    # Beyond the bound the probes go to the files' ranges, with the same verdicts.
    more = pages.unionByName(spark.createDataFrame([(-1, None), (-2, "http://x.casino-win.test/"), (-3, "http://h3.test/p3/"), (-4, "http://h3.test/p3/"), (None, "http://h1.test/")], pages.schema))
    rows = lambda **k: sorted(map(str, url_filter.url_filter(more, rules=rules, blocked_hosts=("H4.test",), **k).collect()))
    assert rows() == rows(most_mapped=0)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(Exception, match="not a rule"):
        url_filter.url_filter(pages, rules=(("no slash", "allow"),)).collect()


# Odd inputs ----------------------------------------------------------


def runs(docs, labels):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "score", "lang")
    return {
        1: lambda: license_scan.license_scan(docs), 2: lambda: quality_crf.quality_scores(docs, labels), 3: lambda: lm_interpolation.lm_scores(docs), 4: lambda: mixing.mix_sources(docs),
        5: lambda: toxicity.toxicity_scores(docs, labels), 6: lambda: exact_dedup.exact_dedup(docs), 8: lambda: jaccard_join.components(docs),
        7: lambda: packing.pack(docs), 9: lambda: divergence_rules.divergence_rules(docs), 10: lambda: url_filter.url_filter(pages),
    }


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
def test_odd_rows(odd, odd_labels, n):
    rows = runs(odd, odd_labels)[n]()
    if n == 7:  # a row's first piece stands for it; longer texts have more
        rows = rows.where("piece = 0")
    assert rows.count() == odd.count()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
def test_no_rows(odd, odd_labels, n):
    assert runs(odd.limit(0), odd_labels.limit(0))[n]().count() == 0


def test_no_labels(odd, odd_labels):
    none = odd_labels.limit(0)
    assert {r.score for r in quality_crf.quality_scores(odd, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity_scores(odd, none).collect()} == {0.0}


def test_odd_results(odd):
    d = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(odd).collect()}
    by = {i: r for (i, _), r in d.items() if i is not None}
    assert by[3].keep_id == by[4].keep_id == 4 and by[1].keep_id == by[2].keep_id == 2 and by[7].group_size == 2 and by[7].kept
    c = {r.doc_id: r for r in jaccard_join.components(odd).collect() if r.doc_id is not None}
    assert c[4].component_id == 3 and c[6].component_id == 5 and c[9].n_shingles == 0 and c[1].component_id == 1
    assert packing.pack(odd).agg(F.sum("size")).first()[0] == sum(len(words(r.text)) for r in odd.select("text").collect())
    assert packing.pack(odd.limit(0)).count() == 0
    kept = exact_dedup.keep_first_copies(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 0
    assert jaccard_join.keep_one_each(odd).columns == odd.columns
    assert mixing.repeat_documents(odd, mixing.mix_sources(odd)).columns == odd.columns


# Pipeline -------------------------------------------------------------


def test_pipeline(spark, small):
    import corpus_pipeline as cp

    docs = table(spark, small, "documents")
    size = docs.count()
    for name, f in cp.STAGES[:-1]:
        out = f(spark, docs, small).cache()
        assert out.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "exact":
            last = {}
            for i, t in sorted(rows):
                last[lower(t)] = i
            assert ids == set(last.values())
        if name == "near":
            assert ids == {c for _, c in components(rows).values()} | {i for i, t in rows if not words(t)}
        if name != "mix":
            assert 0 < out.count() <= size
            size = out.count()
        docs = out
    packed = cp.run(spark, small).collect()
    assert sum(r.size for r in packed) == docs.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    used = {}
    for r in packed:
        assert r.doc_id not in used.setdefault(r.bin_id, set()) or r.piece
        used[r.bin_id].add(r.doc_id)


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns through every stage; then no rows."""
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))  # one class alone: all documents pass the first stage
    for docs in (odd, odd.limit(0)):
        size = {}
        for name, f in cp.STAGES[:-1]:
            docs = f(spark, docs, str(tmp_path)).cache()
            assert docs.schema.names == odd.schema.names
            size[name] = docs.count()
            texts = [lower(r.text) for r in docs.select("text").collect()]
            if name == "exact":
                assert len(texts) == len(set(texts))
        n = [size[k] for k in ("quality", "exact", "near")]
        assert n == ([13, 9, 8] if n[0] else [0, 0, 0])
        packed = cp.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.agg(F.sum("size")).first()[0] == (sum(len(words(t)) for t in texts) or None)


def test_sql_helper(small):
    assert rows_of_sql("SELECT count(*) AS n FROM documents", small)[0] == ["n"]
