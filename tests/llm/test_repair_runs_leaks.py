"""Decontamination, conversation repair and periodic runs against brute force and odd inputs."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.llm import conversation_repair as cr
from stillwater.llm import decontamination as dc
from stillwater.llm import periodic_runs as pr
from stillwater.llm import queries

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# decontamination ----------------------------------------------------


def leak_words(text):
    return ITEM_WORD.findall((text or "").translate(AZ))


def leaks(docs, items):
    """{doc row: (n_words, hit words, items)} by comparing every window with every place."""
    wins = {}
    for item, text in items:
        w = leak_words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in wins}
    out = []
    for _, text in docs:
        w, hit, names = leak_words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (found := wins.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    names |= found
        out.append((len(w), hit, sorted(names)))
    return out


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(40)] + ["É", "über", "日本"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, line(rng.choice([10, 11, 25, 60]))) for k in range(30)]
    items += [(100, "One two."), (101, "!!"), (None, "null id of ten words or more is here to be found again"), (102, None), (0, line(12)), (103, items[3][1]), (3, items[3][1]), (104, line(400))]
    docs = [(1, ""), (2, None), (3, "ONE, TWO!"), (4, "one. three two"), (5, "nothing here")]
    for k in range(60):
        _, text = rng.choice(items)
        piece = (text or "").split(" ")
        a = rng.randrange(len(piece))
        docs.append((10 + k, f"{line(rng.randrange(15))} {' -- '.join(piece[a : a + rng.randrange(1, 40)]).upper()} {line(rng.randrange(9))}"))
    docs += [docs[-1], docs[-1], (200, " ".join(t or "" for _, t in items) * 3)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit("mine")), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most,piece", [(dc.MOST_WORDS, dc.PIECE), (150, 30)])
def test_leaks(leaky, most, piece):
    docs, items, frame, bench = leaky
    got = sorted((r.doc_id, r.n_words, tuple(sorted({i for s in r.hits_ for i in range(s.start, s.end)})), tuple(r["items"])) for r in dc.hits(frame, bench, most_words=most, piece=piece).collect())
    assert got == sorted((d[0], n, tuple(sorted(hit)), tuple(names)) for d, (n, hit, names) in zip(docs, leaks(docs, items), strict=True))


def test_leaks_slices_hold_their_bound(leaky):
    cut = dc.pieces(leaky[3], 30)
    slices = dc.slice_frames(cut, 150)
    assert len(slices) > 1
    assert sum(s.count() for s in slices) == cut.count()
    assert all(sum(r.n for r in s.collect()) <= 150 or s.count() == 1 for s in slices)


def test_leaks_equal_hashes(monkeypatch):
    """All windows with one hash: still told apart."""
    monkeypatch.setattr(dc, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), dc.tb.U))
    index = dc.build(["a", "b"], ["x y z", "p q r"])
    hit, found = dc.find(index, dc.words_of(dc.pa.array(["p q r s", "x y q", "x y z"])))
    assert hit.tolist() == [True] * 3 + [False] * 4 + [True] * 3
    assert [[index["names"][i] for i in x] for x in found] == [["b"], [], ["a"]]


def test_leaks_taken_out(leaky):
    docs, items, frame, bench = leaky
    want = {d[0]: hit for d, (_, hit, _) in zip(docs, leaks(docs, items), strict=True)}
    clean = dc.decontaminate(frame, bench)
    assert clean.columns == frame.columns
    texts = dict(docs)
    for r in clean.collect():
        assert leak_words(r.text) == [w for i, w in enumerate(leak_words(texts[r.doc_id])) if i not in want[r.doc_id]]
        assert r.hits == "mine"
    left = sorted(r.doc_id for r in dc.decontaminate(frame, bench, "documents").collect())
    assert left == sorted(d[0] for d in docs if not want[d[0]])
    with pytest.raises(ValueError):
        dc.decontaminate(frame, bench, "nothing")


def test_leaks_odd(spark, odd):
    none = spark.createDataFrame([], "item_id string, text string")
    assert dc.hits(odd, none).where(F.size(F.col("hits")) > 0).count() == 0
    assert dc.hits(odd.limit(0), none).count() == 0
    own = odd.select(F.col("doc_id").alias("item_id"), "text")
    got = dc.hits(odd, own).collect()
    assert len(got) == odd.count()
    assert all((len(leak_words(r.text)) > 0) == (len(r.hits) > 0) for r in got)


# periodic runs ------------------------------------------------------


def runs(w, least=24, times=3):
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - p:
            a = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i - a + p >= max(least, times * p) and i > a:
                found.setdefault((a, i - a + p), p)
            i += i == a
    return sorted((a, p, n) for (a, n), p in found.items())


@pytest.mark.parametrize("least,times", [(24, 3), (2, 2), (7, 4)])
def test_runs(least, times):
    rng = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 9)):
            n, k = rng.choice([0, 1, 5, 23, 24, 25, 70, 260]), rng.choice([1, 2, 3, 40])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 3 and rng.random() < 0.6:
                a = rng.randrange(n)
                p, b = rng.randint(1, max(1, (n - a) // 3)), rng.randint(a, n)
                w[a:b] = [w[a + (i - a) % p] for i in range(a, b)]
            texts.append(w)
        got = pr.runs_of(np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts]), least, times)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, w in enumerate(texts) for r in runs(w, least, times)]


def test_grammar_extensions():
    rng = np.random.default_rng(3)
    w = np.concatenate([[9], rng.integers(0, 2, 700), np.tile(rng.integers(0, 2, 11), 30), [10]])
    g = pr.Grammar(w, 9)
    assert len(g.sym[-1]) == 3 and len(g.sym) < 90
    i = rng.integers(1, len(w) - 2, 4000)
    j = np.minimum(i + rng.integers(1, 400, 4000), len(w) - 1)
    i, j = i[i < j], j[i < j]
    ahead, back = g.extend(i, j, 1), g.extend(i, j, -1)
    for a, b, f, r in zip(i.tolist(), j.tolist(), ahead.tolist(), back.tolist(), strict=True):
        n = 0
        while w[a + n] == w[b + n]:
            n += 1
        m = 0
        while w[a - m - 1] == w[b - m - 1]:
            m += 1
        assert (f, r) == (n, m)


def test_grid_in_pieces(monkeypatch):
    whole = [np.concatenate(x) for x in zip(*pr.grid(np.array([24, 100, 3000]), 24, 3), strict=True)]
    monkeypatch.setattr(pr, "CHUNK", 50)
    parts = list(pr.grid(np.array([24, 100, 3000]), 24, 3))
    assert len(parts) > 100
    for a, b in zip(whole, zip(*parts, strict=True), strict=True):
        assert (a == np.concatenate(b)).all()


def test_runs_odd(spark, odd):
    more = spark.createDataFrame([(20, "ab  c\n" * 30 + "tail É"), (21, "É ß\t" * 40), (22, "x " * 23), (23, "X x " * 12)], "doc_id long, text string")
    got = pr.periodic_runs(odd.select("doc_id", "text", F.lit(1).alias("runs")).unionByName(more.withColumn("runs", F.lit(1)))).collect()
    assert len(got) == odd.count() + 4
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = runs(w) if len(w) < 5000 else [(a, 977, len(w) - a - (w[-1] == "end")) for a in [0]]
        assert [(x.start, x.period, x.length) for x in r.runs_] == want
        gone = {i for a, p, n in want for i in range(a + p, a + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert pr.periodic_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(odd, times=1)


# conversation repair ------------------------------------------------


def repaired(rows):
    """The contract by hand for the rows of one conversation in order: (turn, role, text)."""
    seen, marks = set(), []
    for _, role, text in rows:
        ink = re.sub(r"[\x20\x09-\x0D]+", "", text)
        marks.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    due = {0: 2, 1: 2, 2: 3, 3: 2}

    @cache
    def best(i, place, inserts):
        ways = [(0, "", ())] if i == len(rows) and place in (0, 3) else []
        if inserts < 3:
            c, s, out = best(i, due[place], inserts + 1)
            ways.append((c + 2, "I" + s, (("user" if due[place] == 2 else "assistant") + ":", *out)))
        if i < len(rows):
            _, role, text = rows[i]
            c, s, out = best(i + 1, place, 0)
            ways.append((c + 3, "D" + s, out))
            if marks[i] not in ("blank", "duplicate"):
                more = marks[i] == "truncated"
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((place, role[:1]))
                if to is not None:
                    c, s, out = best(i + 1, to, 0)
                    ways.append((c + more, "K" + s, (f"{role}:{text}", *out)))
                c, s, out = best(i + 1, due[place], 0)
                ways.append((c + 2 + more, "R" + s, (f"{'user' if due[place] == 2 else 'assistant'}:{text}", *out)))
        return min(ways, default=(10**9, "~", ()))

    for i in range(len(rows), -1, -1):  # from the end, so that recursion stays shallow
        for place in range(4):
            best(i, place, 0)
    cost, audit, out = best(0, 0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    letters = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), out,
    )


def ordered(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(12)
    line = lambda: rng.choice(["", " ", "a.", "b!", "c?", "open", "open ", "same.", "same.", "é.\n", None])
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
    rows = []
    for c in [*range(40), None, 7]:
        turns = rng.choice([list(range(rng.randint(1, 9))), [None, 0, 0, 1, 5], [None, None], [3, 3, 3]])
        rows += [(c, t, role(), line()) for t in turns]
    rows += [(500, t, ["user", "assistant"][t % 2], f"{t % 37}{'.' * (t % 5)}") for t in range(900)]  # many texts come again
    rows += [(501, 4, "user", "copies.")] * 300 + [(501, 5, "assistant", "x.")]
    return rows


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_repair(spark, talks, parts):
    by = {}
    for c, *row in talks:
        by.setdefault(c, []).append(tuple(row))
    want = {c: repaired(ordered(rows)) for c, rows in by.items()}
    frame = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("c", F.lit("mine")).withColumn("at", F.lit(1)).repartition(3)
    at, wide = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.conv_id: tuple(r)[1:] for r in cr.digests(frame, frame.select("conv_id").unionByName(spark.createDataFrame([(999,)], "conv_id long"))).collect()}
        assert got.pop(999) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert got == {c: v[:-1] for c, v in want.items()}
        rows = cr.repair(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", at)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", wide)
    for c, v in want.items():
        mine = sorted((r for r in rows if r.conv_id == c), key=lambda r: (r["at"], r.step))
        assert "".join(r.edit for r in mine) == v[6]
        assert tuple(f"{r.role}:{r.text}" for r in mine if r.edit != "D") == v[8]


def test_block_tables():
    t = cr.tables()
    n = len(t["vectors"])
    assert 4 < n < 100 and t["block"].shape == (n, (cr.NONE + 1) ** cr.BLOCK)
    assert all(max(v) <= 4 for v in t["vectors"])
    rng = random.Random(4)
    for _ in range(200):
        symbols = [rng.randrange(cr.NONE) for _ in range(rng.randint(0, 30))]
        v, costs = np.arange(n), cr.END
        for s in reversed(symbols):
            costs = cr.before(costs, s)
        assert t["vectors"][cr.backward(symbols, v)[0][0]] == tuple(x - min(costs) for x in costs)
        k = rng.randint(0, len(symbols))
        behind = cr.backward(symbols[k:], v)[0]
        assert (cr.backward(symbols[:k], v)[0][behind] == cr.backward(symbols, v)[0]).all()
        place = cr.exits(symbols[:k])[behind[0]][cr.START]
        assert cr.expand(symbols, 0, cr.START)[0] == cr.expand(symbols[:k], int(behind[0]), cr.START)[0] + cr.expand(symbols[k:], 0, int(place))[0]


def test_repair_odd(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert cr.digests(empty, empty).count() == 0 and cr.repair(empty).count() == 0
    long = " ".join(["word"] * 60_000) + "."
    rows = spark.createDataFrame([("a", 1, "user", long), ("a", 2, "assistant", long), (None, None, None, None)], empty.schema)
    got = {r.conv_id: r for r in cr.digests(rows, rows).collect()}
    assert got["a"].audit == "KK" and got["a"].repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert (got[None].audit, got[None].blank, got[None].gaps) == ("D", 1, 0)


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(30) for t, r, x in ((0, "system", "a.b"), (1, None, None), (None, "assistant", "x!"))]
    got = sorted(map(tuple, queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        k, r, x = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20, r or " ", x or " "
        want += [] if k == 0 else [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    assert got == sorted(want, key=str)


def test_planted_repeats(spark):
    rows = [(d, t) for d in [*range(60), None] for t in (" ".join(f"w{i}" for i in range(40)) + "\n", "", None, " one ")]
    got = sorted(((r.doc_id, tuple((r.text or "").split())) for r in queries.with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = []
    for d, t in rows:
        w, h = (t or "").split(), 1 if d is None else zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want.append((d, tuple(w)))
    assert got == sorted(want, key=str)
