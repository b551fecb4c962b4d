"""Toxicity: a linear classifier regularised by counterfactuals.

Sentences are bags of words and of word prefixes. The model knows the features that mark
toxic texts and every identity term. Labelled sentences that name an identity group are
copied with the group swapped for another; the loss adds a penalty on the squared change of
score between a sentence and its copies, so naming a group does not by itself raise the
score. Copies count in the penalty alone. A text's score is that of its most toxic sentence.

It is fitted on a bounded sample (`most_docs` labelled rows, least hash of the id
first); a sentence starts with the label of its text, and in further rounds only those
sentences of a toxic text keep it that the round before finds toxic. Scoring reads
every sentence of every text.

Cases: a null or empty text has no sentence and gets the score of an empty sentence;
ties and repeated rows get equal scores; rows without a label are not learned from;
without both classes the score is the share of the one there is (0 without any); no
rows give no rows. Only `doc_id` (an integer) and `text` are read, `toxic` from the labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import textblocks as tb
from stillwater.llm.common import fold, written

#: Identity terms by kind; a term is swapped for the others of its row.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man"), ("she", "he"), ("her", "his"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "natives", "refugees"),
    ("disabled", "deaf", "blind"), ("old", "young", "elderly"), ("femmes", "hommes"), ("musulmans", "juifs"), ("mujeres", "hombres"),
    ("musulmanes", "cristianos"), ("frauen", "männer"), ("muslime", "christen", "juden"),
)
ENDS = np.zeros(256, bool)
ENDS[[10, ord("."), ord("!"), ord("?")]] = True
#: Bytes that are dropped at both sides of a word: all of ASCII but letters and digits.
BARE = np.ones(256, bool)
BARE[[b for b in range(128) if not chr(b).isalnum()]] = False
PREFIXES = (4, 5, 6)
SALTS = np.array([1, 2, 3, 4], tb.U) * tb.MULTS[7]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and sentence of each run of letters and digits; sentences are numbered through the block."""
    word = BARE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offs[1:] > offs[:-1]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    first[heads], last[tails] = word[heads], word[tails]
    cut = np.zeros(len(data) + 1, np.int64)
    cut[1:] = np.cumsum(ENDS[data])
    return np.flatnonzero(first), np.flatnonzero(last) + 1, cut


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and sentence of each word and prefix, and the text of each sentence; sentences are numbered from 0, ascending by text."""
    starts, ends, cut = word_spans(data, offs)
    doc = np.searchsorted(offs, starts, side="right") - 1
    key = cut[starts] + doc  # rises at a sentence's end and at a text's
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    sent = np.cumsum(new) - 1
    feats = [(tb.span_hashes(data, starts, ends, tb.FOLD) + SALTS[0], sent)]
    for k, n in enumerate(PREFIXES):
        long = ends - starts > n
        feats.append((tb.span_hashes(data, starts[long], starts[long] + n, tb.FOLD) + SALTS[k + 1], sent[long]))
    return np.concatenate([h for h, _ in feats]), np.concatenate([x for _, x in feats]), doc[new]


def only_known(h: np.ndarray, s: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sentence, number of the feature) pairs of the features that the model knows."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[at] == h
    pairs = np.unique(s[hit] * len(known) + at[hit])
    return pairs // len(known), pairs % len(known)


def swapped(text: str) -> list[str]:
    """Copies of a text with each identity group that it names swapped for every other of its row."""
    out = []
    for row in IDENTITY:
        found = re.compile(r"\b(" + "|".join(row) + r")\b", re.I)
        if found.search(text):
            for turn in range(1, len(row)):
                out.append(found.sub(lambda m, row=row, turn=turn: row[(row.index(m[0].lower()) + turn) % len(row)], text))
    return out


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts of a piece each feature is; equal texts of a piece count once."""
    for part in tb.slices(batches):
        h, s, doc = features(*tb.buffers(part.column("text")))
        toxic = np.array(part.column("toxic").to_pylist())
        d = doc[s] if len(s) else np.zeros(0, np.int64)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
        kinds, at = np.unique(h[new], return_inverse=True)
        y = toxic[d[new]]
        n = np.bincount(at, minlength=len(kinds))
        bad = np.bincount(at, y, len(kinds)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(bad), pa.array(n - bad)], names=["f", "bad", "good"])


def sample_rows(known):
    """Sentences of the sampled texts as known features; copies are the same sentences with a group swapped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            ids, toxic, texts = (part.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))
            out = []
            for i, y, text in zip(ids, toxic, texts, strict=True):
                for copy, one in enumerate([text, *swapped(text)]):
                    data = np.frombuffer(one.encode(), np.uint8)
                    h, s, doc = features(data, np.array([0, len(data)]))
                    s, f = only_known(h, s, known.value)
                    out.append((i, y, copy, len(doc), s.astype(np.int32).tobytes(), f.astype(np.int32).tobytes()))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "toxic", "copy", "n", "s", "f"])

    return run


class Rows:
    """A sparse 0/1 matrix as the (row, column) pairs of its ones."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n: int):
        self.row, self.col, self.n = row, col, n

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray, m: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], m)


def loss_and_gradient(theta: np.ndarray, x: Rows, y: np.ndarray, weight: np.ndarray, pairs: np.ndarray, swap: float, l2: float) -> tuple[float, np.ndarray]:
    """Weighted log-loss + swap * mean squared change of logit over (sentence, copy) pairs + l2 / 2 * squared weights.

    theta: a weight for each feature, then the constant.
    """
    w = theta[:-1]
    z = x.dot(w) + theta[-1]
    share = weight / weight.sum()
    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
    loss = float((share * (np.logaddexp(0, z) - y * z)).sum() + l2 / 2 * (w * w).sum())
    if len(pairs):
        gap = z[pairs[:, 0]] - z[pairs[:, 1]]
        loss += swap * float((gap * gap).mean())
        d = 2 * swap * gap / len(pairs)
        np.add.at(g, pairs[:, 0], d)
        np.add.at(g, pairs[:, 1], -d)
    return loss, np.append(x.back(g, len(w)) + l2 * w, g.sum())


def fit(x: Rows, m: int, y: np.ndarray, weight: np.ndarray, pairs: np.ndarray, swap: float, l2: float, start: np.ndarray | None = None, steps: int = 200, still: float = 1e-5) -> np.ndarray:
    """Adam until the gradient is below `still` everywhere, `steps` at most."""
    theta, a, v = np.zeros(m + 1) if start is None else start, 0.0, 0.0
    for t in range(1, steps + 1):
        _, grad = loss_and_gradient(theta, x, y, weight, pairs, swap, l2)
        if np.abs(grad).max() < still:
            break
        a, v = 0.9 * a + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return theta


def identity_features() -> np.ndarray:
    """Hashes of the identity terms as words, sorted."""
    data, offs = tb.buffers(pa.array([t for row in IDENTITY for t in row]))
    h, _, _ = features(data, offs)
    return np.unique(h[: len(offs) - 1])  # the words come before their prefixes


def telling(counts: DataFrame, n_bad: int, n_good: int, least: float) -> np.ndarray:
    """Hashes of the features that mark toxic texts: at least 3 of them, a higher share than of the others, and a
    log-likelihood ratio of `least`. They are features of the sample, so their number is bounded with it."""
    a, c = F.col("bad").cast("double"), F.col("good").cast("double")
    n = a + c
    share = n_bad / (n_bad + n_good)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g2 = 2 * (part(a, n * share) + part(c, n * (1 - share)))
    rows = counts.groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where((F.col("bad") >= 3) & (a > n * share) & (g2 >= least)).select("f").collect()
    return np.array([r.f for r in rows], np.int64).view(tb.U)


def train(docs: DataFrame, labels: DataFrame, most_docs: int, swap: float, l2: float, least: float) -> dict:
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where(fold(F.col("doc_id"), 5) != 0)
    chosen = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs))  # most_docs rows at most
    sample = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id"), "sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {"prior": float(max(n, default=0))}
    marks, groups = telling(sample.mapInArrow(count_features, "f long, bad long, good long"), n[1], n[0], least), identity_features()
    known = np.union1d(marks, groups)
    spark = docs.sparkSession
    rows = sample.mapInArrow(sample_rows(spark.sparkContext.broadcast(known)), "doc_id long, toxic int, copy int, n int, s binary, f binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.copy, r.f))
    row, col, y, doc, real, pairs, at, first = [], [], [], [], [], [], 0, {}
    for k, r in enumerate(rows):
        row.append(np.frombuffer(r.s, np.int32) + at), col.append(np.frombuffer(r.f, np.int32))
        y.append(np.full(r.n, r.toxic)), doc.append(np.full(r.n, k)), real.append(np.full(r.n, r.copy == 0))
        if r.copy == 0:
            first[r.doc_id] = (at, r.n)
        elif first.get(r.doc_id, (0, -1))[1] == r.n:
            pairs.append(np.stack([first[r.doc_id][0] + np.arange(r.n), at + np.arange(r.n)], 1))
        at += r.n
    row, col, y, doc, real = (np.concatenate(a) for a in (row, col, y, doc, real))
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    x, m = Rows(row, col, at), len(known)
    per = np.bincount(doc, minlength=len(rows))
    named = np.bincount(row[np.isin(known, marks)[col]], minlength=at) > 0
    # A toxic text's sentences without any telling feature are not what makes it toxic.
    hit, theta = (y == 1) & named & real, None
    for _ in range(3):
        weight = np.where(y == 1, hit / np.maximum(np.bincount(doc[hit], minlength=len(rows))[doc], 1), 1 / per[doc]) * real + 1e-12 * real
        theta = fit(x, m, hit.astype(float), weight, pairs, swap, l2, theta)
        w, b = theta[:-1], float(theta[-1])
        z = x.dot(w) + b
        top = np.full(len(rows), -np.inf)
        np.maximum.at(top, doc, z)
        hit = (y == 1) & named & real & ((z >= top[doc] - 1e-9) | (z > 0))
    # 0.5 lies where the sampled texts are parted best.
    whole = np.array([r.copy == 0 for r in rows])
    top = np.full(len(rows), b)
    np.maximum.at(top, doc, z)
    top, toxic = top[whole], np.array([r.toxic for r in rows])[whole]
    cuts = np.unique(top)
    mids = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    bad, good = np.sort(top[toxic == 1]), np.sort(top[toxic == 0])
    wrong = np.searchsorted(bad, mids) / len(bad) + 1 - np.searchsorted(good, mids) / len(good)
    best = mids[wrong <= wrong.min() + 1e-12]
    return {"known": known, "w": w, "b": b - float(np.median(best))}


def score_block(model: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    if "prior" in model:
        return np.full(n, model["prior"])
    h, s, doc = features(data, offs)
    s, f = only_known(h, s, model["known"])
    z = np.bincount(s, model["w"][f], len(doc)) + model["b"]
    top = np.full(n, model["b"])
    np.maximum.at(top, doc, z)
    return 1 / (1 + np.exp(-np.clip(top, -30, 30)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, most_docs: int = 8000, swap: float = 1.0, l2: float = 1e-4, least: float = 20.0) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document. swap: weight of the penalty."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_docs, swap, l2, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            p = score_block(model.value, *tb.buffers(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
