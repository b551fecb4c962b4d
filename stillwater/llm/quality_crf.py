"""Quality by lines: a linear-chain conditional random field over a text's lines.

Each line is labelled good or bad from features of itself and of the lines before and
after it; forward-backward marginals of `good`, weighted by the lines' lengths, give
the document's score. The model is fitted on a bounded sample of whole texts (`most_docs`
labelled rows, least hash of the id first; a sampled text of more than `most_lines` lines is
left out); each of their lines bears the document's label. Scoring reads every line.

Cases: a null text counts as empty, and an empty text is one line of length 0 (weight 1);
ties and repeated rows get equal scores; documents without a label or with a null label
are not learned from; when one class or both lack labels the model is the prior of the
labels (0.5 without any); no rows give no rows. Only `doc_id` (an integer) and
`text` are read, `quality` from the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import textblocks as tb
from stillwater.llm.common import fold

SYMBOLS = b"#*$%&|<>"
KINDS = ("lower", "upper", "high", "digit", "space", "stop", "bang", "symbol", "other")
_kind = np.full(256, KINDS.index("other"))
_kind[ord("a") : ord("z") + 1] = 0
_kind[ord("A") : ord("Z") + 1] = 1
_kind[128:] = 2
_kind[ord("0") : ord("9") + 1] = 3
_kind[tb.SPACE] = 4
_kind[list(b".,;:'\"()-")] = 5
_kind[list(b"!?")] = 6
_kind[list(SYMBOLS)] = 7
N_OWN = len(KINDS) + 6
N_FEATURES = 1 + 3 * N_OWN + 2


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, length in bytes and text of each line of the texts."""
    n_docs = len(offs) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    doc = np.concatenate([np.arange(n_docs), np.searchsorted(offs, breaks, side="right") - 1])
    doc.sort(kind="stable")
    # A text's last line ends where the text does, the others at their line break.
    last = np.append(doc[1:] != doc[:-1], True)
    ends = np.where(last, offs[doc + 1], np.append(starts[1:] - 1, 0))
    size = ends - starts
    own = np.zeros((len(starts), N_OWN), np.float32)
    kinds = _kind[data]
    for k in range(len(KINDS)):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        own[:, k] = (total[ends] - total[starts]) / np.maximum(size, 1)
    ws, we, _ = tb.tokens(data, np.concatenate([starts, [len(data)]]) if len(starts) else offs)
    line_of = np.searchsorted(starts, ws, side="right") - 1
    words = np.bincount(line_of, minlength=len(starts))
    h = tb.span_hashes(data, ws, we, tb.FOLD)
    per = np.maximum(words, 1)
    k = len(KINDS)
    own[:, k] = np.bincount(line_of, we - ws, len(starts)) / per / 20
    again = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    own[:, k + 1] = np.bincount(line_of[1:][again], minlength=len(starts)) / per
    own[:, k + 2] = np.bincount(_distinct(line_of, h), minlength=len(starts)) / per
    own[:, k + 3] = np.log1p(size) / 8
    own[:, k + 4] = size == 0
    lines = tb.span_hashes(data, starts, ends) + doc.astype(tb.U) * tb.MULTS[3]
    _, inverse, count = np.unique(lines, return_inverse=True, return_counts=True)
    own[:, k + 5] = (count[inverse] > 1) & (size > 0)
    first = np.append(True, doc[1:] != doc[:-1])
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return np.hstack([np.ones((len(starts), 1), np.float32), own, before, after, first[:, None], last[:, None]]).astype(np.float32), size, doc


def _distinct(line_of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The line of each distinct word of a line."""
    key = tb.mix(h + line_of.astype(tb.U) * tb.MULTS[4])
    _, at = np.unique(key, return_index=True)
    return line_of[at]


def marginals(scores: np.ndarray, doc: np.ndarray, n_docs: int, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line by forward-backward, all texts side by side; also log Z and the expected transitions.

    scores: log potential of good against bad; trans: 2x2 log potentials, bad first.
    """
    at = tb.groups(doc, n_docs)
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    live = [int(np.searchsorted(-length[order], -t, side="left")) for t in range(int(length.max(initial=0)))]
    fwd, bwd = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    base = at[:-1][order]
    for t, m in enumerate(live):
        i = base[:m] + t
        emit = np.stack([np.zeros(m), scores[i]], 1)
        fwd[i] = emit if t == 0 else emit + np.logaddexp(fwd[i - 1][:, :1] + trans[0], fwd[i - 1][:, 1:] + trans[1])
    for t in range(len(live) - 2, -1, -1):
        i = base[: live[t + 1]] + t
        nxt = bwd[i + 1] + np.stack([np.zeros(len(i)), scores[i + 1]], 1)
        bwd[i] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
    post = fwd + bwd
    z = np.logaddexp(post[:, 0], post[:, 1])
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    nxt = bwd[inner] + np.stack([np.zeros(len(inner)), scores[inner]], 1)
    pair = np.exp(fwd[inner - 1][:, :, None] + trans[None] + nxt[:, None, :] - z[inner][:, None, None])
    full = length > 0
    return np.exp(post[:, 1] - z), z[at[:-1][full]], pair.sum(0)


def document_scores(good: np.ndarray, size: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    weight = size + 1.0
    return np.bincount(doc, good * weight, n_docs) / np.maximum(np.bincount(doc, weight, n_docs), 1)


def fit(x: np.ndarray, y: np.ndarray, doc: np.ndarray, n_docs: int, l2: float = 1.0, steps: int = 120) -> dict:
    """Adam on the penalised log-likelihood of the line labels (y: 0 or 1 per line); lines are weighted by text so that long texts don't rule."""
    mean, dev = x.mean(0), x.std(0) + 1e-3
    mean[0], dev[0] = 0, 1
    z = (x - mean) / dev
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    for t in range(1, steps + 1):
        p, _, pairs = marginals(z @ theta[:-4], doc, n_docs, theta[-4:].reshape(2, 2))
        g = np.concatenate([z.T @ (y - p), (seen - pairs).ravel()]) - l2 * theta
        g /= len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "dev": dev, "theta": theta}


def score_block(model: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    if "prior" in model:
        return np.full(len(offs) - 1, model["prior"])
    x, size, doc = line_features(data, offs)
    theta = model["theta"]
    good, _, _ = marginals(((x - model["mean"]) / model["dev"]) @ theta[:-4], doc, len(offs) - 1, theta[-4:].reshape(2, 2))
    return document_scores(good, size, doc, len(offs) - 1)


def sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of all lines of each sampled text."""
    for part in tb.slices(batches):
        x, _, doc = line_features(*tb.buffers(part.column("text")))
        at = tb.groups(doc, part.num_rows)
        rows = [x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("good"), pa.array(rows, pa.binary())], names=["doc_id", "good", "x"])


def train(docs: DataFrame, labels: DataFrame, most_docs: int = 2000, most_lines: int = 200) -> dict:
    """The model from labelled rows outside fold 0 of 5."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    marked = marked.where(fold(F.col("doc_id"), 5) != 0)
    # Half of the sample from each label, as far as there are any.
    one = lambda k: marked.where(F.col("good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs // 2)
    chosen = F.broadcast(one(0).unionByName(one(1)))  # most_docs rows at most
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = text.join(chosen, "doc_id").where(F.regexp_count("text", F.lit("\n")) < most_lines)
    rows = text.mapInArrow(sample_lines, "doc_id long, good int, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    share = marked.agg(F.avg("good")).first()[0]
    if len({r.good for r in rows}) < 2:
        return {"prior": 0.5 if share is None else float(share)}
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    doc = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    y = np.repeat([r.good for r in rows], [len(x) for x in xs])
    return fit(np.concatenate(xs).astype(np.float64), y, doc, len(xs))


def scored(model, threshold: float):
    """Adds score and predicted to the columns of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            s = np.clip(score_block(model.value, *tb.buffers(part.column("text"))), 0, 1)
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_docs: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(scored(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_docs: int = 2000) -> DataFrame:
    """The rows of docs with a score of `threshold` or more, in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            yield part.filter(pa.array(score_block(model.value, *tb.buffers(part.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
