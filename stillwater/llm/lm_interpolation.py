"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(w | h) = a2 c(h,w)/c(h) + a1 c(w)/N + a0/(V+1); the weights (a2, a1, a0) belong to the
bucket floor(log2(1 + c(h))) of the context's frequency and are learned by expectation-
maximisation on held-out counts: texts of fold 1 of 10 against the counts of the other
training texts. Scores then use the counts of all training texts (folds 1 to 9).

How the counts are gathered: texts are dealt to blocks of about `block_bytes`. A block
sends each key-range owner its distinct n-grams once, as sorted 64-bit keys with counts;
an owner sums what all blocks sent and returns to each block the totals in the order in
which that block sent its keys, so the keys need not travel back. No n-gram table is
broadcast or collected; the driver sees N, V and a histogram of bounded size.

Cases: a null text counts as empty, which is the end token alone; a null doc_id is held
out; repeated rows are scored and counted once each; without any training text all
counts are 0, base_score is over one unseen type, and score uses the uniform estimate;
no rows give no rows. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.llm import textblocks as tb
from stillwater.llm.common import fold, written
from stillwater.llm.payload import opened, pressed, rising

END, START = (np.array([x], tb.U) for x in (0x9E3779B97F4A7C14, 0x6A09E667F3BCC909))
ONE = tb.U(1)
BUCKETS, STEPS, LEAST = 40, 4, -32  # histogram: bins of 1/4 in log2
PACKED = "block long, owner long, payload binary"


def pack_texts():
    """Rows of a batch, by block, as one compressed payload each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("block")
            blocks = table.column("block").to_numpy()
            kinds, at = np.unique(blocks, return_index=True)
            out = []
            for a, b in zip(at, [*at[1:], len(blocks)], strict=True):
                sink = pa.BufferOutputStream()
                piece = table.slice(a, b - a).combine_chunks()
                with pa.ipc.new_stream(sink, piece.schema) as w:
                    for part in piece.to_batches():
                        w.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=piece.schema))
                out.append(press.compress(sink.getvalue().to_pybytes()))
            if len(kinds):
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(out, pa.binary())], names=["block", "texts"])

    return run


def unpack(payloads: list[bytes]) -> list[pa.RecordBatch]:
    """The rows of a block in an order of their own, whatever order the payloads come in."""
    press = zstandard.ZstdDecompressor()
    return [b for p in sorted(payloads) for b in pa.ipc.open_stream(press.decompress(p)).read_all().to_batches()]


def block_tokens(batches: list[pa.RecordBatch]) -> dict:
    """A block's distinct keys in order, and for each token its row and the places of word, bigram and context among the keys.

    Words have even keys, bigrams and the start mark odd ones.
    """
    uni, bi, new, row, n = [], [], [], [], 0
    for batch in batches:
        for part in tb.slices(iter([batch])):
            data, offs = tb.buffers(part.column("text"))
            starts, ends, doc = tb.tokens(data, offs)
            h = tb.span_hashes(data, starts, ends, tb.FOLD) & ~ONE
            at = tb.groups(doc, part.num_rows)
            # One end after each text's words.
            w = np.insert(h, at[1:], END)
            d = np.insert(doc, at[1:], np.arange(part.num_rows))
            first = np.append(True, d[1:] != d[:-1])
            c = np.concatenate([START, w[:-1]])
            c[first] = START[0]
            uni.append(w), row.append((d + n).astype(np.int32)), new.append(first)
            bi.append(tb.mix(c * tb.MULTS[1] + w * tb.MULTS[2]) | ONE)
            n += part.num_rows
    uni, words = pd.factorize(np.concatenate(uni))
    bi, pairs = pd.factorize(np.concatenate(bi))
    keys = np.concatenate([words, pairs, START])
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int32)
    place[order] = np.arange(len(keys), dtype=np.int32)
    uni, bi, new = place[uni], place[len(words) + bi], np.concatenate(new)
    ctx = np.concatenate([place[-1:], uni[:-1]])
    ctx[new] = place[-1]
    return {"keys": keys[order], "start": int(place[-1]), "uni": uni, "bi": bi, "ctx": ctx, "row": np.concatenate(row), "n": n}


def owner_of(keys: np.ndarray, owners: int) -> np.ndarray:
    return ((keys >> tb.U(32)) * tb.U(owners) >> tb.U(32)).astype(np.int64)


def counts_of(t: dict, rows: np.ndarray) -> np.ndarray:
    """How often each key occurs in the given rows."""
    m = len(t["keys"])
    if not rows.any():
        return np.zeros(m, np.uint32)
    on = slice(None) if rows.all() else rows[t["row"]]
    out = np.bincount(t["uni"][on], minlength=m) + np.bincount(t["bi"][on], minlength=m)
    out[t["start"]] += int(rows.sum())
    return out.astype(np.uint32)


def send_counts(owners: int):
    """A block's keys and counts for each owner."""

    def run(table: pa.Table) -> pa.Table:
        block, batches = table.column("block")[0].as_py(), unpack(table.column("texts").to_pylist())
        folds = np.concatenate([b.column("fold").to_numpy(zero_copy_only=False) for b in batches])
        t = block_tokens(batches)
        keys, c, e = t["keys"], counts_of(t, folds != 0), counts_of(t, folds == 1)
        cut = np.searchsorted(owner_of(keys, owners), np.arange(owners + 1))
        sent = [(block, q, pressed(rising(keys[a:b]), c[a:b], e[a:b])) for q, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
        return pa.table({"block": [x[0] for x in sent], "owner": [x[1] for x in sent], "payload": pa.array([x[2] for x in sent], pa.binary())})

    return run


TOTALS = PACKED + ", n long, n_tune long, v long"


def sum_counts(table: pa.Table) -> pa.Table:
    """An owner's totals, returned to each block in its own order; and what the owner's words add to N and V."""
    owner, blocks, blobs = table.column("owner")[0].as_py(), table.column("block").to_pylist(), table.column("payload").to_pylist()
    got = [(np.cumsum(k, dtype=tb.U), x, y) for k, x, y in (opened(b, tb.U, np.uint32, np.uint32) for b in blobs)]
    keys = np.unique(np.concatenate([g[0] for g in got]))
    c, e = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for k, x, y in got:
        at = np.searchsorted(keys, k)
        c[at] += x
        e[at] += y
    words = (keys & ONE) == 0
    out = [(b, owner, pressed(c[at := np.searchsorted(keys, g[0])], e[at]), 0, 0, 0) for b, g in zip(blocks, got, strict=True)]
    out.append((-1, owner, b"", int(c[words].sum()), int(e[words].sum()), int((c[words] > 0).sum())))
    cols = list(zip(*out, strict=True))
    return pa.table({"block": cols[0], "owner": cols[1], "payload": pa.array(cols[2], pa.binary()), "n": cols[3], "n_tune": cols[4], "v": cols[5]})


def with_totals(texts: pa.Table, totals: pa.Table) -> tuple[list[pa.RecordBatch], dict, dict]:
    """The block's rows and tokens, and each token's totals: c, e of word, bigram and context."""
    batches = unpack(texts.column("texts").to_pylist())
    t = block_tokens(batches)
    order = np.argsort(totals.column("owner").to_numpy())
    blobs = totals.column("payload").to_pylist()
    got = [opened(blobs[i], np.int64, np.int64) for i in order]
    c, e = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    if len(c) != len(t["keys"]):
        raise ValueError("a block's keys and totals differ")
    return batches, t, {kind: (c[t[kind]], e[t[kind]]) for kind in ("uni", "bi", "ctx")}


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c + 1.0)[1] - 1, BUCKETS - 1)


def ratios(cw, chw, ch, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and unigram estimates over the uniform one."""
    u = v + 1.0
    return np.where(ch > 0, chw / np.maximum(ch, 1), 0) * u, (cw / n if n else np.zeros(len(cw))) * u


def tune_histogram(n: int, v: int):
    """Held-out tokens by context bucket and binned estimates."""

    def bins(r: np.ndarray) -> np.ndarray:
        return np.where(r > 0, np.round(np.log2(np.maximum(r, 2.0**LEAST)) * STEPS), -(10**6)).astype(np.int64)

    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        none = pa.table({k: pa.array([], pa.int64()) for k in ("bucket", "r2", "r1", "n")})
        if not texts.num_rows:
            return none
        _, _, got = with_totals(texts, totals)
        (cw, ew), (cb, eb), (cc, ec) = got["uni"], got["bi"], got["ctx"]
        b = context_bucket(cc - ec)
        r2, r1 = ratios(cw - ew, cb - eb, cc - ec, n, v)
        rows, count = np.unique(np.stack([b, bins(r2), bins(r1)], 1), axis=0, return_counts=True)
        return pa.table({"bucket": rows[:, 0], "r2": rows[:, 1], "r1": rows[:, 2], "n": count.astype(np.int64)})

    return run


def learn_weights(hist: list[tuple[int, float, float, int]], steps: int = 60) -> np.ndarray:
    """EM for each bucket's (a2, a1, a0) on ratios to the uniform estimate; a bucket without tokens takes the next lower one's."""
    out = np.tile(np.array([0.0, 0.9, 0.1]), (BUCKETS, 1))
    for k in range(BUCKETS):
        rows = [(r2, r1, 1.0, n) for b, r2, r1, n in hist if b == k]
        if not rows:
            out[k] = out[k - 1] if k else out[k]
            continue
        x = np.array(rows)
        a = np.full(3, 1 / 3)
        for _ in range(steps):
            p = a * x[:, :3]
            p /= p.sum(1, keepdims=True)
            a = (p * x[:, 3:]).sum(0) + np.array([0, 0, 0.5])  # the uniform part never vanishes
            a /= a.sum()
        out[k] = a
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_rows(weights: np.ndarray, n: int, v: int):
    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({f.split()[0]: pa.array([], k) for f, k in zip(SCORES.split(", "), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        batches, t, got = with_totals(texts, totals)
        cw, cb, cc = got["uni"][0], got["bi"][0], got["ctx"][0]
        base = np.log10((cw + 0.1) / (n + 0.1 * (v + 1)))
        a = weights[context_bucket(cc)]
        r2, r1 = ratios(cw, cb, cc, n, v)
        p = np.log10((a[:, 0] * r2 + a[:, 1] * r1 + a[:, 2]) / (v + 1.0))
        add = lambda x: np.bincount(t["row"], x, t["n"])
        rows = pa.Table.from_batches(batches)
        return pa.table({
            "doc_id": rows.column("doc_id"), "held_out": pa.array(rows.column("fold").to_numpy() == 0),
            "n_tokens": np.bincount(t["row"], minlength=t["n"]), "n_known": add(cw > 0).astype(np.int64), "train_tokens": np.full(t["n"], n, np.int64),
            "base_score": add(base), "score": add(p),
        })

    return run


def dealt(docs: DataFrame, n_blocks: int, tune_blocks: int, portion: Column | None) -> DataFrame:
    """doc_id, fold, block, text: rows by hash of all that tells them apart, those of fold 1 in the first blocks."""
    f = fold(F.col("doc_id"), 10)
    mixed = F.xxhash64("doc_id", "text", *([] if portion is None else [portion]))
    block = F.when(f == 1, F.pmod(mixed, F.lit(tune_blocks))).otherwise(tune_blocks + F.pmod(mixed, F.lit(n_blocks)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), f.alias("fold"), block.cast("long").alias("block"), F.coalesce("text", F.lit("")).alias("text"))


def lm_scores(docs: DataFrame, block_bytes: int = 12 << 20, owner_bytes: int = 12 << 20, portion: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document.

    block_bytes: text a block holds, in one task's memory; owner_bytes: text whose n-grams an owner sums; portion: what tells
    equal rows apart, the same whenever a row is read (where it was read, say), so that many equal rows go to many blocks.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, owners = -(-total // block_bytes) or 1, -(-total // owner_bytes) or 1
    # Tuning texts (fold 1) have blocks of their own, so that learning the weights reads these alone.
    tune_blocks = max(1, n_blocks // 10)
    rows = dealt(docs, n_blocks, tune_blocks, portion)

    def packed(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(pack_texts(), "block long, texts binary")

    sent = packed(rows).groupBy("block").applyInArrow(send_counts(owners), PACKED)
    totals = written(sent.groupBy("owner").applyInArrow(sum_counts, TOTALS), "totals")
    n, n_tune, v = (int(x or 0) for x in totals.where("block = -1").agg(F.sum("n"), F.sum("n_tune"), F.sum("v")).first())
    back = totals.where("block >= 0").select("block", "owner", "payload")
    tune = packed(rows.where("fold = 1")).groupBy("block").cogroup(back.where(F.col("block") < tune_blocks).groupBy("block"))
    hist = tune.applyInArrow(tune_histogram(n - n_tune, v), "bucket long, r2 long, r1 long, n long").groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n")).collect()
    real = lambda r: 2.0 ** (r / STEPS) if r > -(10**6) else 0.0
    weights = learn_weights([(h.bucket, real(h.r2), real(h.r1), h.n) for h in hist])
    both = packed(rows).groupBy("block").cogroup(back.groupBy("block"))
    return both.applyInArrow(score_rows(weights, n, v), SCORES)
