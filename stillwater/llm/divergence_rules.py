"""Quality rules by divergence: a text's histograms against those of the languages.

Two histograms of each text, of character classes and of common words, are compared
with every language's own by Jensen-Shannon distance (base 2, 0 to 1); the nearest
language counts. Guards leave texts alone that are too short for a histogram. Texts
that the base rules fail are not kept either: fewer than 50 words, or more than half
of the words in repeated 3-word windows.

Languages are the values of `lang`; a language's reference counts all words of all its
rows, and needs `least_reference` words to be one. Common words are the `common` largest of
2^16 hash cells, so the counts of a language have one size for any corpus. A task's counts
are added in a tree, 64 at a time.

Cases: a null or empty text has no words and fails; a null lang adds to no
reference and is judged by all; without any reference the base rules alone decide;
repeated rows get equal results and count each; no rows give no rows. Only `doc_id` (an
integer), `text` and `lang` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import textblocks as tb
from stillwater.llm.common import tree_sum, written
from stillwater.llm.payload import opened, pressed

CLASSES = ("vowel", "consonant", "upper", "high", "digit", "space", "break", "stop", "bang", "symbol", "other")
CELLS = 1 << 16
_class = np.full(256, 10)
for _k, _chars in enumerate((b"aeiou", bytes(c for c in range(97, 123) if c not in b"aeiou"), bytes(range(65, 91)), bytes(range(192, 256)), b"0123456789", b" \t\r\v\f", b"\n", b".,;:'\"()-", b"!?", b"#*$%&|<>")):
    _class[list(_chars)] = _k
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offs[1:]] - total[offs[:-1]]


def block(part: pa.RecordBatch) -> dict:
    data, offs = tb.buffers(part.column("text"))
    starts, ends, doc = tb.tokens(data, offs)
    return {"data": data, "offs": offs, "starts": starts, "ends": ends, "doc": doc, "n": part.num_rows, "cell": (tb.span_hashes(data, starts, ends, tb.FOLD) >> tb.U(48)).astype(np.int64)}


def class_counts(b: dict) -> np.ndarray:
    lead = tb.IS_LEAD[b["data"]]
    kinds = _class[b["data"]]
    return np.stack([per_text(lead & (kinds == k), b["offs"]) for k in range(len(CLASSES))], 1)


def base_counts(b: dict) -> dict[str, np.ndarray]:
    """The base columns of each text of a block."""
    data, offs, starts, ends, doc, n = (b[k] for k in ("data", "offs", "starts", "ends", "doc", "n"))
    n_words = np.bincount(doc, minlength=n)
    lead = tb.IS_LEAD[data] & tb.IS_WORD[data]
    # Repeated windows: a word counts when any window over it is found twice in its text.
    h, first = tb.windows(tb.span_hashes(data, starts, ends), doc, 3)
    in_text = tb.mix(h + doc[first].astype(tb.U) * tb.MULTS[6])
    _, inverse, count = np.unique(in_text, return_inverse=True, return_counts=True)
    again = first[count[inverse] > 1] if len(first) else first
    hit = np.zeros(len(starts) + 2, bool)
    for j in range(3):
        hit[again + j] = True
    repeat = np.bincount(doc[hit[: len(starts)]], minlength=n)
    # Lines equal to an earlier line of the text, with a word.
    breaks = np.flatnonzero(data == 10)
    ls = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    ld = np.sort(np.concatenate([np.arange(n), np.searchsorted(offs, breaks, side="right") - 1]), kind="stable")
    last = np.append(ld[1:] != ld[:-1], True)[: len(ls)]
    le = np.where(last, offs[ld + 1], np.append(ls[1:] - 1, 0)[: len(ls)])
    some = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, ld = ls[some], le[some], ld[some]
    lines = tb.mix(tb.span_hashes(data, ls, le) + ld.astype(tb.U) * tb.MULTS[8])
    fresh = np.zeros(len(lines), bool)
    fresh[np.unique(lines, return_index=True)[1]] = True
    return {
        "n_words": n_words, "word_chars": per_text(lead, offs), "n_symbols": per_text(SYMBOL[data], offs),
        "n_dup_lines": np.bincount(ld[~fresh], minlength=n), "n_repeat_words": repeat,
    }


COUNTS = "lang string, part int, counts binary"


def count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's counts of classes and cells by language."""
    total = {}
    for part in tb.slices(batches):
        b, langs = block(part), np.array(part.column("lang").to_pylist(), object)
        classes = class_counts(b)
        for lang in {x for x in langs if x is not None}:
            on = langs == lang
            c, w = total.setdefault(lang, (np.zeros(len(CLASSES), np.int64), np.zeros(CELLS, np.int64)))
            c += classes[on].sum(0)
            w += np.bincount(b["cell"][on[b["doc"]]], minlength=CELLS)
    if total:
        at = pa.array([TaskContext.get().partitionId()] * len(total), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), at, pa.array([pressed(c, w) for c, w in total.values()], pa.binary())], names=["lang", "part", "counts"])


def add_counts(table: pa.Table) -> pa.Table:
    classes, cells = np.zeros(len(CLASSES), np.int64), np.zeros(CELLS, np.int64)
    for blob in table.column("counts").to_pylist():
        c, w = opened(blob, np.int64, np.int64)
        classes, cells = classes + c, cells + w
    return pa.table({"lang": table.column("lang").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([pressed(classes, cells)], pa.binary())})


def references(docs: DataFrame, common: int, least_reference: int) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """For each language: name, class shares, slot of each cell (`common`: none), shares of the slots. One row a language."""
    rows = written(docs.select("text", "lang").mapInArrow(count_languages, COUNTS), "counts")
    out = []
    for r in sorted(tree_sum(rows, "lang", add_counts, COUNTS).collect(), key=lambda r: r.lang):
        classes, cells = opened(r.counts, np.int64, np.int64)
        if cells.sum() < max(least_reference, 1):
            continue
        top = np.argsort(-cells, kind="stable")[:common]
        slot = np.full(CELLS, common, np.int16)
        slot[top] = np.arange(common)
        shares = np.append(cells[top], cells.sum() - cells[top].sum()) / cells.sum()
        out.append((r.lang, classes / classes.sum(), slot, shares))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q."""
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)
    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def distances(b: dict, refs: list, common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest language, its class distance and its word distance, for each text."""
    classes = class_counts(b).astype(float)
    classes /= np.maximum(classes.sum(1, keepdims=True), 1)
    cs, ws = [], []
    for _, shares, slot, words in refs:
        n = np.bincount(b["doc"] * (common + 1) + slot[b["cell"]], minlength=b["n"] * (common + 1)).reshape(b["n"], common + 1).astype(float)
        n /= np.maximum(n.sum(1, keepdims=True), 1)
        cs.append(js_distance(classes, shares)), ws.append(js_distance(n, words))
    cs, ws = np.stack(cs), np.stack(ws)
    best = (cs + ws).argmin(0)
    at = np.arange(b["n"])
    return best, cs[best, at], ws[best, at]


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "language string, class_distance double, word_distance double"
)


def divergence_rules(docs: DataFrame, common: int = 64, most_class: float = 0.3, most_word: float = 0.45, least_chars: int = 200, least_words: int = 60, least_reference: int = 1000) -> DataFrame:
    """SCHEMA's columns, one row per document; the two distances are null where a guard holds or no reference is."""
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, common, least_reference))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            b = block(part)
            base = base_counts(b)
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            if refs.value:
                best, c, w = distances(b, refs.value, common)
                c = np.where(base["word_chars"] >= least_chars, c, np.nan)
                w = np.where(base["n_words"] >= least_words, w, np.nan)
                names = pa.array([refs.value[i][0] for i in best])
            else:
                c = w = np.full(b["n"], np.nan)
                names = pa.nulls(b["n"], pa.string())
            kept = ~failed & ~(c > most_class) & ~(w > most_word)
            cols = [part.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in base.values()], pa.array(failed), pa.array(kept), names, pa.array(c, from_pandas=True), pa.array(w, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
