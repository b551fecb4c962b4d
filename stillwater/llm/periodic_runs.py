"""Periodic runs of words, by recompression.

The words of a batch of texts are numbered exactly and compressed in turns: blocks (equal neighbours become one symbol, named
by letter and length) and pairs (letters are dealt to a left and a right half by a hash, a left letter followed by a right one
becomes one symbol), until each text is one symbol: a run-length grammar of logarithmic height, all levels kept as arrays. As
both steps look at neighbours alone, equal stretches are parsed alike but for their edges. The longest common extension of
two places therefore climbs while symbols agree, one step to the side a level at most, and descends once they differ; many
queries go through the levels together, in both directions.

A run of period p and length max(least, times * p) or more holds two places p apart on the grid of step max(least, times * p) - p.
So for every p the places of its grid whose words agree are extended exactly, n log n places in all (a harmonic sum); what is
as long as asked and has no smaller period is a run. The same stretch found with a multiple of its period is dropped.

`periodic_runs` gives runs (start, length, period in words, by start and period) and collapsed, the words outside repeats,
joined by one space: a word goes if a run holds it after the run's first period. One pass, no shuffle; a text takes some 250
bytes a word in its task.

Cases: a null or empty text has no runs and collapses to the empty text, as does one of blanks alone; repeated rows get equal
results; no rows give no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stillwater.llm import textblocks as tb
from stillwater.llm.common import spare

LEAST, TIMES = 24, 3
CHUNK = 1 << 21  # places of the grid looked at together
RUNS = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Grammar:
    """Levels of a string of numbers; numbers from `ends` on part the texts, each of them occurs once and at both edges."""

    def __init__(self, letters: np.ndarray, ends: int):
        self.sym, self.child, self.parent, self.block = [letters.astype(np.int64)], [], [], []
        self.ends, self.names, self.turn = ends, int(letters.max(initial=0)) + 1, 0
        self.limit = self.names
        while self.more():
            self.blocks()
            self.pairs()

    def more(self) -> bool:
        inner = self.inner(self.sym[-1])
        return bool(np.any(inner[1:] & inner[:-1]))

    def inner(self, s: np.ndarray) -> np.ndarray:
        return (s < self.ends) | (s >= self.limit)

    def level(self, heads: np.ndarray, names: np.ndarray, block: bool) -> None:
        """heads: the first symbol of every new one."""
        m = len(self.sym[-1])
        parent = np.zeros(m, np.int32)
        parent[heads[1:]] = 1
        self.child.append(np.append(heads, m).astype(np.int32))
        self.parent.append(np.cumsum(parent, dtype=np.int32))
        self.sym.append(names)
        self.block.append(block)

    def named(self, keys: np.ndarray) -> np.ndarray:
        found, number = np.unique(keys, return_inverse=True)
        number += self.names
        self.names += len(found)
        return number

    def blocks(self) -> None:
        s = self.sym[-1]
        heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(heads) == len(s):
            return
        size, names = np.diff(np.append(heads, len(s))), s[heads].copy()
        some = size > 1
        names[some] = self.named(names[some] * len(s) + size[some])  # sizes are at most len(s) - 2, as both edges are single
        self.level(heads, names, True)

    def pairs(self) -> None:
        s = self.sym[-1]
        self.turn += 1
        inner = self.inner(s)
        left = (tb.mix(s.astype(tb.U) * tb.MULTS[self.turn % 15] + tb.U(self.turn)) & tb.U(1)).astype(bool)
        one, two = (inner[:-1] & inner[1:] & x[:-1] & ~x[1:] for x in (left, ~left))
        pair = one if one.sum() >= two.sum() else two
        if not pair.any():
            return
        heads, first = np.flatnonzero(np.append(True, ~pair)), np.flatnonzero(pair)
        names = s[heads].copy()
        names[np.append(pair, False)[heads]] = self.named(s[first] * self.names + s[first + 1])
        self.level(heads, names, False)

    def extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """How many words agree from i and j on (way 1) or before them (way -1); i and j differ."""
        pi, pj = (i.astype(np.int64), j.astype(np.int64)) if way > 0 else (i.astype(np.int64) - 1, j.astype(np.int64) - 1)
        live, met = np.arange(len(i)), []
        for h, s in enumerate(self.sym):
            differ = s[pi[live]] != s[pj[live]]
            met.append(live[differ])
            live = live[~differ]
            if not len(live):
                break
            child, parent = self.child[h], self.parent[h]
            a, b = pi[live], pj[live]
            pa_, pb = parent[a], parent[b]
            if way > 0:
                gone_a, gone_b, rest_a, rest_b = a - child[pa_], b - child[pb], child[pa_ + 1] - a, child[pb + 1] - b
            else:
                gone_a, gone_b, rest_a, rest_b = child[pa_ + 1] - 1 - a, child[pb + 1] - 1 - b, a - child[pa_] + 1, b - child[pb] + 1
            aside = (gone_a > 0) | (gone_b > 0)
            if self.block[h]:
                step, stuck = np.where(aside, np.minimum(rest_a, rest_b), 0), aside & (rest_a != rest_b)
            else:
                step, stuck = aside.astype(np.int64), np.zeros(len(live), bool)
            pi[live], pj[live] = a + way * step, b + way * step
            met[-1] = np.concatenate([met[-1], live[stuck]])
            live = live[~stuck]
            pi[live], pj[live] = parent[pi[live]], parent[pj[live]]
        down = np.zeros(0, np.int64)
        for h in range(len(met) - 1, 0, -1):
            down = np.concatenate([down, met[h]])
            child, s = self.child[h - 1], self.sym[h - 1]
            ca, cb = pi[down], pj[down]
            a, b = (child[ca].astype(np.int64), child[cb].astype(np.int64)) if way > 0 else (child[ca + 1].astype(np.int64) - 1, child[cb + 1].astype(np.int64) - 1)
            step = np.where(s[a] == s[b], np.minimum(child[ca + 1] - child[ca], child[cb + 1] - child[cb]) if self.block[h - 1] else 1, 0)
            pi[down], pj[down] = a + way * step, b + way * step
        return pi - i if way > 0 else i - 1 - pi


def grid(sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period and place (in the text) of all places of the grids."""
    doc = np.repeat(np.arange(len(sizes)), sizes // times)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(sizes // times) - sizes // times, sizes // times) + 1
    step = np.maximum(least, times * period) - period
    count = -(-(sizes[doc] - period) // step)
    upto = np.cumsum(count)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, side="right")))
        n = count[at:to]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(doc[at:to], n), np.repeat(period[at:to], n), k * np.repeat(step[at:to], n)
        at = to


def runs_of(letters: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, period, length) of all runs of texts that lie one after the other, sorted; letters count from 0."""
    first = np.cumsum(sizes) - sizes + np.arange(1, len(sizes) + 1)
    ends = int(letters.max(initial=-1)) + 1
    whole = np.full(len(letters) + len(sizes) + 1, -1, np.int64)
    edges = np.append(first - 1, len(whole) - 1)
    whole[edges] = ends + np.arange(len(edges))
    whole[whole < 0] = letters
    grammar, found = None, [np.zeros((0, 4), np.int64)]
    for doc, period, place in grid(sizes, least, times):
        i = first[doc] + place
        same = whole[i] == whole[i + period]
        doc, period, i = doc[same], period[same], i[same]
        if not len(i):
            continue
        grammar = grammar or Grammar(whole, ends)
        back, ahead = grammar.extend(i, i + period, -1), grammar.extend(i, i + period, 1)
        length = back + ahead + period
        ok = length >= np.maximum(least, times * period)
        found.append(np.unique(np.stack([doc[ok], (i - back - first[doc])[ok], length[ok], period[ok]], 1), axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    fresh = np.append(True, np.any(rows[1:, :3] != rows[:-1, :3], axis=1))[: len(rows)]  # the smallest period of a stretch
    rows = rows[fresh][:, [0, 1, 3, 2]]
    return rows[np.lexsort(rows[:, ::-1].T[1:])]


def collapse(part: pa.Array, least: int, times: int) -> tuple[np.ndarray, list[bytes]]:
    """Runs of the texts, and their words outside repeats."""
    data, offs = tb.buffers(part)
    starts, ends, doc = tb.tokens(data, offs)
    sizes = np.bincount(doc, minlength=len(part))
    size = ends - starts
    text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[tb.IS_WORD[data]])))
    letters = np.asarray(text.dictionary_encode().indices).astype(np.int64)
    long = np.flatnonzero(sizes >= least)
    rows = runs_of(letters[(sizes >= least)[doc]], sizes[long], least, times)
    rows[:, 0] = long[rows[:, 0]]
    first = np.cumsum(sizes) - sizes
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, first[rows[:, 0]] + rows[:, 1] + rows[:, 2], 1)
    np.add.at(edge, first[rows[:, 0]] + rows[:, 1] + rows[:, 3], -1)
    kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    # Kept words, each with a blank behind it but for a text's last.
    n, of = size[kept] + 1, doc[kept]
    ahead = np.cumsum(n) - n
    pos = np.repeat(starts[kept] - ahead, n) + np.arange(int(n.sum()))
    out = np.where(pos < np.repeat(ends[kept], n), np.append(data, 32)[np.minimum(pos, len(data))], 32).astype(np.uint8).tobytes()
    cuts = np.append(ahead, len(out))[np.searchsorted(of, np.arange(len(part) + 1))]
    return rows, [out[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def periodic_runs(docs: DataFrame, keep: list[str] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns `keep` of every row of docs (all, if not given) with runs and collapsed."""
    if least < 2 or times < 2:
        raise ValueError("least and times are 2 or more")
    keep = docs.columns if keep is None else keep
    names = spare(docs.select(*keep), "runs", "collapsed")
    (text,) = spare(docs, "_text")
    schema = docs.select(*keep).schema
    for name, field in zip(names, StructType.fromDDL(RUNS), strict=True):
        schema = schema.add(name, field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, text):
            rows, texts = collapse(part.column(text), least, times)
            bounds = np.searchsorted(rows[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 3, 2)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(bounds, each), pa.array(texts, pa.binary()).cast(pa.string())], [*keep, *names])

    return docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, schema)
