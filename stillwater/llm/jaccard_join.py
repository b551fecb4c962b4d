"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their components.

Texts link when |A & B| / |A | B| >= num/den. Every set is ordered rare-first by one
global order (document frequency of a shingle's hash cell, then hash). Prefixes have
n - ceil(t n) + l keys with l = ceil(n / 20), and so two alike sets share the lesser l
of such keys at least, not only one.

1. Owners of key ranges count the sets of each prefix key; a set that shares fewer keys
   than a partner would need takes no further part, which leaves out texts that have no
   more than a passage in common. A key of more than `list_sets` sets is split over
   several owners by a hash of the set.
2. The others are dealt to blocks of about `block` sets by the most shared of their keys.
   A block joins its prefixes in one task: what passes the length, positional and suffix
   filters is intersected, once per pair, unless the two are in one component by then.
   A few representatives of the block's components go on to meet those of the next
   `FAN` blocks of the same key, and so on. So a group of many near copies is one
   component after as many set comparisons as it has members, not as it has pairs.
3. Sets of a large component are dealt to blocks of its own. Owners then see only
   (key, block, component) and name each pair of blocks that share keys between
   different components, as many keys at least as a link needs. Those pairs of blocks
   are joined as in 2, so no link between components is lost.

Equal sets are one node from the start and are told apart from chance by a second digest.
In 2 and 3 shingles are compared by 56 bits of hash, in sets of one pair only.

Cases: A-Z become a-z; fewer words than k are one shingle of the whole sequence; a null
or empty text, or one of blanks, has no shingle and is its own component; repeated rows
are in one component; a null doc_id never names a component unless all its rows are
null; no rows give no rows. Only `doc_id` (an integer) and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.llm import textblocks as tb
from stillwater.llm.common import WORD, join_hot, stay, tree_sum, written
from stillwater.llm.payload import opened, pressed, rising

CELL_BITS, CHUNK = 24, 1 << 18
FAN, REPRESENTATIVES = 32, 4


def shingle_sets(part: pa.RecordBatch, k: int, seed: int = 0) -> list[np.ndarray]:
    """The distinct shingle hashes of each text."""
    data, offs = tb.buffers(part.column("text"))
    starts, ends, doc = tb.tokens(data, offs)
    words = tb.span_hashes(data, starts, ends, tb.FOLD) + tb.U(seed)
    at = tb.groups(doc, part.num_rows)
    h, first = tb.windows(words, doc, k)
    cut = np.searchsorted(first, at)
    out = []
    for i in range(part.num_rows):
        n = at[i + 1] - at[i]
        if 0 < n < k:
            w = words[at[i] : at[i + 1]]
            out.append(tb.mix((w * tb.MULTS[: len(w)]).sum(keepdims=True) + np.array([len(w)], tb.U) * tb.MULTS[9]))
        else:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two digests of a set, free of order."""
    d = np.array([tb.mix(s).sum(), tb.mix(s * tb.MULTS[5]).sum()], tb.U)
    return tuple(int(x) for x in tb.mix(d + tb.U(len(s))).view(np.int64))


def fewest(n):
    """How many prefix keys alike sets share, the lesser of the two counting."""
    return -(-n // 20)


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + fewest(n)


def prefix_length_column(n: Column, num: int, den: int) -> Column:
    return n - F.ceil(n * num / F.lit(den)) + F.ceil(n / 20)


def least_shared(n: Column, num: int, den: int) -> Column:
    """What a set of n shingles shares with its smallest possible partner."""
    return F.ceil(F.ceil(n * num / F.lit(den)) / 20)


# The global order ------------------------------------------------------

DOCS = "doc_id long, sig long, n long, node long, other long, chunk int, part int, cells binary"


def describe(k: int, seed: int):
    """Each document's set size and digests; at the end of a task its counts of hash cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        names = [f.split()[0] for f in DOCS.split(", ")]
        for part in tb.slices(batches):
            sets = shingle_sets(part, k, seed)
            both = np.concatenate([*sets, np.zeros(0, tb.U)])
            at, count = np.unique(cell_of(both), return_counts=True)
            cells[at] += count.astype(np.uint32)
            ds = [digest(s) for s in sets]
            sizes, nodes, others = (pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [d[0] for d in ds], [d[1] for d in ds]))
            none = [pa.nulls(len(ds), pa.int32()), pa.nulls(len(ds), pa.int32()), pa.nulls(len(ds), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sig"), sizes, nodes, others, *none], names=names)
        m = len(cells) // CHUNK
        if cells.any():
            blobs = [pressed(cells[i * CHUNK : (i + 1) * CHUNK]) for i in range(m)]
            own = pa.array([TaskContext.get().partitionId()] * m, pa.int32())
            yield pa.RecordBatch.from_arrays([*[pa.nulls(m, pa.int64())] * 5, pa.array(range(m), pa.int32()), own, pa.array(blobs, pa.binary())], names=names)

    return run


def cell_of(s: np.ndarray) -> np.ndarray:
    return (s & tb.U((1 << CELL_BITS) - 1)).astype(np.int64)


CELLS = "chunk int, part int, cells binary"


def add_cells(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.uint32)
    for blob in table.column("cells").to_pylist():
        total += opened(blob, np.uint32)[0]
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": table.column("part").slice(0, 1), "cells": pa.array([pressed(total)], pa.binary())})


def cell_ranks(counts: DataFrame) -> np.ndarray:
    """A rank for each of 2^CELL_BITS cells, 16 MB whatever the corpus: 0 (rarest) to 255, an eighth of a doubling each."""
    ranks = np.zeros(1 << CELL_BITS, np.uint8)
    for r in tree_sum(counts.select("chunk", "part", "cells"), "chunk", add_cells, CELLS).collect():
        total = opened(r.cells, np.uint32)[0]
        ranks[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.minimum(np.round(np.log2(np.maximum(total, 1)) * 8), 255)
    return ranks


def ordered(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A set as keys whose plain order is the global rare-first order: eight bits of rank, then the hash."""
    return np.sort((ranks[cell_of(s)].astype(tb.U) << tb.U(56)) | (s >> tb.U(8)))


def splits_of(keys: np.ndarray, list_sets: int) -> np.ndarray:
    """Over how many owners the sets of a key are dealt, from the frequency that its rank tells."""
    return (np.exp2((keys >> tb.U(56)).astype(float) / 8) // list_sets + 1).astype(tb.U)


def owner_of(keys: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's owner, and 32 bits that stand for it there; two keys of an owner with one number only cost comparisons."""
    h = tb.mix(keys)
    return ((h >> tb.U(32)) * tb.U(owners) >> tb.U(32)).astype(np.int64), h.astype(np.uint32)


def by_owner(owner: np.ndarray, number: np.ndarray, who: np.ndarray, about: tuple, beside: tuple = ()) -> pa.RecordBatch:
    """One payload an owner: sorted numbers, the place of each in `about`, those rows of `about` that it needs, and what
    lies `beside` each number."""
    order = np.lexsort((number, owner))
    number, who, owner, beside = number[order], who[order], owner[order], [x[order] for x in beside]
    kinds, at = np.unique(owner, return_index=True)
    out = []
    for a, b in zip(at, [*at[1:], len(owner)], strict=True):
        used, local = np.unique(who[a:b], return_inverse=True)
        out.append(pressed(rising(number[a:b]), local.astype(np.int32), *[x[used] for x in about], *[x[a:b] for x in beside]))
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(out, pa.binary())], names=["owner", "payload"])


def gathered(table: pa.Table, n_about: int, *beside: type) -> list[np.ndarray]:
    """An owner's numbers and, in the same order, the columns of `about` and of `beside`."""
    got = [opened(b, np.uint32, np.int32, *[np.int64] * n_about, *beside) for b in table.column("payload").to_pylist()]
    numbers = np.concatenate([np.cumsum(g[0], dtype=np.uint32) for g in got])
    return [numbers, *[np.concatenate([g[2 + i][g[1]] for g in got]) for i in range(n_about)], *[np.concatenate([g[2 + n_about + i] for g in got]) for i in range(len(beside))]]


# 1: which sets share keys ----------------------------------------------


def send_prefixes(k: int, seed: int, ranks, owners: int, num: int, den: int, list_sets: int, most: int = 2_000_000):
    def flush(rows: list) -> pa.RecordBatch:
        nodes, keys = np.array([r[0] for r in rows], np.int64), np.concatenate([r[1] for r in rows])
        who = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) for r in rows])
        splits = splits_of(keys, list_sets)
        home, number = owner_of(keys, owners)
        # The first part of a key's sets stays with the key's own owner, the others go to owners beside it.
        owner = (home + (tb.mix(nodes.view(tb.U))[who] % splits).astype(np.int64)) % owners
        return by_owner(owner, number, who, (nodes,), (home, splits.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, seen = [], 0, set()
        for part in tb.slices(batches):
            for s in shingle_sets(part, k, seed):
                node = digest(s)[0] if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                keys = ordered(s, ranks.value)[: prefix_length(len(s), num, den)]
                rows.append((node, keys))
                held += len(keys)
                if held >= most:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    return run


def shared_keys():
    """node, size and key of each node's most shared key at an owner, and in how many shared keys it is."""

    def run(table: pa.Table) -> pa.Table:
        number, node, home, splits = gathered(table, 1, np.int64, np.int32)
        keys = (home.astype(tb.U) << tb.U(32)) | number
        # One entry per key and node: equal texts of several tasks come several times.
        order = np.lexsort((node, keys))
        keys, node, splits = keys[order], node[order], splits[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (node[1:] != node[:-1]))[: len(keys)]
        keys, node, splits = keys[new], node[new], splits[new]
        _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
        keep = (count[place] > 1) | (splits > 1)  # the others of a split key may be elsewhere
        keys, node, size = keys[keep], node[keep], (count[place] * splits)[keep]
        order = np.lexsort((keys, -size, node))
        at = np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1])[: len(order)])
        first, held = order[at], np.diff(np.append(at, len(order)))
        return pa.table({"node": node[first], "size": size[first], "key": keys[first].view(np.int64), "held": held})

    return run


def bitmap_of(rows: DataFrame, column: str, n: int) -> tuple:
    """A bitmap with the bits of a column of hashes set, broadcast, and its number of bits: about 16 a row, 32 MB at most;
    a fuller one lets more rows through."""
    bits = min(max(1 << (n * 16).bit_length(), 1 << 15), 1 << 28)
    at = F.pmod(F.col(column), F.lit(bits)) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out), bits


def in_bitmap(batch: pa.RecordBatch, column: str, bitmap, bits: int) -> pa.RecordBatch:
    at = batch.column(column).to_numpy() % bits
    return batch.filter(pa.array((bitmap.value[at >> 3] >> (at & 7) & 1).astype(bool)))


def filtered(column: str, bitmap, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield in_bitmap(batch, column, bitmap, bits)

    return run


def sets_of(k: int, seed: int, ranks, bitmap, bits: int):
    """node, keys of the rows that are in the bitmap (a few others may come too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in tb.slices(iter([in_bitmap(batch, "row", bitmap, bits)])):
                rows = []
                for s in shingle_sets(part, k, seed):
                    if len(s) and (node := digest(s)[0]) not in seen:
                        seen.add(node)
                        rows.append((node, ordered(s, ranks.value).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "keys"])

    return run


# Links of the sets of one task -----------------------------------------


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """A lower bound of the size of the symmetric difference of two sorted sets."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    mid = y[len(y) // 2]
    i = int(np.searchsorted(x, mid))
    hit = i < len(x) and x[i] == mid
    return suffix_bound(x[:i], y[: len(y) // 2], depth - 1) + suffix_bound(x[i + hit :], y[len(y) // 2 + 1 :], depth - 1) + (not hit)


def alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    need = -(-num * (len(x) + len(y)) // (num + den))
    if suffix_bound(x, y) > len(x) + len(y) - 2 * need:
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = int((y[at] == x).sum())
    return den * same >= num * (len(x) + len(y) - same)


def prefix_candidates(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which (left, right) pairs share enough prefix keys and pass the length filter, and the positional filter at every
    key they share; and how many keys they share."""
    n = np.array([len(s) for s in sets], np.int64)
    p = prefix_length(n, num, den)
    keys = np.concatenate([s[:k] for s, k in zip(sets, p, strict=True)])
    who, pos = np.repeat(np.arange(len(sets)), p), np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
    order = np.argsort(keys, kind="stable")
    keys, who, pos = keys[order], who[order], pos[order]
    at = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    row, col = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    share, wrong = np.zeros((len(left), len(right)), np.int32), np.zeros((len(left), len(right)), bool)
    need = -(-num * (n[left][:, None] + n[right][None]) // (num + den))
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a < 2:
            continue
        w, q = who[a:b], pos[a:b]
        x, y = row[w] >= 0, col[w] >= 0
        if not x.any() or not y.any():
            continue
        ix = np.ix_(row[w[x]], col[w[y]])
        most = np.minimum(q[x][:, None], q[y][None]) + np.minimum((n[w[x]] - q[x])[:, None], (n[w[y]] - q[y])[None])
        share[ix] += 1
        wrong[ix] |= most < need[ix]
    length = den * np.minimum(n[left][:, None], n[right][None]) >= num * np.maximum(n[left][:, None], n[right][None])
    return (share >= fewest(np.minimum(n[left][:, None], n[right][None]))) & ~wrong & length, share


def sets_in(table: pa.Table, *more: str) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """The sets of a group of rows, one for each node, their nodes, and further columns."""
    node, at = np.unique(table.column("node").to_numpy(), return_index=True)
    blobs = table.column("keys").to_pylist()
    return [np.frombuffer(blobs[i], tb.U) for i in at], node, [table.column(c).to_numpy()[at] for c in more]


class Forest:
    """Who is joined with whom in one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[j] = i
        return i != j


LEVEL = "node long, local long, rep boolean, key long, part long, parts long, keys binary"


def within(num: int, den: int, lonely: bool):
    """The components inside one block: node and the representative of its component.

    A representative is the member that shares most keys with others; those of the largest components are marked to go
    on, with their sets, while the key has further blocks. lonely: components of one member go on too.
    """

    def run(table: pa.Table) -> pa.Table:
        sets, node, (key, part, parts) = sets_in(table, "key", "part", "parts")
        everyone = np.arange(len(node))
        hit, share = prefix_candidates(sets, everyone, everyone, num, den)
        forest = Forest(len(node))
        for i, j in np.argwhere(np.triu(hit, 1)):
            if forest.find(i) != forest.find(j) and alike(sets[i], sets[j], num, den):
                forest.join(i, j)
        root = np.array([forest.find(i) for i in everyone])
        weight = share.sum(1)
        local, members = np.zeros(len(node), np.int64), {}
        for r in np.unique(root):
            mine = np.flatnonzero(root == r)
            best = int(mine[np.argmax(weight[mine])])
            local[mine], members[best] = best, len(mine)
        go = [i for i in sorted(members, key=lambda i: (-members[i], i)) if parts[i] > 1 and (lonely or members[i] > 1)][:REPRESENTATIVES]
        rep = np.isin(everyone, go)
        held = [sets[i].tobytes() if rep[i] else None for i in everyone]
        return pa.table({"node": node, "local": node[local], "rep": rep, "key": key, "part": part, "parts": parts, "keys": pa.array(held, pa.binary())})

    return run


def between(num: int, den: int):
    """The links of one pair of blocks between sets of different components, as a forest of components."""

    def run(table: pa.Table) -> pa.Table:
        ba, bb = table.column("ba")[0].as_py(), table.column("bb")[0].as_py()
        sets, _, (block, root) = sets_in(table, "block", "root")
        kinds, of = np.unique(root, return_inverse=True)
        left, right = np.flatnonzero(block == ba), np.flatnonzero(block == bb)
        forest, out = Forest(len(kinds)), []
        for i, j in np.argwhere(prefix_candidates(sets, left, right, num, den)[0]):
            x, y = int(left[i]), int(right[j])
            if forest.find(of[x]) != forest.find(of[y]) and alike(sets[x], sets[y], num, den):
                forest.join(of[x], of[y])
                out.append((root[x], root[y]))
        links = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"u": links[:, 0], "v": links[:, 1]})

    return run


# 3: pairs of blocks ------------------------------------------------------


def send_blocks(owners: int, most: int = 1_000_000):
    """(key, block, component) of the prefixes of a batch, each once, by owner."""

    def flush(keys: list, block: list, root: list) -> pa.RecordBatch:
        who = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        kinds, of = np.unique(np.stack([np.array(block, np.int64), np.array(root, np.int64)], 1), axis=0, return_inverse=True)
        key, who = np.concatenate(keys), of.ravel()[who].astype(np.int32)
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        new = np.append(True, (key[1:] != key[:-1]) | (who[1:] != who[:-1]))[: len(key)]
        return by_owner(*owner_of(key[new], owners), who[new], (np.ascontiguousarray(kinds[:, 0]), np.ascontiguousarray(kinds[:, 1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, block, root, held = [], [], [], 0
        for batch in batches:
            for blob, b, r in zip(batch.column("prefix").to_pylist(), batch.column("block").to_pylist(), batch.column("root").to_pylist(), strict=True):
                keys.append(np.frombuffer(blob, tb.U)), block.append(b), root.append(r)
                held += len(keys[-1])
                if held >= most:
                    yield flush(keys, block, root)
                    keys, block, root, held = [], [], [], 0
        if keys:
            yield flush(keys, block, root)

    return run


PAIRS = "ba long, bb long, shared long"


def block_pairs(table: pa.Table) -> pa.Table:
    """Pairs of blocks in which a key of the owner has sets of different components, and how many such keys."""
    keys, block, root = gathered(table, 2)
    order = np.lexsort((root, block, keys))
    keys, block, root = keys[order], block[order], root[order]
    # One entry per key and block; its component, or -1 for several.
    new = np.append(True, (keys[1:] != keys[:-1]) | (block[1:] != block[:-1]))[: len(keys)]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(keys))[: len(at)] - 1
    keys, block, kind = keys[at], block[at], np.where(root[at] == root[last], root[at], -1)
    order = np.lexsort((kind, keys))
    keys, block, kind = keys[order], block[order], kind[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(keys))[: len(at)]
    some = (end - at > 1) & ((kind[at] != kind[end - 1]) | (kind[at] == -1))
    found, held, counts = [], 0, {}

    def count() -> None:
        if found:
            pairs, n = np.unique(np.sort(np.concatenate(found), axis=1), axis=0, return_counts=True)
            for (a, b), m in zip(pairs.tolist(), n.tolist(), strict=True):
                counts[a, b] = counts.get((a, b), 0) + m

    for a, b in zip(at[some], end[some], strict=True):
        # A run of one component has no pairs in itself; a block of several is a run of its own.
        run_end = np.where(kind[a:b] == -1, np.arange(a, b) + 1, a + np.searchsorted(kind[a:b], kind[a:b], side="right"))
        for i in range(a, b):
            if (m := b - run_end[i - a]) > 0:
                found.append(np.stack([np.full(m, block[i]), block[run_end[i - a] : b]], 1))
                held += m
        if held > 2_000_000:
            count()
            found, held = [], 0
    count()
    return pa.table({"ba": pa.array([p[0] for p in counts], pa.int64()), "bb": pa.array([p[1] for p in counts], pa.int64()), "shared": pa.array(list(counts.values()), pa.int64())})


def connected(edges: DataFrame) -> DataFrame:
    """name, root of all ends of the edges u, v. In each round a root hooks to its first neighbour in a new random
    order and jumps along two hooks, until no edge is left between roots."""
    live = written(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "edges")
    top, turn = live.select(F.col("u").alias("name"), F.col("u").alias("root")).distinct(), 0
    while not live.isEmpty():
        place = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("p"))
        hook = live.groupBy("u").agg(F.min(place("v")).alias("v")).select("u", F.least("v", place("u"))["p"].alias("p"))
        jump = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
        hook = written(hook.join(jump, "p").select("u", F.col("q").alias("p")), "hooks")
        top = written(top.join(hook.withColumnRenamed("u", "root"), "root", "left").select("name", F.coalesce("p", "root").alias("root")), "roots")
        live = live.join(hook, "u").select(F.col("p").alias("u"), "v").join(hook.select(F.col("u").alias("v"), F.col("p").alias("w")), "v").select("u", F.col("w").alias("v"))
        live = written(live.where("u <> v").distinct(), "edges")
        turn += 1
    return top


def rooted(names: DataFrame, top: DataFrame) -> DataFrame:
    """names with `root` moved on by the roots of top."""
    top = top.select(F.col("name").alias("root"), F.col("root").alias("_next"))
    return names.join(top, "root", "left").withColumn("root", F.coalesce("_next", "root")).drop("_next")


def document_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), "text")


def joined(docs: DataFrame, k: int = 5, num: int = 3, den: int = 4, owner_keys: int = 1_500_000, block: int = 128, list_sets: int = 1_000_000) -> DataFrame:
    """doc_id, sig, n, component (struct of doc_id and sig: the row that names it; null without shingles): one row per row of docs.

    owner_keys: prefix keys that one owner task holds; block: sets in a block, about; list_sets: sets of one key that one owner counts.
    """
    spark = docs.sparkSession
    texts = document_rows(docs)
    for seed in range(8):
        seen = written(texts.mapInArrow(describe(k, seed), DOCS), "sets")
        each = seen.where("n IS NOT NULL").select("doc_id", "sig", "n", "node", "other")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig"))
        nodes = each.where("n > 0").groupBy("node").agg(first.alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), (F.min("other") != F.max("other")).alias("clash"))
        nodes = written(nodes, "nodes")
        stats = nodes.agg(F.sum(prefix_length_column(F.col("n"), num, den)).alias("keys"), F.max("clash").alias("clash"), F.sum("copies").alias("rows")).first()
        if not stats.clash:
            break
    else:
        raise ValueError("eight hash seeds in a row gave two sets one digest")
    ranks = spark.sparkContext.broadcast(cell_ranks(seen.where("chunk IS NOT NULL")))
    owners = -(-int(stats.keys or 0) // owner_keys) or 1

    sent = texts.select("text").mapInArrow(send_prefixes(k, seed, ranks, owners, num, den, list_sets), "owner long, payload binary")
    held = sent.groupBy("owner").applyInArrow(shared_keys(), "node long, size long, key long, held long")
    best = held.groupBy("node").agg(F.max(F.struct("size", "key")).alias("m"), F.sum("held").alias("held")).join(nodes.select("node", "n", "first"), "node")
    best = best.where(F.col("held") >= least_shared(F.col("n"), num, den))
    parts = F.ceil(F.col("m.size") / F.lit(block))
    best = best.select("node", "n", F.xxhash64("first.doc_id", "first.sig").alias("row"), F.col("m.key").alias("key"), parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("part"))
    best = written(best.withColumn("block", F.xxhash64("key", "part")), "blocks")

    active = best.agg(F.count(F.lit(1)), F.max("parts"), F.sum(prefix_length_column(F.col("n"), num, den))).first()
    bitmap, bits = bitmap_of(best, "row", int(active[0]))
    rows = texts.select(F.xxhash64("doc_id", "sig").alias("row"), "text")
    # Sets are large and nodes have no bound, so these joins shuffle at every size.
    found = rows.mapInArrow(sets_of(k, seed, ranks, bitmap, bits), "node long, keys binary")
    found = found.join(best.select("node", "block", "key", "part", "parts", "n").hint("merge"), "node")
    found = written(found, "keys")

    level = written(found.select("block", "node", "key", "part", "parts", "keys").groupBy("block").applyInArrow(within(num, den, False), LEVEL), "level")
    local = level.select("node", "local")
    edges, most = [], int(active[1] or 1)
    while most > 1:
        most = -(-most // FAN)
        level = level.where("rep").select("node", "key", F.floor(F.col("part") / FAN).alias("part"), F.ceil(F.col("parts") / FAN).alias("parts"), "keys")
        level = written(level.groupBy("key", "part").applyInArrow(within(num, den, True), LEVEL), "level")
        edges.append(level.select(F.col("node").alias("u"), F.col("local").alias("v")).where("u <> v"))
    # Names of components are few: one for each block at most of a group, and a name has one block's members.
    names = local.groupBy("local").count().withColumn("root", F.col("local"))
    for more in edges[:1]:
        for e in edges[1:]:
            more = more.union(e)
        names = rooted(names, connected(more))
    names = written(names.join(names.groupBy("root").agg(F.sum("count").alias("members")), "root").select("local", "root", "members"), "names")

    dealt = local.join(names, "local").join(best.select("node", "n", F.col("block").alias("mixed")), "node")
    own = F.xxhash64("root", F.lit("own"), F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / F.lit(block))))
    dealt = written(dealt.select("node", "n", "root", F.when(F.col("members") * 2 > block, own).otherwise(F.col("mixed")).alias("block")), "dealt")
    prefix = found.select("node", F.substring("keys", F.lit(1), (8 * prefix_length_column(F.col("n"), num, den)).cast("int")).alias("prefix"))
    owners = -(-int(active[2] or 0) // owner_keys) or 1
    sent = prefix.join(dealt.drop("n").hint("merge"), "node").select("prefix", "block", "root").mapInArrow(send_blocks(owners), "owner long, payload binary")
    pairs = sent.groupBy("owner").applyInArrow(block_pairs, PAIRS).groupBy("ba", "bb").agg(F.sum("shared").alias("shared"))
    ends = dealt.groupBy("block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    for side in "ab":
        pairs = pairs.join(ends.select(F.col("block").alias(f"b{side}"), F.col("lo").alias(f"lo{side}"), F.col("hi").alias(f"hi{side}")), f"b{side}")
    enough = F.col("shared") >= least_shared(F.greatest("loa", "lob"), num, den)
    pairs = written(pairs.where(enough & (F.col("hia") * den >= F.col("lob") * num) & (F.col("hib") * den >= F.col("loa") * num)).select("ba", "bb"), "pairs")
    need = pairs.select("ba", "bb", F.explode(F.array("ba", "bb")).alias("block"))
    used = written(dealt.join(need.select("block").distinct(), "block").select("node", "block", "root"), "used")
    bitmap, bits = bitmap_of(used, "node", used.count())
    used = found.select("node", "keys").mapInArrow(filtered("node", bitmap, bits), "node long, keys binary").join(used.hint("merge"), "node")
    links = need.join(used.hint("merge"), "block").groupBy("ba", "bb").applyInArrow(between(num, den), "u long, v long")
    names = rooted(names.select("local", "root"), connected(links))

    named = nodes.select("node", "first").join(local, "node").groupBy("local").agg(F.min("first").alias("first")).join(names, "local")
    named = named.select("local", "root").join(named.groupBy("root").agg(F.min("first").alias("first")), "root").select("local", "first")
    named = local.join(named, "local").select("node", F.col("first").alias("joined"))
    named = written(nodes.join(named, "node", "left").select("node", "copies", F.coalesce("joined", "first").alias("component")), "components")
    hot = named.where(F.col("copies") * 1000 >= int(stats.rows or 0))  # a thousand at most
    out = join_hot(each.where("n > 0").drop("other"), named.drop("copies"), hot, ["node"]).select("doc_id", "sig", "n", "component")
    return out.unionByName(each.where("n = 0").select("doc_id", "sig", "n", F.lit(None).cast(out.schema["component"].dataType).alias("component")))


def components(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    return joined(docs, **kw).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component.doc_id", "doc_id").alias("component_id"))


def keep_one_each(docs: DataFrame, **kw) -> DataFrame:
    """docs with one row of each component, of least doc_id (then of least text hash; one of repeated rows); texts without a word all stay."""
    rows = written(joined(docs, **kw), "joined")
    is_first = F.col("n") > 0
    keys = rows.where(is_first & F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("sig") == F.col("component.sig")))
    keys = keys.groupBy("doc_id", "sig").agg(F.count(F.lit(1)).alias("times"))
    none = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    return stay(docs, keys, F.xxhash64("text")).unionByName(docs.where(none))
