"""Best-fit packing of documents into bins of `capacity` words, with conflicts.

A bin never holds two documents of one source or of one duplicate cluster. Documents
are dealt to shards of about `shard_docs` by a hash of the row, so a source or cluster
of any share is spread evenly; rows that are the same in all that is read are counted
first and spread in portions. In a shard they go, longest first, to the bin with the
least room that fits. Open bins stand in order of room left; each carries bitmaps of
its sources and clusters, and the search walks from the first bin that fits to its
successors until one is compatible: the tightest compatible bin. A document longer
than a bin fills bins of its own, and its last words are packed as a piece.

Cases: a null or empty text has size 0 and is still placed; a null source conflicts with
none; a null cluster (only where the caller gives clusters) conflicts with none;
repeated rows are copies of each other, so they never share a bin; equal sizes go by
doc_id (null first), then cluster; no rows give no rows. Only `doc_id` (an integer), `text`,
`source` and the cluster column are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.llm.common import WORD, ascii_lower

PORTION = 250  # equal rows that go to one shard together
PLACED = "doc_id long, source string, piece int, size long, bin_id long, bin_offset long, bin_used long"


def best_fit(pieces: list[tuple[int, str | None, str | None]], capacity: int) -> list[int]:
    """The bin of each (size, source, cluster), in the order given."""
    bits: dict[tuple[str, str], int] = {}
    bit = lambda kind, x: 0 if x is None else 1 << bits.setdefault((kind, x), len(bits))
    order: list[tuple[int, int]] = []  # (room left, bin), ascending
    maps: list[int] = []
    out = []
    for size, source, cluster in pieces:
        mine = bit("s", source) | bit("c", cluster)
        at = bisect_left(order, (size, -1))
        while at < len(order) and maps[order[at][1]] & mine:
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(maps)
            maps.append(0)
        maps[b] |= mine
        if room > size:
            insort(order, (room - size, b))
        out.append(b)
    return out


def pack_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = zip(*[table.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "size", "times")], strict=True)
        pieces = []
        for doc_id, source, cluster, size in [r[:4] for r in rows for _ in range(r[4])]:
            # A row's pieces of a whole bin each, then the rest.
            full, rest = divmod(size, capacity)
            pieces += [(capacity, doc_id, cluster, source, k) for k in range(full)]
            if rest or not full:
                pieces.append((rest, doc_id, cluster, source, full))
        pieces.sort(key=lambda p: (-p[0], p[1] is not None, p[1] or 0, p[2] or "", p[4]))
        bins = best_fit([(p[0], p[3], p[2]) for p in pieces], capacity)
        used: dict[int, int] = {}
        offsets = []
        for p, b in zip(pieces, bins, strict=True):
            offsets.append(used.get(b, 0))
            used[b] = offsets[-1] + p[0]
        return pa.table({
            "doc_id": pa.array([p[1] for p in pieces], pa.int64()), "source": pa.array([p[3] for p in pieces], pa.string()), "piece": pa.array([p[4] for p in pieces], pa.int32()),
            "size": pa.array([p[0] for p in pieces], pa.int64()), "bin_id": pa.array([shard * 10_000_000 + b for b in bins], pa.int64()),
            "bin_offset": pa.array(offsets, pa.int64()), "bin_used": pa.array([used[b] for b in bins], pa.int64()),
        })

    return run


def pack(docs: DataFrame, capacity: int = 2048, shard_docs: int = 2000, cluster: Column | None = None) -> DataFrame:
    """PLACED's columns: one row per piece. cluster: the duplicate cluster of a row, by default equal texts."""
    same = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256) if cluster is None else cluster.cast("string")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    n = docs.count()
    shards = -(-n // shard_docs) or 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", same.alias("cluster"), size.alias("size"))
    rows = rows.groupBy("doc_id", "source", "cluster", "size").agg(F.count(F.lit(1)).alias("n"))
    portion = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PORTION)))
    rows = rows.select("*", portion.alias("portion")).withColumn("times", F.least(F.lit(PORTION), F.col("n") - F.col("portion") * PORTION).cast("int"))
    # Copies of one text are spread by their ids, rows without an id by all else.
    shard = F.pmod(F.xxhash64("doc_id", "size", "portion", F.when(F.col("doc_id").isNull(), F.xxhash64("source", "cluster"))), F.lit(shards)).cast("long")
    rows = rows.select(shard.alias("shard"), "doc_id", "source", "cluster", "size", "times")
    return rows.groupBy("shard").applyInArrow(pack_shard(capacity), PLACED)
