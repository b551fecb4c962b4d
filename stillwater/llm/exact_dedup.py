"""Exact dedup over an extendible-hash index kept on shared files.

The first 60 bits of a text's sha256 are its key. Copies are counted in the map tasks, so an
index entry is one distinct fingerprint (sha256, xxhash64, length). A directory over key
prefixes doubles until no bucket is overfull (more than `capacity` entries) or the bits
end; a bucket that fits at a lesser depth keeps that depth and spans several slots. The
entries lie in the shared folder, dealt to owner tasks by ranges of buckets and ordered in
each. Texts of fingerprints that occur more than once are first gathered in `SALTS` parts (a
part has each of its texts once, with its count and its largest row), then every part's texts
go to the owner of their bucket: the owner compares the bytes, puts together what is equal, chains
what is not under one digest, and names the row that stays of each link. A row finds its
link by fingerprint, and by its bytes where two links of a chain have one fingerprint.

Cases: null text counts as empty; texts are equal when identical after A-Z to a-z; the
row with the largest doc_id stays (a null doc_id is less than any); of rows that share this
doc_id `exact_dedup` says kept for all and `keep_first_copies` keeps one; no rows give no
rows. Only `doc_id` (an integer) and `text` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm.common import ascii_lower, join_hot, stay, written

KEY_BITS = 60
PRINT = ["digest", "check", "nbytes"]
BYTES = ["norm"]  # what an owner compares beside the fingerprint
SALTS = 8
MOST_SLOTS = 1_000_000  # of 20 bytes, broadcast; a larger directory is joined by shuffle


def fingerprint(norm: Column) -> dict[str, Column]:
    return {"digest": F.unhex(F.sha2(norm.cast("binary"), 256)), "check": F.xxhash64(norm), "nbytes": F.octet_length(norm)}


def normalised(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))


def key_of(digest: str = "digest") -> Column:
    return F.conv(F.substring(F.hex(digest), 1, KEY_BITS // 4), 16, 10).cast("long")


def slot_of(depth: int) -> Column:
    return F.shiftright(key_of(), KEY_BITS - depth)


def directory(entries: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """slot, bucket (its least key), depth of the bucket; and the depth of the directory, which has 2^depth slots.

    entries: one row each, with a digest. A slot without an entry is not listed.
    """
    depth = max(0, math.ceil(math.log2(max(1, entries.count()) / capacity)) + 1)
    while True:
        slots = written(entries.groupBy(slot_of(depth).alias("slot")).count(), "slots")
        if depth == KEY_BITS or slots.where(F.col("count") > capacity).isEmpty():
            break
        depth = min(KEY_BITS, depth + 2)
    # Every slot has a bucket at each depth up to the directory's; the shallowest that is not overfull is its own.
    deep = slots.select("slot", "count", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("at"))
    deep = deep.withColumn("head", F.expr(f"shiftright(slot, {depth} - at)"))
    fits = deep.groupBy("at", "head").agg(F.sum("count").alias("held")).where((F.col("held") <= capacity) | (F.col("at") == depth))
    own = deep.join(fits, ["at", "head"]).groupBy("slot").agg(F.min(F.struct("at", "head")).alias("b"))
    return own.select("slot", F.expr(f"shiftleft(b.head, {KEY_BITS} - b.at)").alias("bucket"), F.col("b.at").alias("depth")), depth


def in_buckets(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """rows (with a digest) with their bucket and its depth."""
    slots = F.broadcast(slots) if slots.count() <= MOST_SLOTS else slots
    return rows.withColumn("slot", slot_of(depth)).join(slots, "slot").drop("slot")


def index(docs: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, tuple[DataFrame, int]]:
    """The fingerprint of each row (doc_id, sig, PRINT), the index: bucket, depth, PRINT, copies, in files by ranges of buckets,
    and the directory."""
    rows = normalised(docs)
    prints = written(rows.withColumns(fingerprint(F.col("norm"))).drop("norm"), "prints")
    entries = written(prints.groupBy(*PRINT).agg(F.count(F.lit(1)).alias("copies")), "entries")
    slots, depth = directory(entries, capacity)
    slots = written(slots, "directory")
    return prints, written(in_buckets(entries, slots, depth).repartitionByRange("bucket").sortWithinPartitions("bucket", "digest"), "index"), (slots, depth)


def chains(docs: DataFrame, entries: DataFrame, where: tuple[DataFrame, int], most_broadcast: int) -> DataFrame:
    """The links of the fingerprints that occur more than once: bucket, depth, PRINT, link (place in the chain), twins (links of
    this fingerprint), bytes (the text where there are twins), keep (doc_id, sig), group_size. A file holds what one owner decided."""
    again = entries.where("copies > 1")
    rows = normalised(docs).withColumn("check", fingerprint(F.col("norm"))["check"])
    if again.count() <= most_broadcast:  # beyond that every part's distinct texts travel, and owners leave out those that occur once
        rows = rows.join(F.broadcast(again.select("check").distinct()), "check", "left_semi")
    parts = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), "norm").agg(F.max(F.struct("doc_id", "sig")).alias("keep"), F.count(F.lit(1)).alias("n"))
    owned = in_buckets(parts.withColumns(fingerprint(F.col("norm"))), *where).repartitionByRange("bucket")
    # From here on all is in the owner's task: it has the whole bucket.
    links = owned.groupBy("bucket", "depth", *PRINT, *BYTES).agg(F.max("keep").alias("keep"), F.sum("n").alias("group_size"))
    chain, same = Window.partitionBy("bucket", "digest").orderBy(*BYTES, "check"), Window.partitionBy("bucket", *PRINT)
    links = links.withColumns({"link": F.row_number().over(chain), "twins": F.count(F.lit(1)).over(same), "copies": F.sum("group_size").over(same)}).where("copies > 1").drop("copies")
    text = F.when(F.col("twins") > 1, F.col("norm")) if "norm" in BYTES else F.lit(None).cast("string")
    return written(links.withColumn("bytes", text).drop("norm"), "chains")


def grouped(docs: DataFrame, capacity: int, most_broadcast: int) -> DataFrame:
    """doc_id, sig, digest, bucket, keep, group_size: one row per row of docs."""
    prints, entries, where = index(docs, capacity)
    links = chains(docs, entries, where, most_broadcast)
    total = prints.count()
    # A single entry is its own group; a hot group's rows meet their link by broadcast.
    single = entries.where("copies = 1").select(*PRINT, "bucket", F.lit(None).cast(links.schema["keep"].dataType).alias("keep"), F.lit(1).cast("long").alias("group_size"))
    plain = links.where("twins = 1").select(*PRINT, "bucket", "keep", "group_size")
    hot = links.where(F.col("twins") == 1).where(F.col("group_size") * 1000 >= total)  # a thousand at most
    out = join_hot(prints, single.unionByName(plain), hot, PRINT)
    twins = links.where("twins > 1")
    if not twins.isEmpty():
        texts = normalised(docs).withColumns(fingerprint(F.col("norm")))
        more = texts.join(twins.select(*PRINT, F.col("bytes").alias("norm"), "bucket", "keep", "group_size"), [*PRINT, "norm"]).drop("norm")
        out = out.unionByName(more.select(*out.columns))
    own = F.struct("doc_id", "sig")
    return out.select("doc_id", "sig", "digest", "bucket", F.coalesce("keep", own).alias("keep"), "group_size")


def exact_dedup(docs: DataFrame, capacity: int = 20_000, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket: one row per row of docs.

    capacity: entries of a bucket; most_broadcast: fingerprints (8 bytes each) that are broadcast to find the texts to compare.
    """
    rows = grouped(docs, capacity, most_broadcast)
    return rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("keep.doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "bucket")


def keep_first_copies(docs: DataFrame, capacity: int = 20_000, most_broadcast: int = 1_000_000) -> DataFrame:
    """docs with one row of each group: of the largest doc_id, then of the greatest hash of the text as it is."""
    rows = written(grouped(docs, capacity, most_broadcast), "groups")
    keys = rows.where(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("sig") == F.col("keep.sig")))
    return stay(docs, keys.groupBy("doc_id", "sig").agg(F.count(F.lit(1)).alias("times")), F.xxhash64("text"))
