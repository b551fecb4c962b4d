"""Checksums of files: the usual ones in the JVM, the chunked one (MD4 of the chunks' MD4) as many tasks' work.

A file is cut into chunks, each chunk's digest is found in whatever task it falls to, and only 16 bytes a chunk come
together again. A file of one chunk or less has that chunk's digest. Where the size is a whole number of chunks two
conventions are in use, with and without the digest of an empty chunk at the end: both are given. A null content has no hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.functions.md4 import md4

CHUNK = 9_728_000  # fixed value


def digests(rows: DataFrame, column: str) -> DataFrame:
    """rows with `column` (binary) replaced by its MD4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = pa.array(md4(part.column(column).to_pylist()), pa.binary())
            yield part.set_column(part.schema.get_field_index(column), column, found)

    return rows.mapInArrow(run, rows.schema)


def chunked(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """id, hashes: array of one or two digests in upper-case hex. files: id (unique), content."""
    known = files.where("content IS NOT NULL").select("id", F.octet_length("content").alias("size"), "content")
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / chunk).cast("int") - 1))
    pieces = known.select("id", "size", "content", F.explode(cuts).alias("k"))
    part = F.substring(F.col("content"), F.col("k") * chunk + 1, F.lit(chunk))
    each = digests(pieces.select("id", "size", "k", part.alias("d")).repartition("id", "k"), "d")
    whole = each.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("ds"))
    joined = whole.select("id", "size", F.transform("ds", lambda x: x["d"]).alias("ds"))
    empty = F.unhex(F.lit("31D6CFE0D16AE931B73C59D7E0C089C0"))  # fixed value: MD4 of nothing
    both = F.concat(F.aggregate("ds", F.lit(b""), lambda acc, d: F.concat(acc, d)), F.when((F.col("size") > 0) & (F.col("size") % chunk == 0) & (F.col("o") == 1), empty).otherwise(F.lit(b"")))
    ways = joined.withColumn("o", F.explode(F.when((F.col("size") > 0) & (F.col("size") % chunk == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    one = (F.size("ds") == 1) & (F.col("o") == 0)
    again = digests(ways.where(~one).select("id", "o", both.alias("d")), "d")
    out = ways.where(one).select("id", "o", F.col("ds")[0].alias("d")).unionByName(again)
    return out.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", F.hex("d").alias("h")))).alias("hs")).select("id", F.transform("hs", lambda x: x["h"]).alias("hashes"))


def checksums(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """id, crc32, md5, sha1, sha256 (upper-case hex) and ed2k (array). files: id (unique), content."""
    c = F.col("content")
    plain = files.where("content IS NOT NULL").select(
        "id", F.lpad(F.hex(F.crc32(c)), 8, "0").alias("crc32"), F.upper(F.md5(c)).alias("md5"), F.upper(F.sha1(c)).alias("sha1"), F.upper(F.sha2(c, 256)).alias("sha256")
    )
    return plain.join(chunked(files, chunk).withColumnRenamed("hashes", "ed2k"), "id")
