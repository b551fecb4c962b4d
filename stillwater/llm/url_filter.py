"""URL filter: rules in a sorted array of 64-bit digests, probed by binary search.

A rule is `host/path`: it fits its host and all subdomains when the url's path starts
with `/path`; the longest fitting rule decides. The index of a table of rules is a file of
sorted xxhash64 keys beside the rules' full strings and actions, all memory-mapped by every
task. A url's probes are each host suffix with each path prefix of a length that a rule has;
a task searches the keys of a batch at once and confirms the stored string. Where no rule
fits, the method's own index of blocked hosts and host labels decides: a label, kept as
`label./`, blocks every host that has it, whatever its domain; without a hit: allow.

The index is written by tasks: Spark deals the rules by ranges of their keys, and each range's task writes its own files
into the shared folder and reports their name, first key and size, one row a task. Judging tasks map a file when a probe
falls in its range. An index of more than `most_mapped` bytes is not probed by every task: the probes of the distinct urls
are dealt by range, so that a task maps one file, and the best hits go back to their urls.

Cases: a null url or one without `://` has host and path ''; repeated rows and ties give
equal verdicts; a rule given twice keeps its first action; no rows give no rows.
Only `page_id` (an integer) and `url` are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.llm import textblocks as tb
from stillwater.llm.common import LOWER, UPPER, shared_dir

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labels of hosts that the method itself blocks, under any domain.
BLOCKED_LABELS = ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
FILES = ("keys", "ends", "strings", "actions")
MOST_MAPPED = 1 << 30  # bytes of an index that every task may map


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class DigestIndex:
    """Sorted keys, where each key's string ends, the strings and actions (1: block) in the same order; all are mapped (in
    a store that can't be mapped, read)."""

    def __init__(self, folder: str, name: str):
        kinds = (np.uint64, np.int64, np.uint8, np.uint8)
        self.keys, self.ends, self.strings, self.actions = (self.mapped(f"{folder}/{name}.{f}", k) for f, k in zip(FILES, kinds, strict=True))

    @staticmethod
    def mapped(path: str, kind: type) -> np.ndarray:
        files, at = store(path)
        if not files.get_file_info(at).size:
            return np.zeros(0, kind)
        if isinstance(files, fs.LocalFileSystem):
            return np.memmap(at, kind, "r")
        with files.open_input_file(at) as f:
            return np.frombuffer(f.read(), kind)

    def string(self, k: int) -> bytes:
        return self.strings[self.ends[k] : self.ends[k + 1]].tobytes()

    def find(self, keys: np.ndarray, probes: list[str]) -> np.ndarray:
        """Position of each probe in the index, or -1; equal keys are walked and compared as strings."""
        out = np.full(len(probes), -1)
        if not len(self.keys) or not len(keys):
            return out
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            k, probe = int(at[i]), probes[i].encode()
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.string(k) == probe:
                    out[i] = k
                    break
                k += 1
        return out


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    return spark.createDataFrame([(r, a, i) for i, (r, a) in enumerate(rules)], "rule string, action string, place long")


def checked(rules: DataFrame) -> DataFrame:
    """rule (host in lower case), n (length of its path), block of a table rule, action, place; a rule given twice counts once."""
    host, path = F.substring_index("rule", "/", 1), F.expr("substring(rule, instr(rule, '/'))")
    good = F.coalesce(F.col("rule").contains("/") & F.col("action").isin("allow", "block"), F.lit(False))
    said = F.when(good, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("not a rule: "), F.coalesce("rule", F.lit("null")))))
    own = rules.select(F.concat(F.translate(host, UPPER, LOWER), path).alias("rule"), F.length(path).alias("n"), said.alias("action"), "place")
    return own.groupBy("rule").agg((F.min(F.struct("place", "action"))["action"] == "block").cast("int").alias("block"), F.first("n").alias("n"))


def write_range(folder: str):
    """Writes the rows of a task, in order of their unsigned keys, as one set of files; tells what it wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, end, first, outs, lengths = f"rules-{uuid.uuid4().hex}", 0, 0, None, {}, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            if not outs:  # another attempt of a task writes other files, and only one attempt's are told
                files, at = store(folder)
                files.create_dir(at)
                outs = {f: files.open_output_stream(f"{at}/{name}.{f}") for f in FILES}
                outs["ends"].write(np.zeros(1, np.int64).tobytes())
                first = batch.column("key")[0].as_py()
            data, offs = tb.buffers(batch.column("rule"))
            outs["keys"].write(batch.column("key").to_numpy().tobytes())
            outs["ends"].write((end + offs[1:]).astype(np.int64).tobytes())
            outs["strings"].write(np.ascontiguousarray(data).tobytes())
            outs["actions"].write(batch.column("block").to_numpy().astype(np.uint8).tobytes())
            n, end = n + batch.num_rows, end + int(offs[-1])
            lengths |= set(batch.column("n").to_pylist())
        for out in outs.values():
            out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"name": [name], "first": [first], "bytes": [17 * n + end], "lengths": pa.array([sorted(lengths)], pa.list_(pa.int32()))})

    return run


def write_index(rules: DataFrame) -> tuple[list[tuple[str, int]], int, list[int]]:
    """The index of a table rule, block, n: its files' names and first keys in order, their bytes, and the lengths n that occur.

    One row a task comes to the driver; the lengths of rules' paths are few (urls have some thousand characters at most).
    """
    key = F.xxhash64("rule")
    # Unsigned order: the keys from 2^63 up, negative as signed numbers, come last.
    keyed = rules.select(key.alias("key"), (key < 0).alias("late"), "rule", "block", "n")
    ordered = keyed.repartitionByRange("late", "key").sortWithinPartitions("late", "key", "rule").drop("late")
    told = ordered.mapInArrow(write_range(shared_dir(rules.sparkSession)), "name string, first long, bytes long, lengths array<int>").collect()
    files = sorted((r.first % 2**64, r.name) for r in told)
    return [(name, first) for first, name in files], sum(r.bytes for r in told), sorted({n for r in told for n in r.lengths})


class Ranges:
    """The files of an index, mapped when first asked for."""

    def __init__(self, folder: str, files: list[tuple[str, int]]):
        self.folder, self.names = folder, [n for n, _ in files]
        self.first = np.array([f for _, f in files], np.uint64)
        self.open: dict[int, DigestIndex] = {}

    def part(self, k: int) -> DigestIndex:
        if k not in self.open:
            self.open[k] = DigestIndex(self.folder, self.names[k])
        return self.open[k]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The file in whose range each key falls; equal keys never lie in two files, as ranges are of keys."""
        return np.searchsorted(self.first, keys, side="right") - 1

    def find(self, keys: np.ndarray, probes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which probes are in the index, and their actions; strings are made of those alone whose key is there."""
        hit, block, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], self.of(keys)
        for k in np.unique(at[at >= 0]).tolist():
            index, rows = self.part(k), np.flatnonzero(at == k)
            place = np.minimum(np.searchsorted(index.keys, keys[rows]), len(index.keys) - 1)
            rows = rows[index.keys[place] == keys[rows]]
            place = index.find(keys[rows], probes.take(pa.array(rows)).to_pylist())
            hit.append(rows[place >= 0])
            block.append(np.asarray(index.actions)[place[place >= 0]].astype(np.int64))
        return np.concatenate(hit), np.concatenate(block)


def host_ends(host: Column) -> Column:
    """The host and what is behind each of its dots; none of an empty host."""
    parts = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host != "", ends).otherwise(F.array().cast("array<string>"))


def probes_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix with every path prefix of a rule's length."""
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    return F.flatten(F.transform(host_ends(host), lambda end: F.transform(cuts, lambda n: F.concat(end, F.substring(path, F.lit(1), n)))))


OWN, OTHER = "r", "b"  # what a string of the index begins with: a rule of the table, a host or label that is blocked


def judged(rows: int, row: np.ndarray, names: list[str], block: np.ndarray) -> tuple[list, list]:
    """rule and verdict of each row from its hits: the longest rule, else blocked if any blocked name is there."""
    rule, verdict = [None] * rows, ["allow"] * rows
    for i, name, b in zip(row.tolist(), names, block.tolist(), strict=True):
        if name[0] == OTHER:
            verdict[i] = verdict[i] if rule[i] else "block"
        elif rule[i] is None or len(name) - 1 > len(rule[i]):
            rule[i], verdict[i] = name[1:], "block" if b else "allow"
    return rule, verdict


def verdicts(folder: str, files: list[tuple[str, int]]):
    """Judges batches of page_id, host, path, probes, keys."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder, files)
        for batch in batches:
            lists = batch.column("probes")
            row, probes = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()
            hit, block = ranges.find(batch.column("keys").flatten().to_numpy(zero_copy_only=False).view(np.uint64), probes)
            rule, verdict = judged(batch.num_rows, row[hit], probes.take(pa.array(hit)).to_pylist(), block)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return judge


def by_ranges(parts: DataFrame, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """The same verdicts, each probe judged by a task that maps the one file of its range. Equal urls are judged once."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder, files)
        for batch in batches:
            at = ranges.of(batch.column("key").to_numpy().view(np.uint64))
            yield batch.append_column("at", pa.array(at, pa.int64()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder, files)
        for batch in batches:
            hit, block = ranges.find(batch.column("key").to_numpy().view(np.uint64), batch.column("probe"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(hit)) for c in ("host", "path", "probe")), pa.array(block)], ["host", "path", "probe", "block"])

    urls = parts.select("host", "path", "probes").dropDuplicates(["host", "path"])
    each = urls.select("host", "path", F.explode("probes").alias("probe")).withColumn("key", F.xxhash64("probe"))
    dealt = each.mapInArrow(deal, "host string, path string, probe string, key long, at long").where("at >= 0")
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(8))  # a range that many urls ask for is several tasks' work
    found = dealt.repartition("at", salt).mapInArrow(look, "host string, path string, probe string, block long")
    own = F.col("probe").startswith(OWN)
    longest = F.max(F.when(own, F.struct(F.length("probe").alias("n"), "probe", "block")))
    best = found.groupBy("host", "path").agg(longest.alias("own"), F.bool_or(~own).alias("other"))
    said = F.when(F.col("own").isNotNull(), F.when(F.col("own.block") == 1, "block").otherwise("allow")).when(F.col("other"), "block").otherwise("allow")
    out = parts.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.expr("substring(own.probe, 2)").alias("rule"), said.alias("verdict"))


def url_filter(
    pages: DataFrame, rules: DataFrame | tuple[tuple[str, str], ...] = RULES, blocked_hosts: DataFrame | tuple[str, ...] = (), blocked_labels: tuple[str, ...] = BLOCKED_LABELS, most_mapped: int = MOST_MAPPED
) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page.

    rules: pairs, or a table rule, action, place (the order in which they are given); blocked_hosts: names, or a table host.
    """
    spark = pages.sparkSession
    own = checked(rules if isinstance(rules, DataFrame) else rule_table(spark, rules)).withColumn("rule", F.concat(F.lit(OWN), "rule"))
    hosts = blocked_hosts if isinstance(blocked_hosts, DataFrame) else spark.createDataFrame([(h,) for h in blocked_hosts], "host string")
    labels = spark.createDataFrame([(f"{b}.",) for b in blocked_labels], "host string")
    other = hosts.select("host").union(labels).select(F.concat(F.lit(OTHER), F.translate("host", UPPER, LOWER), F.lit("/")).alias("rule"), F.lit(1).alias("block"), F.lit(0).alias("n")).distinct()
    files, held, lengths = write_index(own.unionByName(other))
    after = F.regexp_extract("url", r"^[\s\S]*?://([\s\S]*)$", 1)
    whole = F.when(F.col("url").contains("://"), after).otherwise("")
    host = F.translate(F.regexp_extract(whole, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(whole, r"^[^/?#]*([^?#]*)", 1)
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    named = F.transform(F.split("host", r"\."), lambda p: F.concat(F.lit(OTHER), p, F.lit("./")))
    ends = F.transform(host_ends(F.col("host")), lambda h: F.concat(F.lit(OTHER), h, F.lit("/")))
    mine = F.transform(probes_of(F.col("host"), F.col("path"), [n for n in lengths if n]), lambda p: F.concat(F.lit(OWN), p))
    parts = parts.withColumn("probes", F.concat(mine, ends, named))
    if held > most_mapped:
        return by_ranges(parts, shared_dir(spark), files)
    return parts.withColumn("keys", F.transform("probes", lambda p: F.xxhash64(p))).mapInArrow(verdicts(shared_dir(spark), files), SCHEMA)
