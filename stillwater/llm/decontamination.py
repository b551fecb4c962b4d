"""Benchmark decontamination: a broadcast hash set of the test items' word windows, looked up by every text.

Words are runs of letters, digits and characters above ASCII, A-Z as a-z. A window is `K` consecutive words of an item; an
item of fewer words is one window. Windows of all items form sorted arrays of 64-bit hashes with the places of their words;
equal hashes of different words are kept in further layers, so a hit is always confirmed word by word. The arrays are sent to
every task, the texts are read once and never shuffled.

What is broadcast has a bound: `most_words` words of items (40 bytes each beside their characters). Items are cut into pieces
of at most `PIECE` words that overlap by `K - 1`, and pieces beyond the bound are dealt to slices by hash until no slice is over
it. Each slice then is a pass over the texts that yields hits by digest of the text, which are put together at last: the
result is the same for any number of slices.

`hits` gives n_words, hits (spans of word numbers, end excluded, apart and in order) and items (ids as strings, sorted);
`decontaminate` takes the hit spans or the hit documents out.

Cases: a null or empty text has no words and no hits; an item without words is in no text; items of one id are one item, a
null id is the item '' (an empty string); repeated rows get equal results; an empty table of items hits nothing; columns of
other names pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stillwater.llm import textblocks as tb
from stillwater.llm.common import spare, written

K = 10
PIECE = 50_000
MOST_WORDS = 4_000_000  # of one slice; its characters are held to 8 times as many bytes
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOUND = "n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of folded words, a part of a very long text at a time."""
    step = 1 << 18
    return np.concatenate([np.zeros(0, tb.U), *(tb.span_hashes(data, starts[i : i + step], ends[i : i + step], tb.FOLD) for i in range(0, len(starts), step))])


def same_words(a: dict, at: np.ndarray, b: dict, to: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words of a from `at` are those of b from `to`, compared byte by byte."""
    ok = np.ones(len(at), bool)
    for j in range(k):
        left = np.flatnonzero(ok)
        sa, sb = a["starts"][at[left] + j], b["starts"][to[left] + j]
        n = a["ends"][at[left] + j] - sa
        even = n == b["ends"][to[left] + j] - sb
        ok[left[~even]] = False
        left, sa, sb, n = left[even], sa[even], sb[even], n[even]
        if len(left):
            ahead = np.cumsum(n) - n
            pos = np.arange(int(n.sum())) - np.repeat(ahead, n)
            same = tb.FOLD[a["data"][np.repeat(sa, n) + pos]] == tb.FOLD[b["data"][np.repeat(sb, n) + pos]]
            ok[left] = np.logical_and.reduceat(same, ahead)
    return ok


def words_of(col: pa.Array) -> dict:
    data, offs = tb.buffers(col)
    starts, ends, doc = tb.tokens(data, offs, IN_WORD)
    return {"data": data, "starts": starts, "ends": ends, "doc": doc, "hash": word_hashes(data, starts, ends), "n": len(col)}


def layers_of(w: dict, at: np.ndarray, h: np.ndarray, k: int, item: np.ndarray) -> Iterator[dict]:
    """Sorted windows of one length, each with the items that hold it; a hash that clashes goes to the next layer."""
    order = np.argsort(h, kind="stable")
    at, h, item = at[order], h[order], item[order]
    while len(h):
        keys, first, group = np.unique(h, return_index=True, return_inverse=True)
        same = same_words(w, at, w, at[first][group], k)
        pairs = np.unique(np.stack([group[same], item[same]], 1), axis=0)
        bits = 1 << min(26, max(16, (len(keys) * 16).bit_length()))
        seen = np.zeros(bits, bool)
        seen[(keys & tb.U(bits - 1)).astype(np.int64)] = True
        yield {"k": k, "keys": keys, "at": at[first], "seen": seen, "items": pairs[:, 1], "bounds": np.searchsorted(pairs[:, 0], np.arange(len(keys) + 1))}
        at, h, item = at[~same], h[~same], item[~same]


def build(ids: list[str], texts: list[str]) -> dict:
    """The windows of the items; ids repeat where an item is in pieces."""
    w = words_of(pa.array(texts, pa.string()))
    names = sorted(set(ids))
    number = {x: i for i, x in enumerate(names)}
    item = np.array([number[x] for x in ids], np.int64)
    counts = np.bincount(w["doc"], minlength=w["n"])
    layers = []
    for k in sorted({min(K, int(c)) for c in counts if c}):
        h, at = tb.windows(w["hash"], w["doc"], k)
        fits = counts[w["doc"][at]] >= K if k == K else counts[w["doc"][at]] == k
        layers += layers_of(w, at[fits], h[fits], k, item[w["doc"][at[fits]]])
    return {"data": w["data"], "starts": w["starts"], "ends": w["ends"], "names": names, "layers": layers}


def find(index: dict, w: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each word whether it is hit; for each text the numbers of its items."""
    edge, pairs = np.zeros(len(w["starts"]) + 1, np.int64), []
    hashes: dict[int, tuple] = {}
    for number, layer in enumerate(index["layers"]):
        k = layer["k"]
        if k not in hashes:
            hashes[k] = tb.windows(w["hash"], w["doc"], k)
        h, at = hashes[k]
        maybe = np.flatnonzero(layer["seen"][(h & tb.U(len(layer["seen"]) - 1)).astype(np.int64)])
        to = np.minimum(np.searchsorted(layer["keys"], h[maybe]), len(layer["keys"]) - 1)
        known = layer["keys"][to] == h[maybe]
        at, to = at[maybe[known]], to[known]
        ok = same_words(w, at, index, layer["at"][to], k)
        at, to = at[ok], to[ok]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + k, -1)
        if len(at):
            pairs.append(np.unique(np.stack([w["doc"][at], np.full(len(at), number), to], 1), axis=0))
    items: list[np.ndarray] = [np.zeros(0, np.int64)] * w["n"]
    if pairs:
        rows = np.concatenate(pairs)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
        for part in np.split(rows, cuts):
            got = [x["items"][x["bounds"][e] : x["bounds"][e + 1]] for x, e in ((index["layers"][n], e) for _, n, e in part)]
            items[part[0, 0]] = np.unique(np.concatenate(got))
    return np.cumsum(edge)[:-1] > 0, items


def spans(hit: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hit words: offsets of each text's runs, starts and ends counted within the text."""
    first = np.searchsorted(doc, np.arange(n))
    fresh = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    starts = np.flatnonzero(hit & (fresh | ~np.append(False, hit[:-1])[: len(hit)]))
    ends = np.flatnonzero(hit & (np.append(fresh[1:], True)[: len(hit)] | ~np.append(hit[1:], False)[: len(hit)])) + 1
    of = doc[starts]
    return np.searchsorted(of, np.arange(n + 1)), starts - first[of], ends - first[of]


def scan(docs: DataFrame, text: str, keep: list[str], index: dict, as_names: list[str]) -> DataFrame:
    """The columns `keep` of every row with n_words, hits and items under the given names."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        names = pa.array(index["names"], pa.string())
        for part in tb.slices(batches, text):
            w = words_of(part.column(text))
            hit, items = find(index, w)
            offs, starts, ends = spans(hit, w["doc"], w["n"])
            pairs = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"])
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
            ids = names.take(pa.array(np.concatenate([np.zeros(0, np.int64), *items])))
            found = [pa.array(np.bincount(w["doc"], minlength=w["n"])), pa.ListArray.from_arrays(offs.astype(np.int32), pairs), pa.ListArray.from_arrays(sizes, ids)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *found], [*keep, *as_names])

    schema = docs.select(*keep).schema
    for name, field in zip(as_names, StructType.fromDDL(FOUND), strict=True):
        schema = schema.add(name, field.dataType)
    return docs.mapInArrow(run, schema)


def pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """item, part, text, n: the items' words in pieces of `size` that overlap by K - 1."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            for item, text in zip(part.column("item").to_pylist(), part.column("text"), strict=True):
                w = words_of(pa.array([text.as_py()], pa.string()))
                for k, a in enumerate(range(0, max(1, len(w["starts"]) - K + 1), size)):
                    b = min(a + size + K - 1, len(w["starts"]))
                    if b > a:
                        yield pa.RecordBatch.from_pydict({"item": [item], "part": [k], "text": [bytes(w["data"][w["starts"][a] : w["ends"][b - 1]]).decode()], "n": [b - a]})

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "item string, part long, text string, n long")


def slice_frames(cut: DataFrame, most_words: int) -> list[DataFrame]:
    """The pieces in as few slices as their sizes allow, none over the bound (one piece at least)."""
    weight = F.greatest("n", F.octet_length("text") / 8)
    total = cut.agg(F.sum(weight)).first()[0] or 0
    n = max(1, -int(-total // most_words))
    while n > 1:
        of = F.pmod(F.xxhash64("item", "part", "text"), F.lit(n)).cast("int")
        largest = cut.groupBy(of.alias("of")).agg(F.sum(weight).alias("w"), F.countDistinct("item", "part", "text").alias("k")).where((F.col("w") > most_words) & (F.col("k") > 1)).count()
        if not largest:
            return [cut.where(of == k) for k in range(n)]
        n = n * 5 // 4 + 1
    return [cut]


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, most_words: int = MOST_WORDS, piece: int = PIECE) -> DataFrame:
    """The columns `keep` of every row of docs (all, if not given) with n_words, hits and items."""
    keep = docs.columns if keep is None else keep
    names = spare(docs.select(*keep), "n_words", "hits", "items")
    (text,) = spare(docs, "_text")
    docs = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    slices = slice_frames(written(pieces(benchmark, piece), "items"), most_words)

    def index(part: DataFrame) -> dict:
        rows = part.select("item", "text").distinct().collect()
        return build([r.item for r in rows], [r.text for r in rows])

    if len(slices) == 1:
        return scan(docs, text, keep, index(slices[0]), names)
    (digest,) = spare(docs, "_digest")
    docs = docs.withColumn(digest, F.sha2(text, 256))
    texts = written(docs.select(F.col(digest).alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"]), "texts")
    found = [written(scan(texts, "text", ["digest"], index(s), ["n_words", "hits", "items"]).where(F.size("hits") > 0), "hits") for s in slices]
    found = reduce(DataFrame.unionByName, found).groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = found.mapInArrow(united, f"digest string, {FOUND.partition(', ')[2]}")
    found = found.select(F.col("digest").alias(digest), F.col("hits").alias(names[1]), F.col("items").alias(names[2]))
    plain = scan(docs, text, list(dict.fromkeys([*keep, digest])), build([], []), names)
    none = {c: plain[c] for c in names[1:]}
    return plain.join(found, digest, "left").select(*(plain[c] for c in keep), plain[names[0]], *(F.coalesce(found[c], none[c]).alias(c) for c in names[1:]))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that meet made one."""
    for part in batches:
        out = []
        for rows in part.column("hits").to_pylist():
            whole: list[dict] = []
            for s in sorted(rows, key=lambda s: s["start"]):
                if whole and s["start"] <= whole[-1]["end"]:
                    whole[-1]["end"] = max(whole[-1]["end"], s["end"])
                else:
                    whole.append(dict(s))
            out.append(whole)
        yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), part.column("items")], ["digest", "hits", "items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", most_words: int = MOST_WORDS) -> DataFrame:
    """docs without the hit words (remove="spans": from the first character of a span's first word to the last of its last)
    or without the hit documents (remove="documents"); same columns."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is {remove!r}")
    found = hits(docs, benchmark, most_words=most_words)
    columns, span = docs.columns, found.columns[-2]
    if remove == "documents":
        return found.where(F.size(span) == 0).select(*docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            w = words_of(part.column("text"))
            first = np.searchsorted(w["doc"], np.arange(w["n"]))
            texts = part.column("text").to_pylist()
            data, offs = tb.buffers(part.column("text"))
            for k, rows in enumerate(part.column(span).to_pylist()):
                if rows:
                    at = [int(offs[k]), *(int(x) for s in rows for x in (w["starts"][first[k] + s["start"]], w["ends"][first[k] + s["end"] - 1])), int(offs[k + 1])]
                    texts[k] = b"".join(bytes(data[a:b]) for a, b in zip(at[::2], at[1::2], strict=True)).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns], columns)

    return found.withColumn("text", F.col("text").cast("string")).mapInArrow(cut, docs.withColumn("text", F.col("text").cast("string")).schema)
