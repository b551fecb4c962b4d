"""Mixing sources to target weights: Sainte-Lague apportionment of token blocks.

Every source gets a target by weight, capped at `most` times its own words; what is above
the cap is shared out again by weight. Words are dealt in blocks of equal size: a source's
seats are split over its shards by Sainte-Lague (highest quotients of the shards' words), so
each shard has an integer quota, and a shard's blocks are drawn by lowest seeded hash, whole
rounds of all its blocks first when the quota exceeds them.

Cases: null text has size 0 and takes 0; a null source is one source and is last in
code-point order; repeated rows each count as rows of their own and share what their
position in the shard gives them; equal hashes are ordered by doc_id and size; no rows give
no rows. Only `doc_id` (an integer), `text` and `source` are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm.common import WORD, kept_rows, numbered, spare, written

HALVINGS = 52


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("sig"), size.alias("size"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("source_key"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source_key, source_size, target: one row per source."""
    each = written(sizes.groupBy("source_key", "source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    each = numbered(each, [F.col("source").asc_nulls_last()], "place")
    each = each.withColumn("w", F.element_at(kinds, (F.col("place") % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    each = written(each.select("source_key", "source_size", "w", "cap"), "weighted")
    total = int(each.agg(F.sum("source_size")).first()[0] or 0)
    # The level of the sources below their cap; each step finds further ones that it lifts to theirs.
    level, full = 0.0, -1
    while True:
        above = F.col("cap").cast("double") / F.col("w") <= F.lit(level)
        n, spent, left = each.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w")))).first()
        if n == full or not left:
            break
        full, level = n, float(total - int(spent or 0)) / float(left)
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w").cast("double"))
    return each.select("source_key", "source_size", target.alias("target"))


def seeded(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]).cast("binary"))


def number(digest: Column) -> Column:
    """The first 60 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def apportion(df: DataFrame, part: list[str], votes: str, tie: str, name: str) -> DataFrame:
    """`seats` of each part dealt to its rows by Sainte-Lague; ties go to the lower `tie`, which is unique in a part.

    A quotient votes / (2 k + 1) has a seat while fewer than `seats` are higher. Halving finds a cut that at most so
    many are above and that no row has two quotients near, so what is missing goes by each row's next quotient. The
    cut needs one number a row of a part in one place; ranks are by part, or over ranges where all is one part.
    """
    v = F.col(votes).cast("double")
    above = lambda n, cut: F.floor((n / cut + F.lit(1.0)) / F.lit(2.0))
    each = df.groupBy(*part).agg(F.collect_list(v).alias("all"), F.max("seats").cast("double").alias("s"))
    count = lambda cut: F.aggregate(F.col("all"), F.lit(0).cast("long"), lambda acc, n: acc + above(n, cut))
    most, total = F.array_max("all"), F.aggregate(F.col("all"), F.lit(0.0), lambda acc, n: acc + n)
    start = F.struct((total / (F.lit(2.0) * (F.col("s") + 1) + F.size("all"))).alias("lo"), (most * 2).alias("hi"))  # too many are above lo, none above hi

    def halve(at: Column, _: Column) -> Column:
        mid = F.sqrt(at["lo"]) * F.sqrt(at["hi"])
        few = count(mid) <= F.col("s")
        return F.struct(F.when(few, at["lo"]).otherwise(mid).alias("lo"), F.when(few, mid).otherwise(at["hi"]).alias("hi"))

    cut = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve)["hi"] * F.lit(1 + 1e-12)
    each = each.select(*part, F.when(total > 0, cut).alias("_cut"))
    df = df.join(each, part) if part else df.crossJoin(F.broadcast(each))  # one row
    df = df.withColumn("_base", F.coalesce(above(v, F.col("_cut")), F.lit(0)).cast("long"))
    given = df.groupBy(*part).agg(F.sum("_base").alias("_given"))
    df = df.join(given, part) if part else df.crossJoin(F.broadcast(given))
    upper = [(v / (F.lit(2.0) * F.col("_base") + F.lit(1.0))).desc(), F.col(tie).asc()]
    df = df.withColumn("_up", F.row_number().over(Window.partitionBy(*part).orderBy(*upper)) - 1) if part else numbered(df, upper, "_up")
    missing = F.when(F.col("_cut").isNotNull(), F.col("seats") - F.col("_given")).otherwise(0)
    return df.withColumn(name, F.col("_base") + (F.col("_up") < missing).cast("int")).drop("_base", "_given", "_up", "_cut")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 64, shard_words: int = 2_000_000, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shard, sig, rounds, spans: one row per document.

    taken is rounds * size + the words of spans, which are (from, words) in the document. A shard holds about
    `shard_words` words of a source by hash of doc_id, which bounds every window's rows whatever a source's share is.
    """
    sizes = written(sized(docs), "sizes")
    seats = source_targets(sizes, weights, most)
    total = seats.agg(F.sum("target")).first()[0] or 0.0
    seats = written(apportion(seats.withColumn("seats", F.round(F.lit(total) / F.lit(block)).cast("long")), [], "target", "source_key", "quota").drop("seats"), "targets")
    few = F.broadcast if seats.count() <= 100_000 else lambda x: x  # a source's rows are many and its target is one row
    rows = sizes.join(few(seats.withColumnRenamed("quota", "seats")), "source_key")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words))).cast("long")
    rank = seeded(seed, F.col("doc_id"))
    rows = rows.withColumns({"rank": rank, "shard": F.pmod(number(rank), shards)})

    quota = rows.groupBy("source_key", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"))
    quota = apportion(quota, ["source_key"], "words", "shard", "quota")
    # A quota is so many words; whole rounds of the shard first, then blocks for what is left, to the nearest.
    due = F.col("quota") * block
    quota = quota.withColumn("blocks", F.ceil(F.col("words") / F.lit(block)).cast("long"))
    quota = quota.withColumn("rounds", F.when(F.col("words") > 0, F.least(F.floor(due / F.col("words")), F.lit(most))).otherwise(0).cast("long"))
    left = due - F.col("rounds") * F.col("words")
    quota = quota.withColumn("extra", F.when((F.col("words") > 0) & (F.col("rounds") < most), F.floor((left * 2 + block) / (2 * block))).otherwise(0).cast("int"))
    # A block is drawn when its lot is among the `extra` lowest of its shard; the last of these is the shard's cut.
    lot = lambda b: F.struct(number(seeded(seed + 1, F.col("source_key"), F.col("shard"), b)).alias("h"), b.alias("b"))
    lots = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lot))
    # One row a shard, but some thousand blocks behind each: a few shards a task.
    quota = written(quota.select("source_key", "shard", "blocks", "rounds", "extra"), "rounds")
    quota = quota.repartition(-(-quota.count() // 4) or 1, "source_key", "shard")
    quota = quota.withColumn("cut", F.when(F.col("extra") > 0, F.get(lots, F.col("extra") - 1)))
    quota = written(quota.select("source_key", "shard", "rounds", "cut"), "quota")

    stream = Window.partitionBy("source_key", "shard").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("lo", F.coalesce(F.sum("size").over(stream), F.lit(0))).withColumn("hi", F.col("lo") + F.col("size"))
    rows = rows.join(quota, ["source_key", "shard"])
    mine = F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))
    drawn = F.filter(mine, lambda b: lot(b) <= F.col("cut"))
    a, z = (lambda b: F.greatest(F.col("lo"), b * block)), (lambda b: F.least(F.col("hi"), (b + 1) * block))
    spans = F.transform(drawn, lambda b: F.struct((a(b) - F.col("lo")).cast("int").alias("from"), (z(b) - a(b)).cast("int").alias("words")))
    some = (F.col("size") > 0) & F.col("cut").isNotNull()
    rows = rows.withColumn("spans", F.when(some, spans))
    extra = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["words"]), F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + extra).cast("long").alias("taken"), "shard", "sig", "rounds", "spans")


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix as documents: whole copies, then the drawn words that remain, with the blanks behind each, as one shorter copy.

    A document that the mix takes no word of is absent. Repeated rows count as one with the copies of all: their whole
    copies, and a shorter one for each row that has drawn words.
    """
    plan = mixed.where("taken > 0").groupBy("doc_id", "sig").agg(
        F.sum(F.when(F.col("rounds") > 0, F.col("rounds")).otherwise(0)).cast("int").alias("whole"), F.collect_list(F.when(F.size("spans") > 0, F.col("spans"))).alias("parts")
    )
    times = mixed.groupBy("doc_id", "sig").agg(F.count(F.lit(1)).alias("times"))
    plan = plan.join(times, (plan["doc_id"].eqNullSafe(times["doc_id"])) & (plan["sig"] == times["sig"])).select(plan["doc_id"], plan["sig"], "whole", "parts", "times")
    whole, parts, copy = spare(docs, "_whole", "_parts", "_copy")
    both = kept_rows(docs, plan.withColumnsRenamed({"whole": whole, "parts": parts}), F.xxhash64("text"), [whole, parts])
    both = both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(whole) + F.size(parts))))
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    spans = F.get(F.col(parts), F.col(copy) - F.col(whole) - 1)
    # The words are one element of an array, so that they are found once for all spans.
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(w, s["from"] + 1, s["words"]))), ""))[0]
    full = F.col(copy) <= F.col(whole)
    both = both.withColumn("text", F.when(full, F.col("text")).otherwise(cut))
    own = {}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(full, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(*[own.get(c, F.col(c)).alias(c) for c in docs.columns])
