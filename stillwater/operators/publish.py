"""The publish loop: which measured frames of a source are kept, in order, each far enough from those kept before.

Frames go shot by shot (by turn), in a shot by detail, nearness to its middle, time and id. A frame is published if its shot
has published fewer than `per_shot`, the source fewer than `budget`, and no published frame is nearer than `cross` (the
shot's first) or `intra` (its further ones) by the root mean square of their signatures. Every other frame gets its reason.

A greedy choice, made in rounds over all sources at once: a round decides the next `block` places of every source in one small
group, which knows for each frame the distance to the nearest published one; then the undecided rest, cut into chunks, meets the
few newly published ones, and what lies within `cross` of one is out for good. So the work is frames times published ones,
no task holds a source, and a round takes away a block and all that it makes redundant.

A published place beyond the budget changes nothing before it, so rounds end there; all later reasons follow from the
published frames alone. Frames of no signature (null) are as far as can be (1.0) from all others; equal frames take turns by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.operators.catalog import placed
from stillwater.operators.keep import kept

LIMIT, PLAN, CAP = "prepared_bundle_candidate_limit", "outside_the_extraction_plan", "shot_publish_limit"
TWIN, REPEAT = "same_shot_near_twin", "repeated_framing"
CHUNK = 2048


def framing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a from those of b; rows of no signature are 1 apart from all."""
    d = np.sqrt(np.maximum(0, ((a[:, None, :] - b[None, :, :]) ** 2).mean(2)))
    return np.where(np.isnan(d), 1.0, d)


def signatures(col: pa.ChunkedArray) -> np.ndarray:
    rows = col.to_pylist()
    width = max((len(r) for r in rows if r), default=1)
    return np.array([r or [np.nan] * width for r in rows], np.float64)


def in_order(frames: DataFrame) -> DataFrame:
    """frames with ord, their place in the order of all sources, numbered over ranges."""
    middle = frames.groupBy("src", "shot").agg((F.min("t") / 2 + F.max("t") / 2).alias("mid"))
    rows = frames.join(middle, ["src", "shot"]).withColumns({"less": -F.col("detail"), "far": F.abs(F.col("t") - F.col("mid"))})
    return placed(rows, "src", "turn", "shot", "less", "far", "t", "id").withColumnRenamed("place", "ord").drop("less", "far", "mid")


def decide(cross: float, intra: float, per_shot: int):
    """The places of a block, one after the other."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        sig, shots, near = signatures(table["v"]), table["shot"].to_pylist(), table["near"].to_numpy().copy()
        held = dict(zip(shots, table["held"].to_pylist(), strict=True))
        taken = []
        for k, shot in enumerate(shots):
            if held[shot] < per_shot and near[k] >= (intra if held[shot] else cross):
                taken.append(k)
                held[shot] += 1
                near = np.minimum(near, framing(sig, sig[k : k + 1])[:, 0])
        return table.take(pa.array(taken, pa.int64())).select(["src", "shot", "ord", "id", "v"])

    return run


def nearest(rows: DataFrame, published: DataFrame, frames_schema: str) -> DataFrame:
    """rows (src, shot, ord, id, v) with the nearest published frame of a lower place: by, near (1.0 without one)."""
    sizes = rows.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    cut = rows.join(sizes, "src").withColumn("chunk", F.pmod(F.xxhash64("ord"), F.col("chunks")).cast("int")).drop("chunks")
    few = published.join(sizes, "src").select(F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), *[F.col(c).alias(c) for c in ("src", "ord", "id", "v")])

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by("ord")
        by, near = [None] * x.num_rows, np.ones(x.num_rows)
        if x.num_rows and y.num_rows:
            a, b = signatures(x["v"]), signatures(y["v"])
            width = max(a.shape[1], b.shape[1])
            a, b = (np.full((len(m), width), np.nan) if m.shape[1] < width else m for m in (a, b))
            d = np.where(y["ord"].to_numpy()[None, :] < x["ord"].to_numpy()[:, None], framing(a, b), 1.0)
            at = d.argmin(1)
            near = d[np.arange(len(at)), at]
            ids = y["id"].to_pylist()
            by = [ids[k] if n < 1 else None for k, n in zip(at, near, strict=True)]
        return x.drop_columns(["chunk"]).append_column("by", pa.array(by, pa.int64())).append_column("near", pa.array(near))

    return cut.groupBy("src", "chunk").cogroup(few.groupBy("src", "chunk")).applyInArrow(meet, f"{frames_schema}, by long, near double")


def publish(frames: DataFrame, budget: int, per_shot: int = 2, cross: float = 0.10, intra: float = 0.17, block: int = 512) -> DataFrame:
    """src, id, outcome ('published' or the reason), by, distance (of the nearest one published before, for redundant frames).

    frames: src, shot, turn (a shot's place), id, t, detail, v, planned, blank (the reason of a frame without a picture, or null).
    """
    base = kept(in_order(frames.select("src", "shot", "turn", "id", "t", "detail", "v", "planned", "blank")))
    past = base.where(~F.col("planned")).groupBy("src").agg(F.min("turn").alias("end"))
    base = base.join(past, "src", "left")
    kinds = dict(base.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("src", "shot", "ord", "id", "v"))
    rest = base.where(F.col("planned") & F.col("blank").isNull() & (F.col("end").isNull() | (F.col("turn") <= F.col("end")))).select("src", "shot", "ord", "id", "v")
    rest = kept(rest.withColumns({"near": F.lit(1.0), "held": F.lit(0)}))
    published = rest.select("src", "shot", "ord", "id", "v").limit(0)
    while not rest.isEmpty():
        lo = rest.groupBy("src").agg(F.min("ord").alias("lo"))
        rest = rest.join(lo, "src")
        new = kept(rest.where(F.col("ord") < F.col("lo") + block).drop("lo").groupBy("src").applyInArrow(decide(cross, intra, per_shot), schema))
        published = kept(published.unionByName(new))
        done = published.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= budget)
        left = rest.where(F.col("ord") >= F.col("lo") + block).join(done, "src", "left_anti")
        more = new.groupBy("src", "shot").agg(F.count(F.lit(1)).cast("int").alias("more"))
        seen = nearest(left.select("src", "shot", "ord", "id", "v"), new, schema).select("src", "ord", F.col("near").alias("fresh"))
        left = left.join(seen, ["src", "ord"]).join(more, ["src", "shot"], "left")
        left = left.withColumns({"near": F.least("near", "fresh"), "held": F.col("held") + F.coalesce("more", F.lit(0))})
        rest = kept(left.where((F.col("near") >= cross) & (F.col("held") < per_shot)).select("src", "shot", "ord", "id", "v", "near", "held"))
    published = published.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("ord"))).where(F.col("place") <= budget)
    return reasons(base, published, schema, budget, per_shot)


def reasons(base: DataFrame, published: DataFrame, schema: str, budget: int, per_shot: int) -> DataFrame:
    """What became of each frame, from the published ones. A source has at most `budget` of these."""
    published = kept(published)
    last = published.where(F.col("place") == budget).select("src", F.col("ord").alias("stop"))
    turns = base.join(last, "src").where(F.col("ord") == F.col("stop")).select("src", "stop", F.col("turn").alias("stop_turn"))
    rows = base.join(turns, "src", "left").join(published.select("src", "ord", F.lit(True).alias("in")), ["src", "ord"], "left")
    # How many of its shot were published before a frame: a shot has few places that published.
    held = published.groupBy("src", "shot").agg(F.sort_array(F.collect_list("ord")).alias("own"))
    rows = rows.join(held, ["src", "shot"], "left").withColumn("before", F.coalesce(F.size(F.filter("own", lambda o: o < F.col("ord"))), F.lit(0)))
    rows = rows.withColumn("before", F.greatest("before", F.lit(0)))
    full = F.col("before") >= per_shot
    late = F.col("stop").isNotNull() & (F.col("ord") > F.col("stop"))
    inside = F.col("stop_turn").isNull() | (F.col("turn") <= F.col("stop_turn"))
    own: Column = (
        F.when(~F.col("planned"), PLAN).when(F.col("blank").isNotNull(), F.col("blank")).when(F.col("in"), "published")
        .when(full, CAP).when(late, LIMIT).when(F.col("before") > 0, TWIN).otherwise(REPEAT)
    )
    rows = kept(rows.withColumn("own", own))
    # Behind a shot with frames that aren't planned, the limit counts if it was met in that shot or before.
    met = rows.where((F.col("turn") == F.col("end")) & (F.col("own") == LIMIT)).select("src", F.lit(True).alias("met")).distinct()
    behind = F.col("end").isNotNull() & (F.col("turn") > F.col("end"))
    passed = F.col("stop_turn").isNotNull() & (F.col("stop_turn") < F.col("end"))
    outcome = F.when(behind, F.when(passed | F.col("met"), LIMIT).otherwise(PLAN)).when(~inside, LIMIT).otherwise(F.col("own"))
    told = kept(rows.join(met, "src", "left").select("src", "shot", "ord", "id", "v", outcome.alias("outcome")))
    near = nearest(told.where(F.col("outcome").isin(TWIN, REPEAT)).select("src", "shot", "ord", "id", "v"), published, schema).select("src", "ord", "by", F.col("near").alias("distance"))
    return told.join(near, ["src", "ord"], "left").select("src", "id", "outcome", "by", "distance")
