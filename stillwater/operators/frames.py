"""Planning what to extract: shots ranked with spread in time, cumulative plans, seeded samples, colour rules, provider seam."""

from __future__ import annotations

import bisect
import heapq
import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.operators import intervals


def rank_shots(shots: DataFrame, budget: int, alpha: float = 0.5) -> DataFrame:
    """src, shot, turn: shots by score, each discounted while it is nearer in time to one ranked before than an even spacing.

    With alpha 0 it is a plain sort. Else each choice depends on the ones before, so a source is one group. What a shot is worth
    only falls while others are ranked, so shots wait in a heap under what they were last worth, and the first is measured
    anew: a choice looks at few shots. (Where a score is below 0 or none, all are measured.) shots: src, shot, mid, score, duration.
    """
    if alpha == 0:
        w = Window.partitionBy("src").orderBy(F.col("score").desc(), "mid", "shot")
        return shots.select("src", "shot", (F.row_number().over(w) - 1).cast("int").alias("turn"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "mid", "shot"], ascending=[False, True, True])
        mid, score = pdf["mid"].to_numpy(), pdf["score"].to_numpy()
        ideal = pdf["duration"].iloc[0] / budget
        if ideal > 0 and (score >= 0).all() and not np.isnan(mid).any():
            order = spread_order(mid.tolist(), score.tolist(), ideal, alpha)
            return pd.DataFrame({"src": pdf["src"].iloc[0], "shot": pdf["shot"].to_numpy()[order], "turn": range(len(order))})
        near, left, order = np.full(len(mid), np.inf), np.ones(len(mid), bool), []
        for _ in range(len(mid)):
            worth = score * np.minimum(1, near / ideal) ** alpha if ideal > 0 else score
            j = int(np.where(left, worth, -np.inf).argmax())
            order.append(j)
            left[j] = False
            near = np.minimum(near, np.abs(mid - mid[j]))
        return pd.DataFrame({"src": pdf["src"].iloc[0], "shot": pdf["shot"].to_numpy()[order], "turn": range(len(order))})

    return shots.groupBy("src").applyInPandas(choose, "src long, shot int, turn int")


def spread_order(mid: list[float], score: list[float], ideal: float, alpha: float) -> list[int]:
    """Places of shots in order of choice; of equal ones the first goes first."""
    power = math.sqrt if alpha == 0.5 else lambda x: x**alpha
    heap = [(-s, k, 0) for k, s in enumerate(score)]
    heapq.heapify(heap)
    done, order = [], []
    while heap:
        worth, k, at = heap[0]
        if at < len(order):
            i, m = bisect.bisect_left(done, mid[k]), mid[k]
            near = min(abs(m - done[j]) for j in (i - 1, i) if 0 <= j < len(done)) / ideal
            fresh = -score[k] * power(near) if near < 1 else -score[k]
            if fresh > worth:
                heapq.heapreplace(heap, (fresh, k, len(order)))
                continue
        heapq.heappop(heap)
        order.append(k)
        bisect.insort(done, mid[k])
    return order


def plan(ranked: DataFrame, budget: int, most: int, reserve: float = 1.25) -> DataFrame:
    """src, shot, planned, reason: shots in rank order while they are within the budget and their frames within `most`.

    A shot that would pass the limit is skipped and later, smaller ones are still tried, which no running sum
    expresses; a source is one group. ranked: src, shot, turn, frames.
    """
    shot_budget = int(np.ceil(budget * reserve))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, rows = pdf.sort_values(["turn", "shot"]), 0, []
        for k, r in enumerate(pdf.itertuples()):
            fits = held + r.frames <= most
            ok = fits and k < shot_budget
            held += int(r.frames) * ok
            rows.append((r.src, r.shot, ok, "" if ok else "extraction_attempt_limit" if not fits else "shot_plan_budget"))
        return pd.DataFrame(rows, columns=["src", "shot", "planned", "reason"])

    return ranked.groupBy("src").applyInPandas(choose, "src long, shot int, planned boolean, reason string")


def jittered(samples: DataFrame, seed: int = 42, share: float = 0.1) -> DataFrame:
    """Samples moved at random by at most `share` of the step, in order of time, one generator a source. samples: src, shot, k, t, step."""

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "shot", "k"])
        rng = random.Random(seed)
        pdf["t"] = [t + rng.uniform(-s * share, s * share) for t, s in zip(pdf["t"], pdf["step"], strict=True)]
        return pdf[["src", "shot", "k", "t"]]

    return samples.groupBy("src").applyInPandas(move, "src long, shot int, k int, t double")


def candidates(samples: DataFrame, approved: DataFrame, proposed: DataFrame) -> DataFrame:
    """src, id, t, status: samples that no approved interval drops, numbered in time order. samples: src, shot, k, t."""
    rows = samples.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("t", "shot", "k")).cast("long"))
    kept = intervals.status(rows.select("src", F.col("n").alias("id"), "t"), approved, proposed).withColumnRenamed("id", "n")
    both = rows.join(kept, ["src", "n"])
    w = Window.partitionBy("src").orderBy("t", "n")
    return both.select("src", F.format_string("cand-%04d", F.row_number().over(w)).alias("id"), "shot", "t", "status")


SDR, NONE = ("bt709", None), (None,)
#: A conversion, the space, transfer and primaries that it takes (None: untagged; empty: any), and whether only for 720 lines or more.
CONVERSIONS = (
    ("hdr-bt2390", (), ("smpte2084", "arib-std-b67"), (), False),
    ("sdr-bt2020", ("bt2020nc",), ("bt2020-10", "bt2020-12"), ("bt2020",), False),
    ("sdr-bt709", ("bt709",), ("bt709",), ("bt709",), False),
    ("sdr-bt709", SDR, SDR, SDR, True),
    ("sdr-bt601", ("smpte170m",), ("bt709", "smpte170m", None), ("smpte170m", None), False),
    ("sdr-bt601", ("bt470bg",), SDR, ("bt470bg", None), False),
    ("sdr-bt601", NONE, NONE, NONE, False),
)


def color_rule(space: Column, transfer: Column, primaries: Column, height: Column) -> Column:
    """The one conversion for a source's colour tags (null: untagged): the first whose row takes them; null where none does."""

    def takes(tag: Column, allowed: tuple) -> Column:
        named = [x for x in allowed if x]
        hit = F.coalesce(tag.isin(*named), F.lit(False)) if named else F.lit(not allowed)
        return hit | tag.isNull() if None in allowed else hit

    fits = [(rule, takes(space, s) & takes(transfer, t) & takes(primaries, p) & ((height >= 720) if tall else F.lit(True))) for rule, s, t, p, tall in CONVERSIONS]
    return F.coalesce(*[F.when(ok, rule) for rule, ok in fits])


def identity_problems(rows: DataFrame) -> DataFrame:
    """id, problem of source identities that couldn't be used. Rows: id, series_title, entry_type, source_filename, series_id, file_id, work_id, episode_ids."""
    need = ("series_title", "entry_type", "source_filename", "series_id", "file_id", "work_id", "episode_ids")
    said = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in need]
    said.append(F.when(~F.col("entry_type").isin("movie", "episode"), "unknown entry type"))
    said.append(F.when((F.col("entry_type") == "episode") & (F.size("episode_ids") == 0), "an episode without an id"))
    return rows.select("id", F.explode(F.array_compact(F.array(*said))).alias("problem"))


def provide(frames: DataFrame, record: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The provider seam: a function from a batch of frames to their records, run in tasks. Its model is loaded by the function."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield record(pdf)

    return frames.mapInPandas(run, schema)


def phrase_key(model: Column, preprocessing: Column, phrase: Column) -> Column:
    return F.sha2(F.concat_ws("\n", model, preprocessing, phrase).cast("binary"), 256)


def encode_missing(phrases: DataFrame, cache: DataFrame, encode: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The cache with every phrase: hits counted, and only phrases that it lacks sent to the encoder.

    phrases: key, phrase; cache: key, v, hits; encode: (key, phrase) to (key, v).
    """
    wanted = phrases.groupBy("key").agg(F.min("phrase").alias("phrase"), F.count(F.lit(1)).alias("asked"))
    new = provide(wanted.join(cache.select("key"), "key", "left_anti").select("key", "phrase"), encode, "key string, v array<float>").withColumn("hits", F.lit(0).cast("long"))
    out = cache.unionByName(new).join(wanted.select("key", "asked"), "key", "left")
    return out.select("key", "v", (F.col("hits") + F.coalesce("asked", F.lit(0))).alias("hits"))


def palette_distance(a: Column, b: Column) -> Column:
    """Half the summed difference of two arrays of shares."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda acc, v: acc + v) / 2


def compact_palette(swatches: Column, n: int = 6, accents: int = 2) -> Column:
    """The n heaviest plain swatches, then up to two accents. swatches: array<struct<hex, w, accent>>."""
    heavy = F.array_sort(swatches, lambda x, y: F.when(x["w"] > y["w"], -1).when(x["w"] < y["w"], 1).when(x["hex"] < y["hex"], -1).otherwise(1))
    return F.concat(F.slice(F.filter(heavy, lambda s: ~s["accent"]), 1, n), F.slice(F.filter(heavy, lambda s: s["accent"]), 1, accents))
