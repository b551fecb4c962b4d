"""Browsing by colour: the cloud, picks, grades, nearest palettes.

Swatches are rows id, work, lane, rank, hex, weight; `with_lab` adds their OKLab struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.functions import color
from stillwater.operators.keep import few, kept

CELL = {"l": 0.09, "a": 0.05, "b": 0.05}
STRICT, BROAD, GRADE = 0.045, 0.09, 0.07


def with_lab(swatches: DataFrame) -> DataFrame:
    return swatches if "lab" in swatches.columns else swatches.withColumn("lab", color.oklab(F.col("hex")))


def cell(lab: Column, n: str) -> Column:
    return color.half_up(lab[n] / F.lit(CELL[n])).cast("int")


def cells(swatches: DataFrame, lane: str, least: int = 3) -> DataFrame:
    """hex, lab, weight, n of each colour cell that `least` stills share: its weighted mean colour."""
    rows = with_lab(swatches.where(F.col("lane") == lane)).withColumn("w", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.01))
    rows = rows.withColumns({f"c{n}": cell(F.col("lab"), n) for n in CELL})
    sums = rows.groupBy(*[f"c{n}" for n in CELL]).agg(F.sum("w").alias("weight"), F.count_distinct("id").alias("n"), *[F.sum(F.col("lab")[n] * F.col("w")).alias(n) for n in CELL])
    sums = sums.where(F.col("n") >= least)
    lab = F.struct(*[(F.col(n) / F.col("weight")).alias(n) for n in CELL])
    return sums.select("weight", "n", lab.alias("lab")).withColumn("hex", color.hex_of(F.col("lab")))


def within(swatches: DataFrame, targets: DataFrame, limit: float) -> DataFrame:
    """id, target, d, weight of every swatch and target colour that are within `limit`. targets: hex.

    Both sides meet by neighbouring cells, so the join is an equi-join whatever their sizes; few targets are broadcast.
    """
    span = {n: range(-int(limit / CELL[n]) - 1, int(limit / CELL[n]) + 2) for n in CELL}
    t = targets.select(F.col("hex").alias("target")).distinct().withColumn("tlab", color.oklab(F.col("target")))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in span["l"] for j in span["a"] for k in span["b"]])
    t = t.select("target", "tlab", F.explode(offsets).alias("o"))
    t = t.select("target", "tlab", *[(cell(F.col("tlab"), n) + F.col("o")[x]).alias(f"t{n}") for n, x in zip(CELL, "ijk", strict=True)])
    s = with_lab(swatches).withColumns({f"c{n}": cell(F.col("lab"), n) for n in CELL})
    t = few(t)
    both = s.join(t, [s[f"c{n}"] == t[f"t{n}"] for n in CELL]).withColumn("d", color.distance(F.col("lab"), F.col("tlab")))
    return both.where(F.col("d") <= limit).select("id", "target", "d", "weight")


def near(swatches: DataFrame, targets: DataFrame, limit: float) -> DataFrame:
    """id, target, d, weight: for each still and target colour the nearest swatch within `limit`."""
    best = within(swatches, targets, limit).groupBy("id", "target").agg(F.min(F.struct("d", (-F.col("weight")).alias("w"))).alias("b"))
    return best.select("id", "target", F.col("b.d").alias("d"), (-F.col("b.w")).alias("weight"))


def cloud(swatches: DataFrame, least: int = 3, n: int = 60) -> DataFrame:
    """hex, n, name, neutral of the colours most stills have; n is what a strict pick of the colour returns."""
    # A still's swatches lie together, so its hits are made distinct where they are found and only counts travel.
    rows = kept(with_lab(swatches.where("lane = 'swatches'").select("id", "lane", "hex", "weight").repartition("id")))
    chips = kept(cells(rows, "swatches", least).groupBy("hex").agg(F.max_by("lab", "weight").alias("lab"), F.max("weight").alias("weight")))
    hits = within(rows, chips, STRICT).select("id", "target").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    out = chips.join(hits, chips["hex"] == hits["target"]).where(F.col("n") >= least)
    return out.orderBy(F.col("n").desc(), "hex").limit(n).select("hex", "n", color.color_name(F.col("lab")).alias("name"), (color.chroma(F.col("lab")) < 0.035).alias("neutral"), "lab")


def lane_chips(swatches: DataFrame, lane: str, pool: DataFrame, keep: str | None = None, least: int = 3) -> DataFrame:
    """hex, n, tone of a lane's colours: merged over all stills, so that a colour is the same everywhere, and counted in the
    pool alone. A colour that was chosen before is kept whatever its count, also when nothing merges to it any more. pool: id."""
    chips = cells(swatches, lane, least).groupBy("hex").agg(F.max_by("lab", "weight").alias("lab"))
    if keep:
        own = swatches.sparkSession.createDataFrame([(keep,)], "hex string").withColumn("lab", color.oklab(F.col("hex")))
        chips = chips.where(F.col("hex") != keep).unionByName(own)
    mine = swatches.where(F.col("lane") == lane).join(pool.select("id").distinct(), "id", "left_semi")
    hits = near(mine, chips, GRADE).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    out = chips.join(hits, chips["hex"] == hits["target"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.where((F.col("n") >= least) | (F.col("hex") == F.lit(keep))).select("hex", "n", color.tone_name(F.col("lab")).alias("tone"))


def chip_order(chips: DataFrame) -> DataFrame:
    """hex, place: greys from dark to light, then round the hue circle in steps of 20 degrees, darker first. Chips are a short list."""
    lab = F.col("lab")
    step = F.when(F.col("neutral"), F.lit(-1)).otherwise(color.half_up(color.hue(lab) / 20)).cast("int")
    order = Window.orderBy(step, F.round(lab["l"], 9), "hex")
    return chips.select("hex", F.row_number().over(order).cast("long").alias("place"))


def pick(swatches: DataFrame, hexes: list[str], limit: float = STRICT, lane: str = "swatches") -> DataFrame:
    """id, score of the stills that have every chosen colour, by share and closeness."""
    targets = swatches.sparkSession.createDataFrame([(h,) for h in sorted(set(hexes))], "hex string")
    hits = near(swatches.where(F.col("lane") == lane), targets, limit).groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("weight") * (1 - F.col("d") / limit)).alias("score"))
    return hits.where(F.col("k") == len(set(hexes))).select("id", "score")


def tops(swatches: DataFrame) -> DataFrame:
    """id, work, sh, hi: OKLab of the first shadow and highlight of each still that has both."""
    first = with_lab(swatches.where("rank = 0 AND lane IN ('shadows', 'highlights')"))
    pair = first.groupBy("id", "work").agg(F.max(F.when(F.col("lane") == "shadows", F.col("lab"))).alias("sh"), F.max(F.when(F.col("lane") == "highlights", F.col("lab"))).alias("hi"))
    return pair.where("sh IS NOT NULL AND hi IS NOT NULL")


def mean_lab(c: str) -> Column:
    return F.struct(*[F.avg(F.col(c)[n]).alias(n) for n in "lab"])


def grade_pairs(swatches: DataFrame, n: int = 9) -> DataFrame:
    """The commonest pairs of shadow and highlight tone, with the mean colour of each side and three covers of three works."""
    rows = tops(swatches).withColumns({"shadow": color.tone_name(F.col("sh")), "highlight": color.tone_name(F.col("hi"))})
    firsts = rows.groupBy("shadow", "highlight", "work").agg(F.min("id").alias("id"))
    covers = firsts.groupBy("shadow", "highlight").agg(F.array_join(F.slice(F.array_sort(F.collect_list("id")), 1, 3), ",").alias("covers"))
    pairs = rows.groupBy("shadow", "highlight").agg(F.count(F.lit(1)).alias("n"), mean_lab("sh").alias("sh"), mean_lab("hi").alias("hi")).join(covers, ["shadow", "highlight"])
    return pairs.orderBy(F.col("n").desc(), "shadow", "highlight").limit(n).select("shadow", "highlight", "n", "covers", color.hex_of(F.col("sh")).alias("shadow_hex"), color.hex_of(F.col("hi")).alias("highlight_hex"))


def grade_pick(swatches: DataFrame, shadow: str, highlight_tone: str) -> DataFrame:
    """id, score: stills with a shadow near the colour and a first highlight of the tone."""
    dark = pick(swatches, [shadow], GRADE, "shadows")
    light = with_lab(swatches.where("lane = 'highlights' AND rank = 0")).where(color.tone_name(F.col("lab")) == highlight_tone).select("id", "weight")
    return dark.join(light, "id").select("id", (F.col("score") + F.col("weight")).alias("score"))


def tone_swatch(swatches: DataFrame, lane: str) -> DataFrame:
    """work, hex: the mean of the lane's first swatch."""
    first = with_lab(swatches.where((F.col("lane") == lane) & (F.col("rank") == 0)))
    return first.groupBy("work").agg(mean_lab("lab").alias("m")).select("work", color.hex_of(F.col("m")).alias("hex"))


def nearest(descriptors: DataFrame, target: DataFrame, n: int = 24) -> DataFrame:
    """id, distance of the palettes nearest to the target's: hue bands, median luma and saturation. Rows: id, bands, luma, sat."""
    t = F.broadcast(target.limit(1).select(F.col("id").alias("tid"), F.col("bands").alias("tb"), F.col("luma").alias("tl"), F.col("sat").alias("ts")))  # one row
    both = descriptors.join(t, F.col("id") != F.col("tid"))
    bands = F.aggregate(F.zip_with("bands", "tb", lambda x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda acc, x: acc + x)
    d = bands + F.abs(F.col("luma") - F.col("tl")) + F.abs(F.col("sat") - F.col("ts"))
    return both.select("id", F.round(d, 9).alias("distance")).orderBy("distance", "id").limit(n)
