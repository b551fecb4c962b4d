"""What the queueing pages ask of files, chains, workers and folders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States in which a chain is over for good, may be sent round again, and stages that need the extra frames.
ENDED, RETRYABLE, NEEDS_FRAMES = ("cancelled", "dead_letter"), ("dead_letter", "blocked", "ineligible", "retry_wait"), ("analyze", "derive", "import")
LISTED = ("Episode", "Special", "Normal")
LIVE_SECONDS = 600


def live_chains(jobs: DataFrame) -> DataFrame:
    """file, chain: the extractions of a file that have not ended. jobs: stage, state, file, chain."""
    return jobs.where((F.col("stage") == "extract") & ~F.col("state").isin(*ENDED) & F.col("file").isNotNull()).groupBy("file").agg(F.min("chain").alias("chain"))


def file_states(files: DataFrame, works: DataFrame, jobs: DataFrame) -> DataFrame:
    """episode, file, work, chain, open, ready of the listed episodes' files: open is free to queue; ready is open, no
    variation and the only file of its episode. files: episode, kind, file, variation, blocked; works: work, file."""
    listed = files.where(F.coalesce("kind", F.lit("Episode")).isin(*LISTED))
    sizes = listed.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    taken = works.where("file IS NOT NULL").groupBy("file").agg(F.min("work").alias("work"))
    both = listed.join(sizes, "episode").join(taken, "file", "left").join(live_chains(jobs), "file", "left")
    free = F.col("work").isNull() & F.col("chain").isNull() & ~F.col("blocked")
    return both.select("episode", "file", "work", "chain", free.alias("open"), (free & (F.col("n") == 1) & ~F.col("variation")).alias("ready"))


def retry_verdict(jobs: DataFrame, works: DataFrame) -> DataFrame:
    """id, verdict of every stage: ok, gone (nothing to retry), taken (its work id belongs to another by now) or discarded
    (its frames are gone). jobs: id, work, chain, stage, state, attempt."""
    others = jobs.where((F.col("stage") == "extract") & ~F.col("state").isin(*ENDED)).groupBy("work").agg(F.min("chain").alias("lo"), F.max("chain").alias("hi"))
    known = works.select("work").distinct().withColumn("known", F.lit(True))
    lost = jobs.where((F.col("stage") == "discard") & ((F.col("state") != "cancelled") | (F.col("attempt") > 0))).select("work").distinct().withColumn("lost", F.lit(True))
    rows = jobs.join(others, "work", "left").join(known, "work", "left").join(lost, "work", "left")
    other = F.coalesce((F.col("lo") != F.col("chain")) | (F.col("hi") != F.col("chain")), F.lit(False)) | F.coalesce("known", F.lit(False))
    verdict = (
        F.when(~F.col("state").isin(*RETRYABLE), "gone").when((F.col("stage") == "extract") & (F.col("state") == "dead_letter") & other, "taken")
        .when(F.col("stage").isin(*NEEDS_FRAMES) & F.coalesce("lost", F.lit(False)), "discarded").otherwise("ok")
    )
    return rows.select("id", verdict.alias("verdict"))


def regular_workers(workers: DataFrame, now: Column, seconds: int = LIVE_SECONDS) -> DataFrame:
    """capability, worker: the regular worker of a capability that was seen last, within `seconds`. workers: worker, capabilities, standby, seen."""
    live = workers.where(~F.col("standby") & (F.col("seen") > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))))
    return live.select("worker", "seen", F.explode("capabilities").alias("capability")).groupBy("capability").agg(F.max_by("worker", F.struct("seen", "worker")).alias("worker"))


#: Signs that a root's name begins with, signs that may follow besides, and how long it may be.
PLAIN, INSIDE, LONGEST = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "._-", 64


def source_roots(workers: DataFrame) -> DataFrame:
    """name: folders that workers of raw source have told, each once. workers: capabilities, roots (null: none told)."""
    told = workers.where(F.array_contains("capabilities", "source")).select(F.explode("roots").alias("name"))
    begins = F.position(F.substring("name", 1, 1), F.lit(PLAIN))
    good = (F.length("name") >= 1) & (F.length("name") <= LONGEST) & (begins > 0) & (F.translate("name", PLAIN + INSIDE, "") == "")
    return told.where(good).distinct()


def frames_on_disk(files: DataFrame, keep: DataFrame) -> DataFrame:
    """work, kept, kept_bytes, extra, extra_bytes of the frames in the works' folders. files: work, name, bytes; keep: work, name."""
    both = files.join(keep.select("work", "name").distinct().withColumn("k", F.lit(True)), ["work", "name"], "left")
    k = F.coalesce("k", F.lit(False))
    return both.groupBy("work").agg(F.count_if(k).alias("kept"), F.sum(F.when(k, F.col("bytes")).otherwise(0)).alias("kept_bytes"), F.count_if(~k).alias("extra"), F.sum(F.when(~k, F.col("bytes")).otherwise(0)).alias("extra_bytes"))


def held_counts(works: DataFrame, stills: DataFrame, jobs: DataFrame) -> DataFrame:
    """work, stills, picked, open: what goes with a work; 0 where nothing is. stills: work, selected; jobs: work, state."""
    s = stills.groupBy("work").agg(F.count(F.lit(1)).alias("stills"), F.count_if("selected").alias("picked"))
    j = jobs.where(~F.col("state").isin("committed", *ENDED)).groupBy("work").agg(F.count(F.lit(1)).alias("open"))
    both = works.select("work").join(s, "work", "left").join(j, "work", "left")
    return both.select("work", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stills", "picked", "open")])


def waiting_for(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """id, text: what a waiting stage waits for; no row for stages that do not wait. jobs: id, parent, stage, capability, state; live: capability."""
    p = jobs.select(F.col("id").alias("pid"), F.col("stage").alias("pstage"), F.col("state").alias("pstate"))
    up = live.select("capability").distinct().withColumn("up", F.lit(True))
    rows = jobs.where(F.col("state").isin("queued", "retry_wait")).join(p, F.col("parent") == F.col("pid"), "left").join(up, "capability", "left")
    text = (
        F.when(F.col("pid").isNotNull() & (F.col("pstate") != "committed"), F.concat(F.lit("until done: "), "pstage"))
        .when(F.col("up").isNull(), F.concat(F.lit("no worker is up: "), "capability")).when(F.col("state") == "retry_wait", "another try").otherwise("a free worker")
    )
    return rows.select("id", text.alias("text"))


def held_picks(samples: DataFrame) -> DataFrame:
    """src, shot, id, pts: of each held shot the sample nearest its middle that resolves to a frame. Shots take turns by their
    first sample's time; a frame that an earlier shot's pick has is tried no more. samples: src, shot, id, ts, pts (null: unresolved).

    Each shot's wishes are ordered by windows; only giving out the frames is one shot after another, so a source, which is
    one video of some thousand samples, is one group of its resolved wishes.
    """
    shot = Window.partitionBy("src", "shot")
    place = F.row_number().over(shot.orderBy("ts", "id")) - 1
    rows = samples.withColumns({"i": place, "n": F.count(F.lit(1)).over(shot), "first": F.min("ts").over(shot)})
    rows = rows.where("pts IS NOT NULL").select("src", "shot", "first", "id", "pts", F.abs(F.col("i") - (F.col("n") - 1) / 2).alias("off"), "i")

    def give(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, taken, done, out = pdf.sort_values(["first", "shot", "off", "i"]), set(), set(), []
        for r in pdf.itertuples():
            if r.shot not in done and r.pts not in taken:
                done.add(r.shot)
                taken.add(r.pts)
                out.append((r.src, r.shot, r.id, r.pts))
        return pd.DataFrame(out, columns=["src", "shot", "id", "pts"])

    return rows.groupBy("src").applyInPandas(give, "src long, shot long, id long, pts long")


def tally(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """src and the number of rows of each outcome, side by side. rows: src, outcome."""
    return rows.groupBy("src").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def whole_decode(planned: Column, seconds: Column, cost: float = 10.0) -> Column:
    """Whether decoding a file once is cheaper than seeking to each planned frame, each of which costs `cost` seconds of it."""
    return (seconds > 0) & (planned * cost > seconds)
