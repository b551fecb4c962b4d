"""Read model: what is visible, the library's tree, faceted exploration, review counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.operators.keep import few, kept

LATE = 1e9  # where a still without a time is sorted


def visible() -> Column:
    return F.col("selected") & (F.col("review_state") != "culled") & ~F.col("excluded")


def chronological(part: str = "work"):
    return Window.partitionBy(part).orderBy(F.col("ts").asc_nulls_last(), "id")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds place, 1 up, in the order of the given columns over all rows, without one task that holds them all.

    Rows are dealt by ranges of the order, numbered within each range and moved by the sizes of the ranges before.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = kept(dealt)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "_range").withColumn("place", F.col("_start") + F.col("_k")).drop("_range", "_start", "_k")


def overlay(machine: Column, human: Column) -> Column:
    """Machine facets under human ones; a human null or '' clears a family."""
    human = F.coalesce(human, F.create_map().cast("map<string,string>"))
    both = F.map_zip_with(machine, human, lambda k, a, b: F.when(F.map_contains_key(human, k), b).otherwise(a))
    return F.map_filter(both, lambda k, v: v.isNotNull() & (v != ""))


def overlay_tags(machine: Column, human: Column) -> Column:
    """Machine tags without those a person removed, with those they added, each once, in order. human: struct of arrays remove, add."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.array_except(F.coalesce(machine, none), F.coalesce(human["remove"], none)), F.coalesce(human["add"], none)))


def work_stills(stills: DataFrame, mode: str = "visible") -> DataFrame:
    """A work's stills in time: those that all see, all that were picked (with hidden ones), or those that were not picked."""
    scope = {"visible": visible(), "picked": F.col("selected"), "not_picked": ~F.col("selected")}[mode]
    rows = stills.where(scope)
    return rows.select("id", "work", F.row_number().over(chronological()).cast("long").alias("place"))


def counts_by_work(stills: DataFrame) -> DataFrame:
    return stills.where(visible()).groupBy("work").agg(F.count(F.lit(1)).alias("n"))


def covers(stills: DataFrame) -> DataFrame:
    """The first visible still of each work."""
    first = F.min(F.struct(F.coalesce("ts", F.lit(float("inf"))).alias("t"), F.col("id")))
    return stills.where(visible()).groupBy("work").agg(first.alias("c")).select("work", F.col("c.id").alias("id"), F.col("c.t").alias("ts"))


def tree(stills: DataFrame) -> DataFrame:
    """Visible counts of every level: franchise, season, work, and all of it (nulls)."""
    rolled = stills.where(visible()).rollup("franchise", "season", "work").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"), F.grouping_id().cast("int").alias("level"))
    return rolled.select("franchise", "season", "work", "level", "n", "latest")


def neighbours(stills: DataFrame) -> DataFrame:
    """Previous, next, position and total of each visible still in its work."""
    w = chronological()
    return stills.where(visible()).select(
        "id", "work", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"), F.row_number().over(w).cast("long").alias("position"), F.count(F.lit(1)).over(Window.partitionBy("work")).alias("total")
    )


def next_unreviewed(stills: DataFrame) -> DataFrame:
    """For each picked still that isn't hidden: the next unreviewed one of its work, and how many are left after it."""
    after = chronological().rowsBetween(1, Window.unboundedFollowing)
    todo = F.when(F.col("review_state") == "unreviewed", F.col("id"))
    return stills.where(F.col("selected") & ~F.col("excluded")).select("id", "work", F.first(todo, ignorenulls=True).over(after).alias("next"), F.count(todo).over(after).alias("left"))


def sibling_works(works: DataFrame) -> DataFrame:
    """Previous and next work of each series by episode (none last), then label. works: series, work, episode, label."""
    w = Window.partitionBy("series").orderBy(F.coalesce(F.col("episode").cast("double"), F.lit(LATE)), "label", "work")
    return works.select("series", "work", F.lag("work").over(w).alias("prev"), F.lead("work").over(w).alias("next"))


def matches(facets: Column, tags: Column | None, wanted: dict[str, str], query: str = "", tags_wanted: tuple[str, ...] = ()) -> Column:
    ok = F.lit(True)
    for k, v in wanted.items():
        ok = ok & F.coalesce(F.try_element_at(facets, F.lit(k)) == v, F.lit(False))
    if query:
        ok = ok & F.exists(tags, lambda t: F.contains(t, F.lit(query)))
    for t in tags_wanted:
        ok = ok & F.array_contains(tags, t)
    return ok


def explore(stills: DataFrame, arrived: DataFrame, wanted: dict[str, str], query: str = "", tags_wanted: tuple[str, ...] = ()) -> DataFrame:
    """Matching visible stills, newest work first, each work in its own time; `place` numbers them per work. arrived: work, arrived."""
    hits = stills.where(visible() & matches(F.col("facets"), F.col("tags") if "tags" in stills.columns else None, wanted, query, tags_wanted))
    hits = hits.join(few(arrived), "work", "left")
    return hits.select("id", "work", F.coalesce("arrived", F.lit(0)).cast("long").alias("arrived"), F.row_number().over(chronological()).cast("long").alias("place"))


def page(results: DataFrame, number: int, size: int = 60) -> DataFrame:
    """One page in reading order; a page past the end is the last. The page's rows are few, so its offset is a plain limit."""
    last = max(0, -(-results.count() // size) - 1)
    order = [F.col("arrived").desc(), "work", "place"]
    return results.orderBy(*order).offset(size * min(number, last)).limit(size)


def facet_counts(stills: DataFrame, wanted: dict[str, str], query: str = "", tags_wanted: tuple[str, ...] = ()) -> DataFrame:
    """family, value, n: for each value, how many stills meet all other families' constraints.

    One pass: a still counts in a family when it misses no constraint, or only that family's.
    """
    base = stills.where(visible() & matches(F.col("facets"), F.col("tags") if "tags" in stills.columns else None, {}, query, tags_wanted))
    misses = F.array_compact(F.array(*[F.when(~matches(F.col("facets"), None, {k: v}), F.lit(k)) for k, v in sorted(wanted.items())], F.lit(None).cast("string")))
    rows = base.select(misses.alias("misses"), F.explode("facets").alias("family", "value"))
    rows = rows.where((F.size("misses") == 0) | ((F.size("misses") == 1) & (F.col("misses")[0] == F.col("family"))))
    return rows.where("value <> ''").groupBy("family", "value").agg(F.count(F.lit(1)).alias("n"))


def tag_counts(results: DataFrame, chosen: tuple[str, ...] = (), n: int = 24) -> DataFrame:
    tags = results.select(F.explode("tags").alias("tag")).where(~F.col("tag").isin(*chosen) if chosen else F.lit(True))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tag").limit(n)


def plain(value: Column) -> Column:
    return F.lower(F.translate(value, "-_", "  "))


def interpret(stills: DataFrame, word: str, constrained: tuple[str, ...] = ()) -> DataFrame:
    """The first family, and its first value, that a typed word names."""
    pairs = stills.where(visible()).select(F.explode("facets").alias("family", "value")).distinct()
    pairs = pairs.where((plain(F.col("value")) == word.lower().replace("-", " ").replace("_", " ")) & (~F.col("family").isin(*constrained) if constrained else F.lit(True)))
    return pairs.orderBy("family", "value").limit(1)


def facet_choices(stills: DataFrame) -> DataFrame:
    """Every distinct value of a family, machine's or human's."""
    both = stills.select(F.explode("facets").alias("family", "value")).unionByName(stills.select(F.explode("facets_human").alias("family", "value")))
    return both.where("value IS NOT NULL AND value <> ''").distinct()


def facet_lists(pairs: DataFrame, families: tuple[str, ...] = ()) -> DataFrame:
    """family, values: each family's distinct values in order; `families` have a row even without a value. pairs: family, value.

    Values are of a vocabulary; copies are dropped before families are gathered, so a list is no longer than its family's words.
    """
    lists = pairs.where("value IS NOT NULL AND value <> ''").distinct().groupBy("family").agg(F.array_sort(F.collect_list("value")).alias("values"))
    asked = pairs.sparkSession.createDataFrame([(f,) for f in families], "family string")
    return lists.join(F.broadcast(asked), "family", "full").select("family", F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def reasons_in_scope(stills: DataFrame, everything: bool = False) -> DataFrame:
    scope = F.col("selected") & (F.size("reasons") > 0)
    return stills.where(scope if everything else scope & (F.col("review_state") == "unreviewed") & ~F.col("excluded"))


def exceptions(stills: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return reasons_in_scope(stills).where(F.arrays_overlap("reasons", F.array(*map(F.lit, kinds)))).select("id", "work", F.array_join(F.array_sort(F.array_distinct("reasons")), ",").alias("kinds"))


def reason_counts(stills: DataFrame) -> DataFrame:
    """How many stills have each kind of reason; a still counts once a kind."""
    return reasons_in_scope(stills).select(F.explode(F.array_distinct("reasons")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def review_counts(stills: DataFrame) -> DataFrame:
    """Per work, over picked stills."""
    state = lambda s: F.col("selected") & (F.col("review_state") == s)
    return stills.groupBy("work").agg(
        F.count_if("selected").alias("picked"), F.count_if(state("unreviewed") & ~F.col("excluded")).alias("unreviewed"), F.count_if(state("kept")).alias("kept"),
        F.count_if(state("culled")).alias("culled"), F.count_if(F.col("selected") & F.col("excluded")).alias("hidden"), F.count_if(F.col("selected") & F.col("facets_human").isNotNull()).alias("corrected"),
    )


def review_overview(stills: DataFrame) -> DataFrame:
    """Per work; culled, hidden and corrected also count stills that were not picked."""
    return stills.groupBy("work").agg(
        F.count_if("selected").alias("picked"), F.count_if(F.col("review_state") == "culled").alias("culled"), F.count_if("excluded").alias("hidden"), F.count_if(F.col("facets_human").isNotNull()).alias("corrected"),
    )


def technique_tiles(stills: DataFrame, least: int = 5, n_covers: int = 3, hidden: tuple[str, ...] = ("none-visible", "unknown", "mixed")) -> DataFrame:
    """family, value, n, covers: the first stills of up to three works for each value."""
    rows = stills.where(visible()).select("id", "work", "ts", F.explode("facets").alias("family", "value")).where(~F.col("value").isin(*hidden))
    rows = rows.groupBy("family", "value", "work").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "id")).alias("first"))
    tiles = rows.groupBy("family", "value").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("first")).alias("firsts")).where(F.col("n") >= least)
    return tiles.select("family", "value", "n", F.array_join(F.transform(F.slice("firsts", 1, n_covers), lambda c: c["id"].cast("string")), ",").alias("covers"))


def front_door(stills: DataFrame, day: int, n: int = 24, rounds: int = 4, least_ts: float = 120) -> DataFrame:
    """One still a title in turn, from a title that moves with the day, up to `rounds` times."""
    pool = stills.where(visible() & (F.col("ts").isNull() | (F.col("ts") >= least_ts)))
    pool = pool.withColumns({"at": F.row_number().over(chronological()) - 1, "held": F.count(F.lit(1)).over(Window.partitionBy("work"))})
    titles = pool.select("work").distinct()
    titles = kept(placed(titles, "work").withColumn("t", F.col("place") - 1))
    titles = titles.join(F.broadcast(titles.agg(F.count(F.lit(1)).alias("all"))))  # one row
    turn = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    picks = titles.select("work", F.pmod(F.col("t") - (day * 7) % F.col("all"), F.col("all")).alias("seat"), turn.alias("round"))
    want = F.pmod(F.lit(day * 7) + F.col("round") * 13, F.col("held"))
    hits = pool.join(few(picks), "work").where(F.col("at") == want)
    once = hits.groupBy("id", "work").agg(F.min(F.struct("round", "seat")).alias("r"))
    return once.orderBy("r.round", "r.seat").limit(n).select("id", "work", F.col("r.round").cast("long").alias("round"))


def series_keys(works: DataFrame) -> DataFrame:
    """One digest per series of every work's id and bundle. works: series, work, bundle."""
    part = F.concat_ws(":", "work", F.coalesce("bundle", F.lit("")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("work", part.alias("p")))), lambda x: x["p"]), ",")
    return works.withColumn("grp", F.coalesce(F.col("series").cast("string"), F.concat(F.lit("w:"), "work"))).groupBy("grp").agg(F.md5(listed.cast("binary")).alias("key"))


def due(works: DataFrame) -> DataFrame:
    """Works whose marks are out of date. works also has repeats_key."""
    grp = F.coalesce(F.col("series").cast("string"), F.concat(F.lit("w:"), "work"))
    return works.withColumn("grp", grp).join(series_keys(works), "grp").where(~F.col("repeats_key").eqNullSafe(F.col("key"))).select("work", "series", "key")


def settled(works: DataFrame) -> DataFrame:
    """Series whose every work has the current key, with the number of other works."""
    keyed = works.where("series IS NOT NULL").withColumn("grp", F.col("series").cast("string")).join(series_keys(works), "grp")
    return keyed.groupBy("series").agg((F.count(F.lit(1)) - 1).alias("others"), F.bool_and(F.col("repeats_key").eqNullSafe(F.col("key"))).alias("ok")).where("ok").select("series", "others")


def cullable(stills: DataFrame, works: DataFrame) -> DataFrame:
    """work, n: stills that a cull of season-wide repeats would take. stills has repeat_in (array of works)."""
    rows = stills.join(works.select("work", "series"), "work").join(settled(works), "series")
    wide = F.size("repeat_in") >= F.greatest(F.lit(2.0), F.ceil(F.col("others") / 2).cast("double"))
    take = F.col("selected") & (F.col("review_state") == "unreviewed") & ~F.col("excluded") & ~F.col("locked") & wide
    return rows.where(take).groupBy("work").agg(F.count(F.lit(1)).alias("n"))


def take_repeats(stills: DataFrame, works: DataFrame, chosen: DataFrame, at: Column) -> DataFrame:
    """stills with the season-wide repeats of the chosen works culled at one time: only picked, unreviewed ones that are
    neither hidden nor locked, in series whose marks are settled. stills has repeat_in; chosen: work."""
    others = chosen.select("work").distinct().join(works.select("work", "series"), "work").join(settled(works), "series").select("work", "others")
    rows = stills.join(others, "work", "left")
    wide = F.size("repeat_in") >= F.greatest(F.lit(2.0), F.ceil(F.col("others") / 2).cast("double"))
    take = F.col("others").isNotNull() & F.col("selected") & (F.col("review_state") == "unreviewed") & ~F.col("excluded") & ~F.col("locked") & wide
    hit = F.coalesce(take, F.lit(False))
    return rows.withColumns({"review_state": F.when(hit, "culled").otherwise(F.col("review_state")), "reviewed_at": F.when(hit, at).otherwise(F.col("reviewed_at"))}).drop("others")


def give_back(stills: DataFrame, chosen: DataFrame, at: Column) -> DataFrame:
    """Takes one such batch back: stills of the chosen works that are still culled at exactly its time."""
    rows = stills.join(chosen.select("work").distinct().withColumn("_c", F.lit(True)), "work", "left")
    hit = F.coalesce(F.col("_c") & (F.col("review_state") == "culled") & (F.col("reviewed_at") == at), F.lit(False))
    return rows.withColumns({"review_state": F.when(hit, "unreviewed").otherwise(F.col("review_state")), "reviewed_at": F.when(~hit, F.col("reviewed_at"))}).drop("_c")


def library_order(works: DataFrame, seasons: DataFrame, franchises: DataFrame) -> DataFrame:
    """franchise, season, work, place: the library in reading order. Franchises go by sort name (nulls last) and name, their
    seasons by air date (unknown last) and name, works by episode (none last) and label. Works of no known season come last.

    works: work, season, episode, label; seasons: season, franchise, air_date, name; franchises: franchise, sort_name, name.
    """
    s = seasons.select("season", "franchise", F.coalesce("air_date", F.lit("9999")).alias("air"), F.col("name").alias("season_name"))
    f = franchises.select("franchise", F.col("sort_name").isNull().alias("unsorted"), "sort_name", F.col("name").alias("franchise_name"))
    rows = works.join(s.join(f, "franchise"), "season", "left")
    rows = rows.select(
        F.col("franchise").isNull().alias("loose"), "unsorted", "sort_name", "franchise_name", F.col("franchise"), "air", "season_name", "season",
        F.coalesce(F.col("episode").cast("double"), F.lit(LATE)).alias("number"), "label", "work",
    )
    return placed(rows, *rows.columns).select("franchise", "season", "work", "place")


def attention_order(works: DataFrame) -> DataFrame:
    """work, place: works with something to review first, the newest import first, then the rest by label. works: work, label, unreviewed, imported."""
    rows = works.select((F.coalesce("unreviewed", F.lit(0)) == 0).alias("quiet"), F.when(F.col("unreviewed") > 0, -F.unix_micros("imported")).alias("age"), F.when(F.coalesce("unreviewed", F.lit(0)) == 0, F.col("label")).alias("name"), "work")
    return placed(rows, *rows.columns).select("work", "place")


def newest_first(rows: DataFrame, at: str, n: int = 12) -> DataFrame:
    """The last n rows, newest first; of one time the greater id first."""
    return rows.orderBy(F.col(at).desc(), F.col("id").desc()).limit(n)


def probes(stills: DataFrame, asked: DataFrame) -> DataFrame:
    """work, id, visible: whether each asked still can be seen; one that isn't there can't. asked: work, id."""
    seen = stills.where(visible()).select(F.col("work").alias("_w"), F.col("id").alias("_i")).distinct()
    rows = asked.select("work", "id").distinct().join(seen, (F.col("work") == F.col("_w")) & (F.col("id") == F.col("_i")), "left")
    return rows.select("work", "id", F.col("_i").isNotNull().alias("visible"))


def unplaced(works: DataFrame, seasons: DataFrame) -> DataFrame:
    """Works of no known season, which the tree lists apart: a null season is none. works: work, season; seasons: season."""
    return works.join(seasons.select("season"), "season", "left_anti")


def siblings(works: DataFrame) -> DataFrame:
    """work, sibling, name of the other works of a series; an episode goes by its own title, else by the work's. A work without a
    series has none. works: work, series, episode_title, title, place."""
    other = works.select(F.col("series").alias("_s"), F.col("work").alias("sibling"), F.coalesce("episode_title", "title").alias("name"), "place")
    return works.select("work", "series").join(other, (F.col("series") == F.col("_s")) & (F.col("work") != F.col("sibling"))).select("work", "sibling", "name", "place")


def next_anywhere(stills: DataFrame, works: DataFrame) -> DataFrame:
    """The one still to review next: of the work imported last (one without a time before all) that has any left, the earliest. works: work, imported."""
    open_ = stills.where(F.col("selected") & (F.col("review_state") == "unreviewed") & ~F.col("excluded")).join(works.select("work", "imported"), "work")
    return open_.orderBy(F.col("imported").desc_nulls_first(), "work", F.col("ts").asc_nulls_last(), "id").select("work", "id").limit(1)
