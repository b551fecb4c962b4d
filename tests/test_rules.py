"""Column rules against truth tables, sequential operators against invariants and brute force."""

import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.functions import color, descriptor, detect, labels, text
from stillwater.operators import catalog, frames, ingest, intervals, similar, workflow
from stillwater.operators import jobs as jobs_op
from stillwater.sources import records
from stillwater.streaming import jobs


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_colours(spark):
    r = one(spark, color.hex_of(color.oklab(F.lit("#8A6D5B"))), color.color_name(color.oklab(F.lit("#000000"))), color.color_name(color.oklab(F.lit("#FFFFFF"))), color.text_on(F.lit("#000000")), color.text_on(F.lit("#FFFFFF")))
    assert tuple(r) == ("#8A6D5B", "black", "white", "#f4f4f4", "#111")


@pytest.mark.parametrize("cut", [c for c, _ in labels.FACE_CUTS])
def test_face_bands(spark, cut):
    """The value changes at the cut, and the score is lower on both sides of it than far from both cuts."""
    at = lambda x: one(spark, labels.shot_scale(F.lit("abstain"), F.lit(0.0), F.lit(x), F.lit(False), F.lit(0.0)).alias("s")).s
    below, above, far = at(cut * 0.97), at(cut * 1.03), at(0.9)
    order = [v for _, v in labels.FACE_CUTS] + ["wide"]
    assert order.index(below.value) == order.index(above.value) + 1 and at(cut).value == above.value
    assert below.score == above.score < far.score and {below.lane, above.lane} == {"face-occupancy"}


@pytest.mark.parametrize(("bands", "value"), [
    ((0.1, 0.0, 0.25, 0.16, 0.04, 0.2, 0.0, 0.25), "warm"), ((0.1, 0.0, 0.25, 0.18, 0.04, 0.2, 0.0, 0.23), "neutral"),
    ((0.0, 0.04, 0.2, 0.16, 0.6, 0.0, 0.0, 0.0), "cool"), ((0.02, 0.04, 0.2, 0.14, 0.0, 0.0, 0.6, 0.0), "mixed"), ((0.0, 0.04, 0.2, 0.2, 0.0, 0.56, 0.0, 0.0), "neutral"),
])
def test_bias(spark, bands, value):
    """On both sides of each cut: a lean of 0.35, a quarter of warm and of cool."""
    assert one(spark, labels.color_bias(F.array(*[F.lit(float(b)) for b in bands]), F.lit(0.5)).alias("b")).b.value == value


@pytest.mark.parametrize("width", [1, 319, 320, 321, 700, 961, 1919, 5000])
def test_tiers(spark, width):
    """Every tier below the width, and the width itself or the largest tier."""
    steps = (320, 640, 960, 1920)
    want = sorted({t for t in steps if t <= width} | ({width} if width < 1920 else set()))
    assert one(spark, labels.tier_widths(F.lit(width)).alias("t")).t == want


def test_text(spark):
    assert one(spark, text.clock(F.lit(59.5)), text.clock(F.lit(59.49)), text.clock(F.lit(7261.5)), text.clock(F.lit(65)), text.episode_code(F.lit(100)), text.stamp(F.lit(49049), F.lit(1), F.lit(24000))) == ("1:00", "0:59", "2:01:02", "1:05", "E100", "00h00m02s043")
    names = spark.createDataFrame([("Episode 10",), ("Episode 2",)], "n string").orderBy(text.natural_key(F.col("n")))
    assert [r.n for r in names.collect()] == ["Episode 2", "Episode 10"]


def slug_by_hand(name):
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().replace("'", "").replace("\u2019", "")
    w = re.findall("[a-z0-9]+", plain)
    w = w[1:] if len(w) > 1 and w[0] == "the" else w
    out = w[0][:61] if w else "work"
    for x in w[1:]:
        if len(out) + 1 + len(x) > 60:
            break
        out += "-" + x
    return out


def test_slugs(spark):
    names = ["The Fox’s Den: Act 3", "the", "The  !", "Crème Brûlée", "Ōkami ﬁlm №5", "Ａｂｃ１２", "ĳs Ǆ", "日本", "", "a" * 70, "the " + "word " * 20, "x" * 59 + " y", "x" * 58 + " y z", "naïve—déjà", "½ price"]
    got = [r.s for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i").select(text.slug(F.col("n")).alias("s")).collect()]
    assert got == [slug_by_hand(n) for n in names]


def test_work_ids(spark):
    rows = [("A Show", "episode", 4, None), ("A Show", "episode", 104, None), ("A Show", "episode", None, "x"), ("Film", "movie", 2, "Second Part"), ("Film", "movie", 2, "第二"), ("Film", "movie", None, "第二"), ("Film", "movie", 1, None),
            ("long " * 14, "movie", 3, "part " * 9), ("word " * 4, "movie", 3, "p" * 80), ("Clip", "clip", 1, "x")]
    got = [r.w for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, k string, e int, p string").orderBy("i").select(text.work_id(F.col("n"), F.col("k"), F.col("e"), F.col("p")).alias("w")).collect()]
    assert got[:7] == ["a-show-e04", "a-show-e104", "a-show", "film-second-part", "film-part-2", "film", "film"] and got[9] == "clip"
    assert all(len(w) <= 72 for w in got) and got[7].startswith("long-long") and got[7].endswith("part-part") and got[8].startswith("word-word") and got[8].endswith("-3")


def test_episode_names(spark):
    names = {
        "Show S2E11.mkv": 11, "Show s02 e3 extra.mkv": 3, "Show - 12 - Title 99.mkv": 12, "Show -12.mkv": 12, "Show-12.mkv": 12, "Show Episode 8 of 12.mkv": 8, "Show ep.9 2.mkv": 9, "Show E14.mkv": 14, "Show #6 1998.mkv": 6, "Show 1080p 23.mkv": 23,
        "Show 5.1 7.mkv": 7, "Show 10 bit 31.mkv": 31, "Show 1 2.mkv": None, "Show.mkv": None, "[x] Show (12).mkv": None, "Show 12345.mkv": None, "Show – 05v2.mkv": 5,
    }
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i").select("n", text.guess_episode(F.col("n")).alias("e")).collect()
    assert {r.n: r.e for r in rows} == names


def test_extras(spark):
    names = {"Show NCOP1.mkv": True, "Show OP.mkv": True, "Opera 3.mkv": False, "Show_ED2 (clean).mkv": False, "Clean Ending.mkv": True, "Clean room.mkv": False, "Special-1.mkv": True, "Menu2.mkv": False, "Trailer.mkv": True, "Show 01.mkv": False}
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string").select("n", text.looks_extra(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in rows} == names


def test_cleaned(spark):
    r = one(spark, text.sort_name(F.lit("An Owl")), text.sort_name(F.lit("Another")), text.sort_name(F.lit("the ")), text.folder_name(F.lit('a: b/"c" .')), text.folder_name(F.lit("aux")), text.clean_path(F.lit("/a//b\\c/")), text.clean_path(F.lit("a/../b")), text.clean_path(F.lit(" ")), text.clean_line(F.lit(" a\t\n b ")), text.clean_line(F.lit("x" * 201)))
    assert tuple(r) == ("Owl", "Another", "the ", "a-b-c", "aux-x", "a/b/c", None, None, "a b", None)


def test_overlay_clears(spark):
    m = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y"))
    h = F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("z"))
    assert one(spark, catalog.overlay(m, h).alias("o")).o == {"b": "y", "c": "z"}


def test_near_is_every_near_colour(spark, small):
    from stillwater.operators import palette
    from stillwater.sources.tables import swatches

    s = swatches(spark, small).where("lane = 'swatches'").limit(200).cache()
    targets = spark.createDataFrame([("#8A6D5B",), ("#204060",), ("#FFFFFF",)], "hex string")
    got = {(r.id, r.target) for r in palette.near(s, targets, 0.2).collect()}
    t = palette.with_lab(targets).select(F.col("hex").alias("t"), F.col("lab").alias("tl"))
    want = palette.with_lab(s).crossJoin(t).where(color.distance(F.col("lab"), F.col("tl")) <= 0.2)
    assert got == {(r.id, r.t) for r in want.select("id", "t").collect()} and got


@pytest.mark.parametrize(("most", "bands"), [(14, 6), (5, 6), (7, 4), (5, 3), (5, 2), (5, None)])
def test_hamming_pairs_all(spark, most, bands):
    rng = np.random.default_rng(3)
    hs = [int(x) for x in rng.integers(0, 1 << 60, 40)]
    hs += [h ^ int(sum(1 << int(b) for b in rng.choice(60, most // 2, replace=False))) for h in hs]
    df = spark.createDataFrame([*enumerate(hs), (500, hs[3]), (501, hs[3])], "id long, h long")
    got = [(r.a, r.b, r.distance) for r in similar.hamming_pairs(df, most, bands).collect()]
    want = {(i, j, (hs[i] ^ hs[j]).bit_count()) for i in range(80) for j in range(i + 1, 80) if (hs[i] ^ hs[j]).bit_count() <= most}
    assert set(got) == want and len(got) == len(want)


def test_bands_widen_with_the_table():
    assert [similar.best_bands(n, 5) for n in (1000, 10**5, 10**6, 10**8)] == [6, 3, 3, 2]


def test_families(spark):
    links = spark.createDataFrame([(1, 2), (2, 5), (5, 9), (3, 4), *[(i, i + 1) for i in range(20, 45)]], "a long, b long")
    want = {(1, 1), (2, 1), (5, 1), (9, 1), (3, 3), (4, 3)} | {(i, 20) for i in range(20, 46)}
    assert {(r.id, r.family) for r in similar.families(None, links).collect()} == want
    nodes = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4, 5, 9, 60, *range(20, 46))] + [(70, 2), (71, 77), (72, 77)], "id long, h long")
    assert {(r.id, r.family) for r in similar.families(nodes, links).collect()} == want | {(70, 1), (71, 71), (72, 71)}


def test_pairs_across_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 4, 0, float(i), [float(x) for x in v[i]]) for i in range(60)], "id long, work int, series int, ts double, v array<float>")
    got = {(r.a, r.b) for r in similar.pairs(df, 0.4, block=9).collect()}
    s = v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T
    assert got == {(i, j) for i in range(60) for j in range(60) if i % 4 < j % 4 and s[i, j] >= 0.4}


@pytest.fixture(scope="module")
def pool(spark):
    """Frames of three works with gaps in time, near twins, and missing palettes and categories."""
    rng = np.random.default_rng(12)
    rows = []
    for w, n in ((1, 40), (2, 25), (3, 5)):
        v = rng.normal(size=(n, 6))
        v[1::4] = v[::4][: len(v[1::4])] + rng.normal(size=v[1::4].shape) * 0.05
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for i in range(n):
            pal = [float(x) for x in rng.random(3)] if i % 5 else None
            rows.append((w * 100 + i, w, float(i * i % 977 + (300 if i > 20 else 0)), [float(np.float32(x)) for x in v[i]], pal, f"c{i % 4}" if i % 7 else None, float(rng.integers(0, 9)), 1300.0))
    return rows, spark.createDataFrame(rows, "id long, work int, ts double, v array<float>, pal array<double>, cat string, score double, duration double").cache()


def test_stratified_by_hand(pool):
    rows, df = pool
    for budget in (4, 9):
        got = {}
        for r in similar.stratified(df.repartition(3), budget, block=7).collect():
            got.setdefault(r.work, {})[r.turn] = r.id
        for w in (1, 2, 3):
            mine = sorted((r for r in rows if r[1] == w), key=lambda r: (r[2], r[0]))
            e = np.array([r[3] for r in mine])
            s, start, best, taken = e @ e.T, mine[0][2], np.zeros(len(mine)), []

            def worth(j):
                x = float(np.maximum(s[j] - best, 0).sum()) / len(mine)
                pals = [mine[k][4] for k in taken if mine[k][4]]
                if mine[j][4]:
                    x += 0.35 * (min(math.dist(p, mine[j][4]) for p in pals) if pals else 0.5)
                if mine[j][5] and mine[j][5] not in {mine[k][5] for k in taken}:
                    x += 0.25
                return x - 6 * max(0.0, max((s[j, k] for k in taken), default=0) - 0.9)

            cells = {}
            for j, r in enumerate(mine):
                cells.setdefault(int(min(budget - 1, (r[2] - start) / (1300 / budget))), []).append(j)
            for turn in range(min(budget, len(mine))):
                among = cells[sorted(cells)[turn]] if turn < len(cells) else range(len(mine))
                j = max((j for j in among if j not in taken), key=worth)
                taken.append(j)
                best = np.maximum(best, s[j])
            assert [got[w][t] for t in sorted(got[w])] == [mine[j][0] for j in taken]


def test_breadth_by_hand(pool):
    rows, df = pool
    for budget, alpha in ((6, 0.5), (3, 0.0)):
        picks = similar.breadth(df.repartition(3), budget, alpha).cache()
        got = {}
        for r in picks.collect():
            got.setdefault(r.work, {})[r.turn] = r.id
        gone = {r.id: (r.by, r.distance) for r in similar.displaced(df, picks).collect()}
        for w in (1, 2, 3):
            mine = sorted((r for r in rows if r[1] == w), key=lambda r: (-r[6], r[2], r[0]))
            taken = [mine[0]]
            while len(taken) < min(budget, len(mine)):
                left = [r for r in mine if r not in taken]
                value = lambda r: min(math.dist(r[3], t[3]) for t in taken) * (min(1, min(abs(r[2] - t[2]) for t in taken) / (1300 / budget)) ** alpha if alpha else 1)  # noqa: E731, B023
                taken.append(max(left, key=value))
            assert [got[w][t] for t in sorted(got[w])] == [t[0] for t in taken]
            for r in mine:
                if r not in taken:
                    t = min(taken, key=lambda t: math.dist(r[3], t[3]))  # noqa: B023
                    assert gone[r[0]][0] == t[0] and abs(gone[r[0]][1] - math.dist(r[3], t[3])) < 1e-9
                else:
                    assert r[0] not in gone


def shots(spark, n=60, sources=2):
    rng = np.random.default_rng(13)
    rows = [(s, i, float(rng.random() * 900), float(rng.integers(1, 6)), 900.0, int(rng.integers(1, 6))) for s in range(sources) for i in range(n)]
    return rows, spark.createDataFrame(rows, "src long, shot int, mid double, score double, duration double, frames int").repartition(5)


def test_ranked_shots_by_hand(spark):
    rows, df = shots(spark)
    got = {(r.src, r.turn): r.shot for r in frames.rank_shots(df, 12).collect()}
    for s in range(2):
        left, done = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[3], r[2], r[1])), []
        while left:
            near = lambda r: min((abs(r[2] - d[2]) for d in done), default=math.inf)  # noqa: E731, B023
            best = max(left, key=lambda r: r[3] * min(1, near(r) / 75) ** 0.5)
            left.remove(best)
            done.append(best)
        assert [got[s, t] for t in range(60)] == [r[1] for r in done]


def test_planned_extractions_by_hand(spark):
    rows, df = shots(spark)
    ranked = frames.rank_shots(df, 12, 0)
    got = {(r.src, r.shot): (r.planned, r.reason) for r in frames.plan(ranked.join(df.select("src", "shot", "frames"), ["src", "shot"]), 20, 55).collect()}
    for s in range(2):
        held = 0
        for k, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (-r[3], r[2], r[1]))):
            fits, ok = held + r[5] <= 55, False
            if fits and k < 25:
                held, ok = held + r[5], True
            assert got[s, r[1]] == (ok, "" if ok else "shot_plan_budget" if fits else "extraction_attempt_limit")


def test_held_picks_by_hand(spark):
    rng = np.random.default_rng(14)
    rows = [(s, int(rng.integers(0, 30)), s * 10_000 + i, float(i), int(rng.integers(0, 40)) if rng.random() < 0.7 else None) for s in range(3) for i in range(150)]
    got = {(r.src, r.shot): (r.id, r.pts) for r in workflow.held_picks(spark.createDataFrame(rows, "src long, shot long, id long, ts double, pts long").repartition(4)).collect()}
    want = {}
    for s in range(3):
        by, seen = {}, set()
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[3]):
            by.setdefault(r[1], []).append(r)
        for shot, members in by.items():
            for i in sorted(range(len(members)), key=lambda i: abs(i - (len(members) - 1) / 2)):  # noqa: B023
                if members[i][4] is not None and members[i][4] not in seen:
                    seen.add(members[i][4])
                    want[s, shot] = (members[i][2], members[i][4])
                    break
    assert got == want


def test_roots_of_long_chains(spark):
    rows = [(i, i - 1 if i % 37 else None) for i in range(200)] + [(500, 499)]
    got = {(r.id, r.root, r.depth) for r in jobs_op.roots(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == {(i, i - i % 37, i % 37) for i in range(200)} | {(500, 500, 0)}
    with pytest.raises(ValueError, match="circle"):
        jobs_op.roots(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"))


def test_intervals_of_no_rows(spark):
    none = spark.createDataFrame([], "src long, id long, s double, e double")
    spans = spark.createDataFrame([(1, 100.0)], "src long, duration double")
    assert [tuple(r) for r in intervals.free(intervals.merge(none), spans).collect()] == [(1, 0.0, 100.0)]


@pytest.mark.parametrize(
    ("title", "start", "length", "kind"),
    [("Op2 x", 700, 60, "opening_theme:named"), ("opening!", 1, 21, "opening_theme:named"), ("ED", 30, 300, "ending_theme:named"), ("Credit roll", 9, 19, None), ("Edge", 900, 84, None), ("", 360, 85, "opening_theme:length-and-position"), ("", 361, 85, None),
     ("Part", 1905, 95, "ending_theme:length-and-position"), ("Part", 1904, 96, None), ("OP", 0, 1941, None), ("op_x", 700, 60, None)],
)
def test_chapters(spark, title, start, length, kind):
    """Own chapters of a file of 2,000 seconds, on both sides of each limit."""
    assert one(spark, intervals.chapter_kind(F.lit(title), F.lit(float(start)), F.lit(float(start + length)), F.lit(2000.0)).alias("k")).k == kind


def test_import_twice_is_import_once(spark, small):
    from stillwater.sources.tables import stills

    s = stills(spark, small).select("id", *ingest.PIPELINE, *ingest.REVIEW).cache()
    run = s.where("id % 3 <> 0").withColumn("ts", F.col("ts") + 5)
    once = ingest.merge(s, run)
    twice = ingest.merge(once, run)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(once) == rows(twice)
    kept = once.join(s.select("id", F.col("review_state").alias("before")), "id")
    assert kept.where("review_state <> before").isEmpty()


def test_job_protocol():
    j = jobs.fold(jobs.Job(), [(0, 0, "queue", ""), (1, 1, "lease", ""), (2, 2, "fail", "net")])
    assert (j.state, j.attempt, j.until) == ("retry_wait", 1, 902.0)
    assert jobs.step(j, "lease", 100, "").state == "retry_wait"
    j = jobs.step(j, "lease", 902, "")
    assert jobs.step(jobs.step(j, "cancel", 903, ""), "commit", 904, "").state == "cancelled"
    assert jobs.step(j, "fail", 903, "input").state == "ineligible"
    for t in (2000.0, 4000.0):
        j = jobs.step(j, "lease", t, "")
    assert j.state == "dead_letter"


def test_stream_equals_replay(spark, small, tmp_path):
    from stillwater.plans.rules import protocol

    e = protocol(spark, small)
    e.orderBy("at").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = jobs.stream(src).writeStream.outputMode("update").format("memory").queryName("jobs_state").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(spark.table("jobs_state")) == rows(jobs.replay(e))


def test_stream_windows(spark, small, tmp_path):
    from stillwater.streaming.windows import tumbling

    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    q = tumbling(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("win").agg(F.sum("n")).first()[0] > 0


def test_records(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"bundle_id": "b", "more": 1, "candidates": [{"candidate_id": "cand-0001", "intended_pts": 1001, "time_base": "1/24000", "bytes": 3}]}')
    r = records.manifest(spark, str(tmp_path / "m.json")).first()
    assert (r.candidate_id, round(r.ts, 6)) == ("cand-0001", 0.041708)
    assert records.proposals(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "t.csv").write_text("tag_id,name,category,count\n3,logo,0,9\n")
    assert records.vocabulary(spark, str(tmp_path / "t.csv")).first().name == "logo"
    v = spark.createDataFrame([("a", "1.10.0"), ("a", "1.9.3")], "grp string, name string")
    assert records.newest_version(v).first().name == "1.10.0"
    (tmp_path / "f").mkdir()
    for n in ("b.mkv", "a.mp4", "c.txt"):
        (tmp_path / "f" / n).write_text("x")
    assert [x.name for x in records.listing(spark, str(tmp_path / "f")).collect()] == ["a.mp4", "b.mkv"]


def test_spread_ranks_every_shot(spark, small):
    from stillwater.plans import rules

    shots, got = {}, {}
    for r in rules.shot_rows(spark, small).collect():
        shots.setdefault(r.src, []).append(r)
    for r in rules.rank_shots_spread(spark, small).orderBy("src", "turn").collect():
        got.setdefault(r.src, []).append(r.shot)
    assert {src: sorted(x) for src, x in got.items()} == {src: sorted(r.shot for r in rows) for src, rows in shots.items()}
    for src, rows in shots.items():
        left, taken, order = sorted(rows, key=lambda r: (-r.score, r.mid, r.shot)), [], []
        ideal = rows[0].duration / 40
        while left and len(order) < 40:
            worth = [r.score * min(1, min((abs(r.mid - m) for m in taken), default=np.inf) / ideal) ** 0.5 for r in left]
            best = left.pop(int(np.argmax(worth)))
            taken.append(best.mid)
            order.append(best.shot)
        assert got[src][: len(order)] == order


def test_compositions_of_all_lines(spark, small):
    from stillwater.plans import rules

    got = {r.id: r.composition for r in rules.composition_verdict(spark, small).collect()}
    lines = {}
    for r in spark.read.parquet(f"{small}/lineitem.parquet").collect():
        lines.setdefault(r.l_orderkey, []).append(r)
    assert set(got) == set(lines) and "symmetrical" in got.values()
    for k, rows in lines.items():
        text = any(r.l_linenumber % 4 == 0 for r in rows) and min(r.l_discount * 60 for r in rows) < 3
        mirrored = any(r.l_linenumber % 5 == 0 for r in rows)
        assert (got[k] == "symmetrical") == (mirrored and not text) and (got[k] == "abstain" or not text)


def test_chained_suppression(spark, small):
    from stillwater.plans import rules

    def iou(a, b):
        side = lambda x: (x[3] - x[1] + 1) * (x[4] - x[2] + 1)
        inter = max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1) * max(0, min(a[4], b[4]) - max(a[2], b[2]) + 1)
        return inter / (side(a) + side(b) - inter)

    want = {}
    for r in rules.boxes(spark, small).collect():
        kept = []
        for b in sorted(map(tuple, r.boxes), key=lambda b: (-b[0], *b[1:])):
            if all(iou(k, b) <= 0.3 for k in kept):
                kept.append(b)
        want[r.id] = (len(kept), kept[0][0])
    got = {r.id: (r.n, r.best) for r in rules.suppress_boxes(spark, small).collect()}
    assert got == want and max(n for n, _ in got.values()) > 2


def test_import_meets_every_branch(spark, small):
    from stillwater.plans import rules
    from stillwater.sources.tables import stills

    old = {r.id: r for r in stills(spark, small).collect()}
    got = {r.id: r for r in rules.import_merge(spark, small).collect()}
    asked = {i for i, r in old.items() if i % 3 != 2 and r.work != "src3"}
    works = {old[i].work if i % 2 == 0 else "src0" for i in asked}
    top = max(old) + 1
    fresh, stay = {i + top for i in asked if i % 8 == 2}, {i for i in asked if i % 8 != 2}
    assert fresh and fresh == set(got) - set(old) and all(got[i].review_state == "unreviewed" and got[i].selected for i in fresh)
    assert stay <= set(got) and all((got[i].ts, got[i].review_state) == (old[i].ts + 1, old[i].review_state) for i in stay)
    left = set(old) - stay
    other, gone = {i for i in left if old[i].work not in works}, {i for i in left if old[i].work in works}
    assert other and all((got[i].ts, got[i].selected) == (old[i].ts, old[i].selected) for i in other)
    touched = {i for i in gone if old[i].review_state != "unreviewed" or old[i].locked or old[i].excluded or old[i].facets_human is not None}
    assert touched and touched == gone & set(got) and not any(got[i].selected for i in touched) and gone - touched


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_all_pages_in_natural_order(spark, sf):
    import re

    from stillwater.plans import rules

    urls = {r.page_id: r.url for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url").collect()}
    key = lambda i: (re.sub(r"[0-9]+", lambda m: m[0].lstrip("0").rjust(10, "0"), urls[i].lower()), urls[i], i)
    want = {i: k for k, i in enumerate(sorted(urls, key=key), 1)}
    out = rules.natural_order(spark, f"/root/testdata/{sf}")
    assert {r.id: r.place for r in out.collect()} == want


def test_places_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else None) for i in range(50)], "id long, n string").repartition(7)
    got = {r.id: r.place for r in catalog.placed(df, "n", "id").collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(50), key=lambda i: (i % 3 > 0, i)), 1)}
    assert catalog.placed(df.limit(0), "n", "id").count() == 0


def test_picks_of_no_frames(spark):
    none = spark.createDataFrame([], "id long, work int, series int, ts double, v array<float>")
    assert similar.stratified(none, 2).count() == similar.breadth(none, 2).count() == 0


def test_no_task_holds_a_work(spark, monkeypatch, tmp_path):
    """Products are taken of blocks, so a work of many frames is never one matrix."""
    real, log = similar.block_gains, str(tmp_path)

    def watched(x, y):
        import uuid

        open(f"{log}/{uuid.uuid4().hex}-{x.num_rows}-{y.num_rows}", "w").close()
        return real(x, y)

    monkeypatch.setattr(similar, "block_gains", watched)
    v = [(i, 0, 0, float(i), [float(i % 7), 1.0]) for i in range(400)]
    similar.stratified(spark.createDataFrame(v, "id long, work int, series int, ts double, v array<float>"), 3, 40).collect()
    sizes = [tuple(map(int, p.name.split("-")[1:])) for p in tmp_path.iterdir()]
    assert sizes and max(y for _, y in sizes) < 100 and max(x for x, _ in sizes) < 100


def written(df, what: str) -> int:
    """How often a plan computes `what`: an expression named in a lambda is computed for every element."""
    return df._jdf.queryExecution().analyzed().toString().count(what)


def test_names_are_cut_once(spark):
    df = spark.createDataFrame([("Show - 12 [x].mkv",)], "n string")
    assert written(df.select(text.guess_episode(F.col("n")).alias("e")), "regexp_extract_all(") == 1
    assert written(df.select(text.looks_extra(F.col("n")).alias("e")), "split(") == 1


def test_palette_parts_are_computed_once(spark):
    df = spark.createDataFrame([], "c array<struct<hue:double,sat:double,luma:double,weight:double,cb:double,cr:double,accent:boolean>>")
    assert written(df.select(descriptor.hue_supports(F.col("c")).alias("e")), "filter(") == 1
    assert written(df.select(descriptor.weighted_mean(F.col("c"), "cb").alias("e")), "filter(") == 1
    assert written(df.select(descriptor.strip_shares(F.col("c")).alias("e")), "transform(c#") == 1


def test_the_largest_face_is_found_once(spark):
    df = spark.createDataFrame([([(0.5, 0.0, 0.0, 9.0, 9.0), (0.9, 4.0, 4.0, 5.0, 5.0), (1.0, 5.0, 5.0, 6.0, 6.0)],)], "b array<struct<score:double,x0:double,y0:double,x1:double,y1:double>>")
    got = df.select(detect.over_centre(F.col("b"), detect.largest(F.col("b"))).alias("e"))
    assert written(got, "array_max(") == 2  # the largest box, and the best that covers it
    assert got.first().e.score == 0.9
