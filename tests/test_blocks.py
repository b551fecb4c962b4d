"""Vectors that meet in blocks, hashes without broadcasts, ranks from a heap, lists of bundles."""

import math

import numpy as np
from pyspark.sql import functions as F

from stillwater.functions import picks
from stillwater.operators import bundles, frames, fusion, keep, repeats, similar

VECTOR = "id long, work int, series int, ts double, v array<float>"


def plan(df, of: str = "executedPlan") -> str:
    return getattr(df._jdf.queryExecution(), of)().toString()


def copies(spark, n=90):
    """Vectors of three works, each of them four times or so."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(8, 6)).astype(np.float32)
    v = base[rng.integers(0, 8, n)] * rng.choice([1, 1, 1, 2], n)[:, None]
    rows = [(i, i % 3, 0, float(i), [float(x) for x in v[i]]) for i in range(n)]
    return rows, spark.createDataFrame(rows, VECTOR).repartition(5)


def told(x, y):
    return math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)))


def nearest_by_hand(rows, taken):
    return {r[0]: min((told(r[4], p[4]), -p[0], p[0]) for p in taken if p[1] == r[1]) for r in rows}


def test_hashes_never_pass_the_driver(spark):
    at = keep.kept(spark.createDataFrame([(i, i * 37) for i in range(50)], "id long, h long"))
    assert "Broadcast" not in plan(similar.hamming_pairs(at, 5, 3))


def test_families_never_pass_the_driver(spark):
    nodes = keep.kept(spark.createDataFrame([(i, i * 37) for i in range(50)], "id long, h long"))
    assert "Broadcast" not in plan(similar.families(nodes, spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")))


def test_nearest_of_equal_picks_is_the_first_taken(spark):
    rows, df = copies(spark)
    taken = [r for r in rows if r[0] % 4 == 0]
    chosen = spark.createDataFrame([(r[1], r[0], -r[0]) for r in taken], "work int, id long, turn long")
    for block, most in ((4096, 32768), (7, 3)):
        x, y = (d.select(*c) for d, c in ((df.where("id % 4 <> 0"), ("work", "id", "v")), (df.where("id % 4 = 0"), (F.col("work").alias("w2"), F.col("id").alias("p"), (-F.col("id")).alias("turn"), F.col("v").alias("v2")))))
        met = similar.met_in_blocks(x, y, similar.block_nearest, similar.NEAR, block, most).groupBy("id").agg(F.min(F.struct("distance", "turn", "by")).alias("m")).collect()
        assert {r.id: tuple(r.m) for r in met} == nearest_by_hand([r for r in rows if r[0] % 4], taken)
    out = similar.displaced(df, chosen)
    assert {r.id: (r.distance, -r.by, r.by) for r in out.collect()} == nearest_by_hand([r for r in rows if r[0] % 4], taken)
    assert "SortAggregate" not in plan(similar.nearest(df, df.withColumn("turn", F.col("id")))).split("FlatMapCoGroupsInArrow")[1]


def test_relinked_to_the_first_taken(spark):
    rows, df = copies(spark)
    taken = [r for r in rows if r[0] % 4 == 0]
    chosen = spark.createDataFrame([(r[1], r[0], -r[0]) for r in taken], "work int, id long, turn long")
    orphans = df.where("id % 4 = 1").select("work", "id", (F.col("id") + 1).alias("by"))
    want = {k: (round(d, 6), b) for k, (d, _, b) in nearest_by_hand([r for r in rows if r[0] % 4 == 1], taken).items()}
    out = similar.relinked(orphans, df, chosen)
    assert {r.id: (r.distance, r.by) for r in out.collect()} == want and "FlatMapCoGroupsInArrow" in plan(out)


def test_metrics_in_blocks(spark):
    rows, df = copies(spark)
    chosen = [r for r in rows if r[0] % 4 == 0]
    dot = lambda x, y: sum(a * b for a, b in zip(x[4], y[4], strict=True))
    out = similar.selection_metrics(df, df.where("id % 4 = 0").select("id"))
    for r in out.collect():
        pool, own = ([x for x in s if x[1] == r.work] for s in (rows, chosen))
        assert math.isclose(r.coverage, np.mean([max(dot(x, p) for p in own) for x in pool]), abs_tol=2e-6)
        assert math.isclose(r.closest, max(dot(x, p) for x in own for p in own if x[0] != p[0]), abs_tol=2e-6)
        assert r.gap == 12
    assert "FlatMapCoGroupsInArrow" in plan(out)


def test_a_vector_is_sent_as_often_in_a_large_series(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(240, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, i % 3, 0, float(i), [float(x) for x in v[i]]) for i in range(240)], VECTOR)
    sent = lambda n: similar.in_blocks(df.where(F.col("id") < n), 5, 6).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n")).first()[0]
    assert (sent(60), sent(240)) == (6 * 60, 6 * 240)
    s = v.astype(float) @ v.astype(float).T
    got = [(r.a, r.b) for r in similar.pairs(df, 1.5, 5, 6).collect()]
    assert set(got) == {(i, j) for i in range(240) for j in range(240) if i % 3 < j % 3 and s[i, j] >= 1.5} and len(got) == len(set(got))


def test_a_series_is_written_by_many_tasks(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, i % 2, 0, float(i), [float(x) for x in v[i]]) for i in range(3000)], VECTOR)
    at = keep.scratch(spark, "test-series")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        assert repeats.refresh(df, at, 6.0).count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(at).where("wa IS NOT NULL").select(F.input_file_name()).distinct().count() > 1


def test_gains_by_slices(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    side = lambda k, **more: pa.table({"work": pa.array([1] * k, pa.int32()), "id": pa.array(range(k), pa.int64()), **more})
    v, w = rng.normal(size=(20, 3)).astype(np.float32), rng.normal(size=(30, 3)).astype(np.float32)
    x = side(20, ts=pa.array([0.0] * 20), n=pa.array([20] * 20), near=pa.array([0] * 20), extra=pa.array([0.0] * 20), v=pa.array(v.tolist(), pa.list_(pa.float32())))
    y = side(30, near2=pa.array(range(30)), v2=pa.array(w.tolist(), pa.list_(pa.float32())))
    want = np.maximum(np.rint(v.astype(float) @ w.astype(float).T * similar.UNIT).astype(np.int64) - np.arange(30), 0).sum(axis=1)
    monkeypatch.setattr(similar, "slices", lambda n, m: [slice(at, at + 7) for at in range(0, n, 7)])
    assert similar.block_gains(x, y).column("gain").to_pylist() == want.tolist()


def test_heap_ranks_as_all_measured():
    rng = np.random.default_rng(9)
    for n in (1, 2, 50, 300):
        mid, score = np.round(rng.random(n) * 90, 1), rng.integers(0, 5, n).astype(float)
        left, near, want = np.ones(n, bool), np.full(n, np.inf), []
        for _ in range(n):
            j = int(np.where(left, score * np.minimum(1, near / 7.5) ** 0.5, -np.inf).argmax())
            want.append(j)
            left[j], near = False, np.minimum(near, np.abs(mid - mid[j]))
        assert frames.spread_order(mid.tolist(), score.tolist(), 7.5, 0.5) == want


def test_lists_are_gathered_once(spark):
    row = [(1, 1, "a", "x"), (1, 2, "b", "x"), (2, 1, "a", "x"), (2, 2, None, "y"), (3, 1, None, "p"), (3, 2, None, "q"), (4, 1, "c", "c")]
    listed = spark.createDataFrame(row, "bundle long, place int, id string, name string")
    for c, kind in (("bytes", "long"), ("sha256", "string"), ("asked", "long"), ("found", "long"), ("width", "int"), ("height", "int")):
        listed = listed.withColumn(c, F.lit(None).cast(kind))
    assert {r.bundle: (r.frames, r.double) for r in bundles.lists(listed).collect()} == {1: (2, True), 2: (2, False), 3: (2, True), 4: (1, False)}


def test_people_from_rows_that_repeat_a_tag(spark):
    tags = spark.createDataFrame([(1, "1girl", 0.2), (1, "1girl", 0.9), (1, "1girl", 0.5), (2, "window", 0.9), (3, "2girls", 0.4), (3, "1boy", 0.3)], "id long, tag string, score double")
    out = fusion.people(tags)
    assert {(r.id, r.value, r.score) for r in out.collect()} == {(1, "one", 0.9), (3, "two", 0.4)}
    assert "IN (" in plan(out, "optimizedPlan") or "INSET" in plan(out, "optimizedPlan")  # tags that count nobody are not grouped


def test_heavy_bins_are_found_once(spark):
    df = spark.createDataFrame([], f"b array<{picks.BIN}>, t long")
    e = df.select(picks.representative(F.col("b"), F.col("t"), 8).alias("e"))
    assert plan(e, "analyzed").count("filter(b#") == 2  # the bins that are heavy enough, and the small ones
