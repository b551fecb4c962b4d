"""Pixel measures on images made here, and review changes on a small table."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from stillwater.functions import detect
from stillwater.operators import pixels, review


def png(path, px):
    h, w, _ = px.shape
    raw = b"".join(b"\0" + px[y].astype(np.uint8).tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def flat(r, g, b, n=64):
    return np.tile(np.array([r, g, b]), (n, n, 1))


def test_images(spark, tmp_path):
    split = flat(255, 0, 0)
    split[:, 32:] = (0, 0, 255)
    noise = np.random.default_rng(1).integers(0, 256, (64, 64, 3))
    for name, px in (("red", flat(255, 0, 0)), ("black", flat(0, 0, 0)), ("split", split), ("noise", noise)):
        png(tmp_path / f"{name}.png", px)
    rows = pixels.images(spark, str(tmp_path))
    q = {r.origin.rsplit("/")[-1][:-4]: r for r in pixels.quality(rows).collect()}
    assert abs(q["red"].luma_mean - 0.2126) < 1e-9 and q["black"].luma_mean == 0 and q["black"].entropy == 0
    assert q["red"].symmetry == 1 and q["split"].symmetry < 1 and q["noise"].detail > q["split"].detail
    assert len({r.phash for r in q.values()}) >= 2
    colours = {}
    for r in pixels.dominant(pixels.color_bins(rows)).collect():
        colours.setdefault(r.origin.rsplit("/")[-1][:-4], []).append(r.hex)
    assert colours["red"] == ["#FF0000"] and set(colours["split"]) == {"#FF0000", "#0000FF"} and len(colours["noise"]) == 6


def box(score, *xy):
    return F.struct(F.lit(score).alias("score"), *[F.lit(float(v)).alias(n) for v, n in zip(xy, ("x0", "y0", "x1", "y1"), strict=True)])


def test_suppression_boundary(spark):
    """A box of half of another's pixels overlaps it by exactly a half, which is not more than a half."""
    half = F.array(box(0.9, 0, 0, 9, 9), box(0.8, 0, 0, 9, 4))
    r = spark.range(1).select(detect.suppress(half, 0.5).alias("a"), detect.suppress(half, 0.499).alias("b")).first()
    assert [x.score for x in r.a] == [0.9, 0.8] and [x.score for x in r.b] == [0.9]


def test_suppression_by_hand(spark):
    rng = np.random.default_rng(15)
    rows = []
    for i in range(40):
        at, size = rng.integers(0, 30, (9, 2)), rng.integers(3, 25, (9, 2))
        rows.append((i, [(float(k) / 10, *map(float, at[k]), *map(float, at[k] + size[k])) for k in rng.permutation(9)]))
    df = spark.createDataFrame(rows, "i int, b array<struct<score:double,x0:double,y0:double,x1:double,y1:double>>")
    got = {r.i: [x.score for x in r.k] for r in df.select("i", detect.suppress(F.col("b"), 0.3).alias("k")).collect()}
    pixels_of = lambda b: {(x, y) for x in range(int(b[1]), int(b[3]) + 1) for y in range(int(b[2]), int(b[4]) + 1)}
    for i, boxes in rows:
        held = []
        for b in sorted(boxes, reverse=True):
            p = pixels_of(b)
            if all(len(p & q) / len(p | q) <= 0.3 for _, q in held):
                held.append((b[0], p))
        assert got[i] == [s for s, _ in held]
    assert {len(k) for k in got.values()} >= {4, 5, 6}


def test_review_changes(spark):
    s = spark.createDataFrame([(1, "w", True, "unreviewed", False, False, None), (2, "w", True, "culled", False, False, {"a": "x"}), (3, "v", False, "unreviewed", True, False, None)], "id long, work string, selected boolean, review_state string, excluded boolean, locked boolean, facets_human map<string,string>")
    s = s.withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    at = F.lit("2024-01-01").cast("timestamp")
    state = lambda d: {r.id: r.review_state for r in d.collect()}
    culled = review.set_review(s, s.where("id = 1"), "culled", at)
    assert state(culled) == {1: "culled", 2: "culled", 3: "unreviewed"} and state(review.undo(culled, "culled", at)) == state(s)
    assert {r.id: r.excluded for r in review.set_flag(s, s.where("id = 2"), "excluded", True).collect()} == {1: False, 2: True, 3: True}
    sug = spark.createDataFrame([(1, "a", "y"), (2, "a", "y")], "id long, family string, value string")
    assert {r.id: r.facets_human for r in review.accept_suggestion(s, sug).collect()} == {1: {"a": "y"}, 2: {"a": "x"}, 3: None}
    fix = spark.createDataFrame([(2, {"a": None, "b": "z"})], "id long, fix map<string,string>")
    assert {r.id: r.facets_human for r in review.correct(s, fix).collect()}[2] == {"a": None, "b": "z"}
    pinned = review.pin(s, spark.createDataFrame([(3, "v"), (9, "v")], "id long, work string")).collect()
    assert {r.id: (r.locked, r.selected) for r in pinned} == {1: (False, True), 2: (False, True), 3: (True, False), 9: (True, False)}
    t = s.withColumn("tiers", F.when(F.col("id") == 3, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))))
    locked, refused = review.set_locks(t, t, t.where("id = 3"))
    assert {r.id: r.locked for r in locked.collect()} == {1: True, 2: True, 3: False} and [r.id for r in refused.collect()] == [3]


def test_local_ids(spark):
    known = spark.createDataFrame([("Old Show", -3), ("Far", 12)], "name string, id long")
    names = spark.createDataFrame([("old show",), ("New",), ("NEW",), ("Another",)], "name string")
    got = {r.name.lower(): r.id for r in review.new_local(names, known).collect()}
    assert got["old show"] == -3 and sorted([got["new"], got["another"]]) == [-5, -4]


def test_tokens_and_renames(spark):
    f = spark.createDataFrame([("w", 1, True), ("w", 2, False)], "work string, id long, keep boolean")
    a = review.confirm_token(f).first().token
    assert a == review.confirm_token(f.repartition(3)).first().token and len(a) == 32 and a != review.confirm_token(f.withColumn("keep", F.lit(True))).first().token
    r = spark.createDataFrame([(["old", "same"],)], "tags array<string>")
    assert review.rename_values(r, "tags", {"old": "new"}).first().tags == ["new", "same"]
