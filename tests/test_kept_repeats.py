"""Repeats kept by series, old job records, grids, proposals by hand."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.operators import grids, keep, migrate, proposals, repeats, similar

FRAME = "series int, id long, work int, ts double, v array<float>"


def files(at):
    return {os.path.relpath(os.path.join(d, f), at) for d, _, fs in os.walk(at) for f in fs if f.endswith(".parquet")}


def test_only_changed_series_are_rewritten(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 8))
    v[20:] = v[:20] + rng.normal(size=(20, 8)) / 30
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(k % 4, k, k // 20, float(k), [float(x) for x in v[k]]) for k in range(40)]
    at = keep.scratch(spark, "test-repeats").removeprefix("file://")
    plain = lambda df: sorted((r.series, r.a, r.b) for r in df.collect())
    first = [r for r in rows if r[0] != 2 or r[1] < 30] + [(7, 100, 0, 1.0, rows[0][4]), (7, 101, 1, 2.0, rows[0][4])]
    assert plain(repeats.refresh(spark.createDataFrame(first, FRAME), at)) == plain(similar.pairs(spark.createDataFrame(first, FRAME), 0.95))
    before = files(at)
    frames = spark.createDataFrame(rows[::-1], FRAME)  # another order is no change
    assert sorted(tuple(r) for r in repeats.due(frames, at).select("series", F.col("key").isNull()).collect()) == [(2, False), (7, True)]
    assert plain(repeats.refresh(frames, at)) == plain(similar.pairs(frames, 0.95)) != []
    after = files(at)
    same = lambda fs: {f for f in fs if not f.startswith(("series=2", "series=7"))}
    assert same(before) == same(after) and not {f for f in before if f.startswith("series=2")} & after
    assert repeats.due(frames, at).isEmpty()
    repeats.refresh(frames, at)
    assert files(at) == after


def test_old_records(spark):
    p = [
        {"identity": {"shoko_series_id": 4, "shoko_episode_ids": [1, 2], "shoko_file_id": None, "fixture_id": "f", "x": {"shoko_series_id": 1}}, "a": 1},
        {"identity": {"series_id": 9}, "reread": True}, {"purpose": "other"}, {"b": [1, {"shoko_series_id": 3}]}, {"reread": False},
    ]
    rows = [
        (1, 1, None, "palette", "running", "unraid", "unraid", json.dumps(p[0])), (2, 2, None, "import", "committed", "gallery", "unraid", json.dumps(p[1])), (3, 1, 1, "import", "queued", "analyze", None, json.dumps(p[2])),
        (4, 4, None, "extract", "leased", None, "x", json.dumps(p[3])), (5, 5, None, "import", "queued", "gallery", None, "not json"), (6, 6, None, "import", "queued", "gallery", None, None), (7, 7, None, "import", "queued", "gallery", None, json.dumps({"c": 1})),
        (8, 8, None, "import", "queued", "gallery", None, json.dumps(p[4])), (9, 9, None, "import", "queued", "gallery", None, "[1]"),
    ]
    frame = spark.createDataFrame(rows, "id long, chain long, parent long, stage string, state string, capability string, owner string, params string").withColumn("purpose2", F.lit("mine"))
    got = {r.id: r for r in migrate.migrate(frame).collect()}
    assert {k: json.loads(r.params) for k, r in got.items() if k not in (5, 6)} == {
        1: {"identity": {"series_id": 4, "episode_ids": [1, 2], "file_id": None, "work_id": "f", "x": {"shoko_series_id": 1}}, "a": 1, "purpose": "repalette"},
        2: {"identity": {"series_id": 9}, "reread": True, "purpose": "reread"}, 3: {"purpose": "other"}, 4: p[3], 7: {"c": 1}, 8: {"reread": False, "purpose": "reread"}, 9: [1],
    }
    assert got[5].params == "not json" and got[6].params is None and got[1].purpose2 == "mine"
    assert (got[1].capability, got[1].owner, got[2].owner, got[4].capability) == ("source", "source", "unraid", None)


def test_tilt_of_turned_bars(spark):
    r, c = np.mgrid[0:8, 0:8].astype(float)
    turned = lambda a: (0.5 + 0.4 * np.sin(1.1 * (c * np.cos(np.radians(a)) + r * np.sin(np.radians(a))))).ravel().tolist()
    rows = [(0, turned(0)), (12, turned(12)), (-20, turned(-20)), (99, [0.3] * 64), (98, None), (97, [0.1] * 9)]
    got = {x.id: x for x in grids.measure(spark.createDataFrame(rows, "id int, grid array<double>")).collect()}
    for a in (0, 12, -20):
        assert got[a].tilt == pytest.approx(a, abs=3) and got[a].coherence > 0.9
    assert (got[99].tilt, got[99].coherence, got[99].entropy, got[99].detail, got[99].symmetry) == (0, 0, 0, 0, 1)
    assert got[98].hash is got[97].hash is got[97].tilt is None and len(got[0].hash) == 64


def test_proposals(spark):
    s2, s3 = "struct<value:string,score:double>", "struct<value:string,score:double,lane:string>"
    schema = f"""id string, wd boolean, tags map<string,{s2}>, angle {s2}, card boolean, scale {s3}, head string, composition struct<value:string,score:double,basis:string>, faces int,
      people struct<value:string,score:double,tagger:string,inconsistent:boolean>, palette struct<lighting:string,lighting_score:double,color_bias:string,color_bias_score:double,saturation:string,saturation_score:double>, quality {s2}"""
    colours = ("abstain", 0.0, "cool", 0.42, "muted", 0.6)
    none = ("abstain", 0.0, "none")
    rows = [
        ("cand-0001", False, {"setting": ("exterior", 0.9)}, None, False, none, None, ("centered", 0.5, "subject"), 2, ("two", 0.7, "abstain", False), colours, ("usable", 0.35)),
        ("cand-0002", True, {"setting": ("interior", 0.8), "weather": ("none-visible", 0.64), "lighting": ("backlit", 0.51), "color_bias": ("monochrome", 0.9), "angle": ("low", 0.4)}, ("high", 0.77), True, ("extreme-wide", 0.55, "face-occupancy"), "wide", ("abstain", 0.0, "text-only-card"), None, ("one", 0.8, "one", False), colours, ("usable", 0.35)),
    ]
    evidence = spark.createDataFrame(rows, schema)
    got = {r.id: r.fields for r in proposals.fields(evidence).collect()}
    one = {k: (v.value, v.source, v.score) for k, v in got["cand-0001"].items()}
    assert one["setting"] == one["composition"] == ("abstain", "none", 0.0) and one["people"] == ("two", "faces", 0.7)
    assert one["color_bias"] == ("cool", "palette", 0.42) and one["lighting"][0] == "abstain"
    two = {k: (v.value, v.source) for k, v in got["cand-0002"].items()}
    assert two["weather"] == ("none-visible", "interior-rule") and two["lighting"] == ("backlit", "tagger") and two["color_bias"] == ("monochrome", "tagger")
    assert two["angle"] == ("abstain", "none")  # a card has no camera, whatever the classifier says
    assert two["people"] == ("one", "tagger") and got["cand-0002"]["shot_scale"].agrees is True
    scores = {(r.id, r.family): (r.label, r.score) for r in proposals.scores(evidence).collect()}
    assert len(scores) == 12
    assert scores["cand-0001", "lighting-color-character"] == ("muted", 0.51)  # the mean of 0.42 and 0.6
    assert scores["cand-0002", "lighting-color-character"] == ("monochrome", 0.67) and scores["cand-0002", "setting-time-weather"] == ("interior", 0.8)
    assert scores["cand-0001", "shot-scale"] == ("abstain", 0.0) and scores["cand-0001", "quality"] == ("usable", 0.35)
    bad = spark.createDataFrame([("cand-0001", ["usable"], "review"), ("Cand-1", ["fine"], "maybe"), (None, [], None), ("c-ab", ["usable"], "accept")], "id string, quality array<string>, disposition string")
    assert sorted((str(r.id), r.problem[:13]) for r in proposals.refused(bad).collect()) == [("Cand-1", "invalid selec"), ("Cand-1", "not a quality"), ("Cand-1", "not an opaque"), ("None", "not an opaque"), ("c-ab", "not an opaque")]
