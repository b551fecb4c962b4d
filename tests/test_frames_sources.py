"""Extraction planning, record files, published tables and the catalogue source."""

import json

import pytest
from pyspark.sql import functions as F

from stillwater.operators import frames
from stillwater.sources import records, sinks
from stillwater.sources.catalogue import CatalogueSource


def test_ranking(spark):
    rows = [(1, k, k * 10.0, s, 100.0) for k, s in enumerate((9.0, 8.9, 1.0, 5.0, 8.0, 2.0, 0.5, 7.0, 8.5, 3.0))]
    df = spark.createDataFrame(rows, "src long, shot int, mid double, score double, duration double")
    plain = [r.shot for r in frames.rank_shots(df, 5, 0).orderBy("turn").collect()]
    spread = [r.shot for r in frames.rank_shots(df, 5, 0.5).orderBy("turn").collect()]
    assert plain[:3] == [0, 1, 8] and spread[:2] == [0, 8] and sorted(plain) == sorted(spread)


def test_plan_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 1, 9), (1, 2, 2, 3), (1, 3, 3, 1), (1, 4, 4, 1)], "src long, shot int, turn int, frames int")
    got = {r.shot: (r.planned, r.reason) for r in frames.plan(df, 3, 9).collect()}
    assert got == {0: (True, ""), 1: (False, "extraction_attempt_limit"), 2: (True, ""), 3: (True, ""), 4: (False, "shot_plan_budget")}


def test_samples(spark):
    s = spark.createDataFrame([(1, 0, k, 10.0 * k, 10.0) for k in range(8)], "src long, shot int, k int, t double, step double")
    a, b = (sorted(map(tuple, frames.jittered(x).collect())) for x in (s, s.repartition(3)))
    assert a == b and all(abs(t - 10 * k) <= 1 for _, _, k, t in a)
    iv = "src long, id long, s double, e double, ord long"
    approved, proposed = spark.createDataFrame([(1, 5, 0.0, 9.0, 1)], iv), spark.createDataFrame([(1, 7, 30.0, 41.0, 1)], iv)
    got = {r.id: (r.t, r.status) for r in frames.candidates(s, approved, proposed).collect()}
    assert got["cand-0001"] == (20.0, "cleared") and got["cand-0002"] == (30.0, "held_unresolved") and len(got) == 6


def test_colour_rule(spark):
    rows = [("bt709", "bt709", "bt709", 480, "sdr-bt709"), (None, None, None, 480, "sdr-bt601"), (None, None, None, 720, "sdr-bt709"), ("x", None, None, 720, None), ("bt2020nc", "smpte2084", None, 2160, "hdr-bt2390")]
    df = spark.createDataFrame(rows, "s string, t string, p string, h int, want string")
    assert all(r.got == r.want for r in df.withColumn("got", frames.color_rule(*[F.col(c) for c in "stph"])).collect())


def test_palette(spark):
    s = F.array(*[F.struct(F.lit(h).alias("hex"), F.lit(w).alias("w"), F.lit(a).alias("accent")) for h, w, a in (("#1", 0.2, False), ("#2", 0.5, False), ("#3", 0.1, True))])
    r = spark.range(1).select(frames.compact_palette(s, 1).alias("p"), frames.palette_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("d")).first()
    assert [x.hex for x in r.p] == ["#2", "#3"] and r.d == 1.0


def test_publishing(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, path)
    assert sinks.publish(spark.range(3), path) and not sinks.publish(spark.range(9), path)
    assert sinks.published(spark, path).count() == 3
    assert sinks.publish(spark.range(5), path, replace=True) and sinks.published(spark, path).count() == 5
    sinks.records(spark.range(3).withColumn("a", F.lit("x")), str(tmp_path / "rec"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "rec").glob("part-*")))
    assert text.splitlines()[0] == '{"a":"x","id":0}' and len(text.splitlines()) == 3


def test_catalogue(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"series-{k}.json").write_text(json.dumps({"Total": 150, "List": [{"ID": k * 10, "Name": f"n{k}"}, {"ID": "bad"}]}))
    spark.dataSource.register(CatalogueSource)
    rows = spark.read.format("catalogue").option("path", str(tmp_path)).load().orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(10, "n1"), (20, "n2")]


def test_record_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"format": "checks-1", "checks": [{"id": "a", "work": "w", "machine": {"time": "day", "angle": "low"}, "human": {"time": None}, "sources": {"time": {"s": "tag", "p": 0.5}}}]}))
    got = {r.family: (r.machine, r.human, r.answered, r.source) for r in records.label_checks(spark, str(tmp_path / "c.json"), "checks-1").collect()}
    assert got == {"time": ("day", None, True, "tag"), "angle": ("low", None, False, None)}
    with pytest.raises(Exception, match="another format"):
        records.label_checks(spark, str(tmp_path / "c.json"), "checks-2").collect()
    row = {"candidate_id": "cand-0001", "shot_id": "shot-000", "timestamp_seconds": 1.5, "pixel": True}
    (tmp_path / "a.json").write_text(json.dumps([row]))
    (tmp_path / "b.json").write_text(json.dumps({"omitted": [row]}))
    assert records.audit(spark, str(tmp_path / "a.json")).collect() == records.audit(spark, str(tmp_path / "b.json")).collect() != []
    (tmp_path / "e").mkdir()
    for k in (1, 2):
        (tmp_path / "e" / f"{k}.json").write_text(json.dumps({"candidate_id": "x", "embedding": [float(k)]}))
    assert records.embeddings(spark, str(tmp_path / "e")).first().embedding == [1.0]
