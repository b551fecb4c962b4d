"""The publish loop and palettes by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stillwater.functions import picks
from stillwater.operators import palettes as pal
from stillwater.operators import publish as pub


def by_hand(frames, budget, per_shot, cross, intra):
    """One source after the other, shot by shot, frame by frame."""
    out = {}
    for src in {f["src"] for f in frames}:
        own = [f for f in frames if f["src"] == src]
        shots = {}
        for f in own:
            shots.setdefault((f["turn"], f["shot"]), []).append(f)
        done, stop = [], None
        for _, members in sorted(shots.items()):
            if stop or len(done) >= budget:
                stop = stop or pub.LIMIT
                out |= {f["id"]: (stop, None) for f in members}
                continue
            live = []
            for f in members:
                if not f["planned"]:
                    out[f["id"]], stop = (pub.PLAN, None), pub.PLAN
                elif f["blank"]:
                    out[f["id"]] = (f["blank"], None)
                else:
                    live.append(f)
            mid = min(f["t"] for f in members) / 2 + max(f["t"] for f in members) / 2
            held = 0
            for f in sorted(live, key=lambda f: (-f["detail"], abs(f["t"] - mid), f["t"], f["id"])):
                gaps = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(f["v"], g["v"], strict=True)) / len(f["v"])), k, g["id"]) for k, g in enumerate(done)]
                near = min([g for g in gaps if g[0] < 1], default=(1.0, 0, None))
                if held >= per_shot:
                    out[f["id"]] = (pub.CAP, None)
                elif len(done) >= budget:
                    out[f["id"]], stop = (pub.LIMIT, None), pub.LIMIT
                elif done and near[0] < (intra if held else cross):
                    out[f["id"]] = (pub.TWIN if held else pub.REPEAT, near[2])
                else:
                    done.append(f)
                    held += 1
                    out[f["id"]] = ("published", None)
    return out


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 12)])
def test_publish(spark, seed, block):
    rng = random.Random(seed)
    frames = []
    for k in range(120):
        src, shot = k % 3, rng.randrange(9)
        v = [round(rng.choice([0.1, 0.3, 0.55, 0.85]) + rng.choice([0, 0.03]), 3) for _ in range(3)]
        frames.append(
            dict(src=src, shot=shot, turn=shot * 5 % 9, id=k, t=float(rng.randrange(40)), detail=float(rng.randrange(4)), v=v, planned=not (src == 1 and shot * 5 % 9 > 6 and k % 2), blank="blank" if rng.random() < 0.1 else None)
        )
    frame = spark.createDataFrame(frames, "src int, shot int, turn int, id long, t double, detail double, v array<double>, planned boolean, blank string")
    for budget in (6, 500) if block > 100 else (500,):
        want = by_hand(frames, budget, 2, 0.10, 0.17)
        got = {r.id: (r.outcome, r.by) for r in pub.publish(frame, budget, block=block).collect()}
        assert got == want
    assert {o for o, _ in want.values()} >= {"published", pub.CAP, pub.TWIN, pub.REPEAT, pub.PLAN, "blank"}


def test_publish_without_frames_or_signatures(spark):
    schema = "src int, shot int, turn int, id long, t double, detail double, v array<double>, planned boolean, blank string"
    assert pub.publish(spark.createDataFrame([], schema), 5).count() == 0
    rows = [(1, 1, 1, 1, 0.0, 1.0, None, True, None), (1, 2, 2, 2, 1.0, 1.0, None, True, None), (1, 3, 3, 3, 1.0, 1.0, [0.5, 0.5], True, None), (1, 4, 4, 4, 1.0, 1.0, [0.5, 0.52], True, None)]
    got = {r.id: (r.outcome, r.by) for r in pub.publish(spark.createDataFrame(rows, schema), 5).collect()}
    assert got == {1: ("published", None), 2: ("published", None), 3: ("published", None), 4: (pub.REPEAT, 3)}


def picture(spark, *fields):
    """Fields of (number of pixels, r, g, b) as one picture."""
    return spark.createDataFrame([(1, r, g, b) for n, r, g, b in fields for _ in range(n)], "img int, r int, g int, b int")


def shown(palettes, tone, kind):
    row = palettes.where(F.col("tone") == tone).first()
    return [(c.hex, c.accent) for c in row[kind]] if row else None


def test_flat_pictures(spark):
    blue = pal.palettes(picture(spark, (40, 10, 20, 235)))
    assert shown(blue, "all", "dominant") == [("#0A14EB", False)] == shown(blue, "all", "representative")
    assert shown(blue, "shadows", "dominant") == [("#0A14EB", False)] and shown(blue, "highlights", "dominant") is None
    dark = pal.palettes(picture(spark, (9, 20, 3, 7)))
    assert shown(dark, "all", "representative") == [("#000000", False)]
    ends = pal.palettes(picture(spark, (30, 1, 2, 3), (30, 254, 253, 252)))
    assert {h for h, _ in shown(ends, "all", "representative")} == {"#000000", "#FFFFFF"}
    grey = pal.palettes(picture(spark, (30, 128, 128, 128)))
    assert shown(grey, "all", "representative") == [] and shown(grey, "all", "dominant") == [("#808080", False)]


def test_near_colours_are_one_and_thin_ones_an_accent(spark):
    near = pal.palettes(picture(spark, (50, 200, 60, 40), (40, 210, 70, 50), (30, 40, 90, 200)))
    assert [h for h, _ in shown(near, "all", "dominant")] == ["#C83C28", "#285AC8"]
    # Single greens over many bins beside a large field: together they are an accent.
    thin = [(1, 20 + k % 5, 190 + k, 30 + 4 * (k % 8)) for k in range(0, 40)]
    got = pal.palettes(picture(spark, (9000, 150, 140, 160), *thin)).where("tone = 'all'").first()
    assert [c.accent for c in got.representative] == [False, True]
    assert got.representative[1].hue == pytest.approx(120, abs=15) and 0 < got.representative[1].weight < 0.1
    assert all(not c.accent for c in got.dominant)


def test_leader_groups(spark):
    """Groups by hand: the first near one takes a bin, and its mean moves."""
    rng = random.Random(6)
    bins = [(rng.randint(1, 50), k, *(float(rng.randrange(256)) for _ in range(3))) for k in range(120)]
    groups = []
    for w, _, *c in sorted(bins, key=lambda b: (-b[0], b[1])):
        for g in groups:
            if sum((s - g[0] * x) ** 2 for s, x in zip(g[1], c, strict=True)) < g[0] ** 2 * picks.MERGE**2:
                g[0] += w
                g[1] = [s + x * w for s, x in zip(g[1], c, strict=True)]
                break
        else:
            groups.append([float(w), [x * w for x in c]])
    frame = spark.createDataFrame([(bins,)], "bins array<struct<w:long,bin:int,r:double,g:double,b:double>>").select(F.transform("bins", picks.rich).alias("bins"))
    got = frame.select(picks.groups(F.col("bins")).alias("g")).first().g
    assert [(x.w, round(x.r, 6)) for x in got] == [(int(w), round(s[0] / w, 6)) for w, s in groups]


def test_palette_distance(spark):
    kind = "array<struct<hue:double,sat:double,luma:double,weight:double>>"
    red, cyan, grey = [(0.0, 0.9, 0.4, 1.0)], [(180.0, 0.5, 0.5, 1.0)], [(0.0, 0.01, 0.5, 1.0)]
    frame = spark.createDataFrame([(1, red, red), (2, red, cyan), (3, red, grey), (4, grey, red), (5, [], [])], f"k int, a {kind}, b {kind}")
    got = {r.k: tuple(round(x, 6) for x in r.d) for r in frame.select("k", pal.palette_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got[1] == (0, 0, 0) and got[5] == (0, 0, 0)
    assert got[2] == (1.0, 1.0, -0.4)
    assert got[3] == (0.5, 0, -0.9) and got[4] == (0.5, 0, 0.9)
