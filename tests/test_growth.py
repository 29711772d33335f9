"""Work that must not grow faster than the tables."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import catalogue
from framewright.operators import kernels
from framewright.plans import matching, tracks
from framewright.streaming.tracker import Tracker

SF = "/root/testdata/sf0.001"
POINT = "array<struct<x:double,y:double>>"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plan(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@here
def test_turn_angles_builds_the_points_once(spark):
    text = plan(spark, "turn_angles")
    assert "Filter" not in text and text.count("embedding#") <= 3, text


def near(p, q):
    return (sum(min(math.dist(u, v) for v in q) for u in p) / len(p) + sum(min(math.dist(u, v) for u in p) for v in q) / len(q)) / 2


@pytest.mark.parametrize("places", [3, 9])
@pytest.mark.parametrize("limit", [math.inf, 12.0])
def test_mutual_distances_like_a_loop(places, limit):
    r = np.random.default_rng(places)
    p, q = (np.round(r.uniform(0, 9, (n, k, 2)) + r.integers(0, 3, (n, 1, 1)) * 12, places) for n, k in ((37, 5), (300, 8)))
    q[:5, :5] = p[:5]
    got, want = kernels.mutual_distances(p, q, limit), np.array([[near(a, b) for b in q] for a in p])
    assert (got[want < limit] < math.inf).all() and np.abs(got - want)[got < math.inf].max() < 1e-12
    some = np.where(np.arange(8)[None, :, None] < np.arange(300)[:, None, None] % 8 + 1, q, np.nan)
    assert np.abs(kernels.mutual_distances(p, some) - [[near(a, b[~np.isnan(b[:, 0])]) for b in some] for a in p]).max() < 1e-12


def lines(spark, seed, n, frames):
    r = random.Random(seed)
    rows = [(s % 2, r.randrange(frames), s, r.choice("ab"), [(r.uniform(0, 30), r.uniform(0, 30)) for _ in range(r.randrange(1, 5))]) for s in r.sample(range(1000), n)]
    return spark.createDataFrame(rows, f"clip long, frame int, stroke long, type string, p {POINT}"), rows


def test_assign_of_many_has_the_smallest_total():
    c = np.full((1, 3000), 2.0)
    c[0, 0], c[0, 2999] = 1.000002, 1.0
    assert kernels.assign(c, 5) == [(0, 2999)] and kernels.assign(c.T, 5) == [(2999, 0)]
    r = np.random.default_rng(4)
    hidden = r.permutation(700)
    c = r.uniform(5, 9, (700, 700))
    c[np.arange(700), hidden] = r.uniform(1, 5, 700)
    assert kernels.assign(c, 20) == [*enumerate(hidden.tolist())]


@pytest.mark.parametrize("side", [7, 512])
def test_matches_of_blocks_like_one_matrix(spark, monkeypatch, side):
    monkeypatch.setattr(matching, "SIDE", side)
    df, rows = lines(spark, 1, 90, 2)
    got = {}
    for r in matching.matched(df, df.withColumn("frame", F.col("frame") + 1), ["clip", "frame", "type"], 9.0, True).collect():
        got.setdefault((r.clip, r.type), {})[r.cur, r.prev] = r.cost
        assert r.frame == 1
    for clip, kind in [(c, t) for c in (0, 1) for t in "ab"]:
        cur, prev = (sorted((s, p) for c, f, s, t, p in rows if (c, f, t) == (clip, frame, kind)) for frame in (1, 0))
        cost = np.array([[round(near(p, q), 6) for _, q in prev] for _, p in cur])
        want = kernels.assign(cost, 9.0)
        have = got.get((clip, kind), {})
        assert len(have) == len(want) > 0 and abs(sum(have.values()) - sum(cost[i, j] for i, j in want)) < 1e-9
        at = [[s for s, _ in x] for x in (cur, prev)]
        assert all(abs(cost[at[0].index(a), at[1].index(b)] - v) < 1e-9 for (a, b), v in have.items())


@here
def test_assign_tracks_sends_blocks(spark):
    text = plan(spark, "assign_tracks")
    assert "collect_list" in text and "FlatMapGroupsInArrow [frame" in text, text


@here
def test_chamfer_cost_sends_blocks(spark):
    assert "collect_list(struct(stroke" in plan(spark, "chamfer_cost")


@here
def test_match_quality_sends_blocks(spark):
    assert "collect_list(struct(stroke" in plan(spark, "match_quality")


def test_match_quality_of_copies(spark, tmp_path):
    row = lambda i, x: (i, [float(x)] * 64, 0)
    spark.createDataFrame([row(0, 0.01), row(1, 0.01), row(20, 0.02), row(40, 0.01), row(2, 0.05)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.cur: (r.best, str(r.ratio)) for r in catalogue.QUERIES["match_quality"](spark, str(tmp_path)).collect()}
    assert got[1] == (0.0, "nan") and got[2][1] == "None"


@here
def test_nearest_match_sends_blocks(spark):
    assert "collect_list(struct(stroke" in plan(spark, "nearest_match")


@pytest.mark.parametrize("side", [5, 512])
def test_carried_ids_like_the_tracker(spark, monkeypatch, side):
    monkeypatch.setattr(matching, "SIDE", side)
    df, rows = lines(spark, 2, 120, 6)
    df, rows = df.where("not (clip = 1 and frame = 3)"), [r for r in rows if r[:2] != (1, 3)]
    want = {}
    for clip in (0, 1):
        tracker = Tracker(9.0)
        for frame in sorted({r[1] for r in rows if r[0] == clip}):
            part = sorted((r for r in rows if r[:2] == (clip, frame)), key=lambda r: r[2])
            want |= zip([r[2] for r in part], tracker.step([(r[3], np.array(r[4])) for r in part]), strict=True)
    got = {r.stroke: r.track_id for r in tracks.carried(df, 9.0).collect()}
    assert got == want and len(set(want.values())) < len(want)


@here
def test_track_ids_matches_frames_apart(spark):
    assert "FlatMapGroupsInArrow [clip" in plan(spark, "track_ids")
