"""Strokes of masks, group maps and depth against shapes whose lines are known, and against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.operators import kernels, trace
from framewright.plans import vectorize
from framewright.plans.percentile import percentiles
from framewright.plans.vectorize import Lines


def mask(h, w, *lines):
    m = np.zeros((h, w), bool)
    for ys, xs in lines:
        m[ys, xs] = True
    return m


def steps_are_one(path):
    return all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:]))


def test_a_spur_goes_and_its_line_is_one():
    (path,), count = trace.trace(mask(20, 30, (10, slice(None)), (slice(8, 10), 15)), 6)
    assert path == [(10, x) for x in range(30)] and count == {"loops": 0, "spurs": 1, "fragments": 0}


def test_long_branches_meet_in_one_point():
    paths, count = trace.trace(mask(20, 30, (10, slice(2, 28)), (slice(3, 10), 15)), 6)
    assert len(paths) == 3 and count["spurs"] == 0 and all((10, 15) in (p[0], p[-1]) for p in paths)


def test_stairs_have_no_junction():
    m = np.zeros((40, 40), bool)
    for i in range(12):
        m[5 + i, 5 + i] = m[5 + i, 6 + i] = True
    assert not trace.junctions(m).any()
    (path,), _ = trace.trace(m, 6)
    assert len(path) >= 12 and steps_are_one(path)


def test_rings_close_and_fragments_go():
    ring = mask(30, 30, (2, slice(2, 5)), (slice(10, 20), [10, 19]), ([10, 19], slice(10, 20)))
    (path,), count = trace.trace(ring, 6)
    assert path[0] == path[-1] == min(path) and count == {"loops": 1, "spurs": 0, "fragments": 1}


def test_detours_in_knots_go_and_others_stay():
    a, x, hub, b = (0, 0), (0, 1), (0, 2), (1, 1)
    assert trace.without_repeats([a, x, hub, x, b], {x, hub}) == [a, x, b]
    assert trace.without_repeats([a, x, hub, x, b], {x}) == [a, x, hub, x, b]
    assert trace.without_repeats([hub, x, a, b, x, hub], {x, hub}) == [x, a, b, x]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_traces_walk_the_skeleton_and_lose_nothing_long(seed):
    r = np.random.default_rng(seed)
    m = kernels.dilate(r.random((24, 30)) < 0.06, list(kernels.EIGHT) + [(0, 0)])
    skeleton = kernels.thin(m)
    pruned = trace.prune(skeleton)
    assert not (pruned & ~skeleton).any()
    for keep in (skeleton, pruned):  # the same parts, none of them split or lost
        assert len(np.unique(kernels.label(keep.astype(int), 8)[keep])) == len(np.unique(kernels.label(m.astype(int), 8)[m]))
    paths, count = trace.trace(skeleton, 1)
    on = set(map(tuple, np.argwhere(pruned).tolist()))
    assert all(steps_are_one(p) and on.issuperset(p) for p in paths)
    knots = set(map(tuple, np.argwhere(kernels.dilate(trace.junctions(pruned), list(kernels.EIGHT) + [(0, 0)])).tolist()))
    assert on - knots <= {c for p in paths for c in p} and count["fragments"] == count["spurs"] == 0
    assert trace.trace(skeleton, 1)[0] == paths


def test_empty_mask():
    assert trace.trace(np.zeros((4, 4), bool), 3)[0] == [] and trace.silhouettes(np.zeros((4, 4), bool), 1, 1) == []


def test_silhouettes_and_holes_by_area():
    m = mask(12, 14, (slice(0, 8), slice(0, 9)), (10, 12))
    m[2:5, 3:6] = False
    m[6, 6] = False
    found = {(kind, area): path for kind, area, path in trace.silhouettes(m, 2, 2)}
    assert set(found) == {("silhouette", 62), ("hole", 9)}
    assert set(found["silhouette", 62]) == {(y, x) for y in range(8) for x in range(9) if y in (0, 7) or x in (0, 8)}
    assert set(found["hole", 9]) == {(y, x) for y in range(1, 6) for x in range(2, 7) if (y in (1, 5)) != (x in (2, 6))}
    assert ("silhouette", 1) in {f[:2] for f in trace.silhouettes(m, 1, 1)}
    assert not trace.silhouettes(m, 100, 1)  # a hole goes with its region


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_borders_hold_the_cells_beside_them(seed):
    m = np.random.default_rng(seed).random((9, 11)) < 0.6
    wide = np.pad(m, 1)
    rest, regions = kernels.label(wide.astype(int), 4), kernels.label(wide.astype(int), 8)
    beside = {}
    for y, x in np.argwhere(wide).tolist():
        for dy, dx in kernels.FOUR:
            if not wide[y + dy, x + dx]:
                beside.setdefault((int(regions[y, x]), int(rest[y + dy, x + dx])), set()).add((y - 1, x - 1))
    got = [frozenset(path) for _, _, path in trace.silhouettes(m, 1, 1)]
    holes = [frozenset(v) for (_, hole), v in beside.items() if hole]
    assert sorted(map(sorted, got[len(got) - len(holes) :])) == sorted(map(sorted, holes))
    assert len(got) - len(holes) == len(np.unique(regions[wide]))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_distance_like_brute_force(seed):
    e = np.random.default_rng(seed).random((7, 12)) < 0.08
    if not e.any():
        assert np.isinf(trace.distance(e)).all()
        return
    ys, xs = np.nonzero(e)
    y, x = np.mgrid[:7, :12]
    assert np.allclose(trace.distance(e), np.hypot(y[..., None] - ys, x[..., None] - xs).min(-1))


def cells(groups, z=None, frame=0):
    y, x = np.mgrid[: groups.shape[0], : groups.shape[1]]
    pdf = pd.DataFrame({"frame": frame, "y": y.ravel(), "x": x.ravel(), "g": groups.ravel()})
    return pdf if z is None else pdf.assign(d=z.ravel())


def test_strokes_of_a_large_frame(spark):
    g = np.zeros((480, 854), int)
    g[100:300, 200:400] = 1
    g[100:300, 400:600] = 2
    g[150:170, 250:270] = 0
    z = np.where(np.arange(854) < 300, 0.0, 5.0) * np.ones((480, 1))
    df = spark.createDataFrame(cells(g, z)).repartition(4)
    t = vectorize.clip_thresholds(df, Lines(high=99.4, low=99.1))
    (high,) = t.collect()
    assert high.n == 196 * 396 - 24 * 24 and high.t_high > 0  # eroded by a window of five, around the hole too
    out = {(r.kind, r.a, r.b): r for r in vectorize.strokes(df, Lines(), t).collect()}
    assert set(out) == {("silhouette", 0, 0), ("hole", 0, 0), ("group_boundary", 1, 2), ("occlusion", 1, 0)}
    assert len(out["silhouette", 0, 0].points) == 2 * (200 + 400) - 4 and len(out["hole", 0, 0].points) == 80
    line = out["group_boundary", 1, 2].points
    assert {p.x for p in line} <= {399.5, 400.5} and len(line) >= 190 and line[0].y < line[-1].y
    depth = out["occlusion", 1, 0]
    assert {p.x for p in depth.points} <= {299.5, 300.5} and len(depth.points) >= 180 and depth.strength > 0
    assert [r.rank for r in sorted(out.values(), key=lambda r: r.rank)] == [0, 1, 2, 3]


def test_lines_run_out_to_the_boundary_only_when_kept(spark):
    g = np.ones((60, 80), int)
    z = np.where(np.arange(80) < 40, 0.0, 5.0) * np.ones((60, 1))
    df = spark.createDataFrame(cells(g, z))
    t = spark.createDataFrame([(0.5, 0.1)], "t_high double, t_low double")

    def lengths(p):
        return [len(r.points) for r in vectorize.strokes(df, p, t).where("kind = 'occlusion'").collect()]

    (short,), (far,) = lengths(Lines(near=0.0)), lengths(Lines())
    assert short < far and lengths(Lines(least_skeleton=60)) == [] and lengths(Lines(without=(1,))) == []


def test_null_thresholds_groups_and_empty_frames(spark):
    rows = [(0, 0, 0, None, None), (0, 0, 1, 1, 1.0), (1, 0, 0, 0, 2.0), (None, 0, 0, 1, 1.0)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, g int, d double")
    p = Lines(least_region=1, erode=3)
    t = vectorize.clip_thresholds(df.where("frame is not null"), p)
    assert [tuple(r) for r in t.collect()] == [(None, None, 0)]
    assert [(r.frame, r.kind, [tuple(q) for q in r.points]) for r in vectorize.strokes(df, p, t).collect()] == [(0, "silhouette", [(1.5, 0.5)])]
    assert vectorize.strokes(df.limit(0), p, t).count() == 0


def test_percentiles_like_numpy(spark):
    r = np.random.default_rng(3)
    parts = {"a": r.normal(size=30_000), "b": np.round(r.normal(size=20_000), 1), "c": np.zeros(15_000), None: r.normal(size=3)}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in parts.items()])
    df = spark.createDataFrame(pdf.astype({"k": object}).where(pdf.notna(), None), "k string, v double").unionAll(spark.createDataFrame([("d", None)], "k string, v double"))
    wanted = {"p95": 0.95, "p50": 0.5, "p0": 0.0, "p100": 1.0}
    got = {x.k: x for x in percentiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == {"a", "b", "c", None, "d"} and got["d"].n == 0 and got["d"].p95 is None
    for k, v in parts.items():
        assert got[k].n == len(v)
        assert [got[k][n] for n in wanted] == pytest.approx([np.percentile(v, 100 * q) for q in wanted.values()])
    (one,) = percentiles(df, [], "v", {"p": 0.9}).collect()
    assert one.p == pytest.approx(np.percentile(np.concatenate(list(parts.values())), 90))


def test_stencils_and_components_of_a_large_frame(spark):
    """Frames of any size, against plain loops over some of their cells."""
    from framewright.plans import stencil
    from framewright.plans.components import components

    r = np.random.default_rng(5)
    g = np.kron(r.integers(0, 4, (48, 61)), np.ones((10, 14), int))
    z = np.round(r.normal(size=g.shape), 3)
    df = spark.createDataFrame(cells(g, z)).withColumn("g", vectorize.F.col("g").cast("int")).repartition(4)
    h, w = g.shape

    def whole(frame, value):
        out = np.zeros(g.shape)
        pdf = frame.toPandas()
        assert len(pdf) == h * w
        out[pdf.y, pdf.x] = pdf[value]
        return out

    lab = whole(components(df, 4, w), "comp")
    assert (lab == kernels.label(g, 4)).all()
    with pytest.raises(Exception, match="854"):
        components(df, 4).count()
    away = whole(stencil.boundary_distances(df), "dist")
    modes = whole(stencil.modes(df, 3), "g")
    mag = whole(stencil.gradient(df), "mag")
    some = r.integers(0, (h, w), (60, 2))
    edges = np.argwhere(trace.group_edges(g)) - 1
    for y, x in some.tolist():
        near = [int(g[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)]) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        assert modes[y, x] == max(set(near), key=lambda v: (near.count(v), v == g[y, x], -v))
        assert away[y, x] == pytest.approx(np.hypot(*(edges - (y, x)).T).min(), abs=1e-6)
        fold = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
        at = lambda dy, dx: z[fold(y + dy, h), fold(x + dx, w)]  # noqa: E731, B023
        gx = sum(k * (at(dy, 1) - at(dy, -1)) for dy, k in ((-1, 1), (0, 2), (1, 1))) / 8
        gy = sum(k * (at(1, dx) - at(-1, dx)) for dx, k in ((-1, 1), (0, 2), (1, 1))) / 8
        assert mag[y, x] == pytest.approx(np.hypot(gx, gy), abs=1e-4)
