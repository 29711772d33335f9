import itertools
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.functions import noise
from framewright.operators import kernels
from framewright.plans.groups import kernel_radius, kernel_rho
from framewright.plans.stencil import ellipse
from framewright.streaming.tracker import Tracker


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([4, 8]))
def test_label_like_flood_fill(seed, connectivity):
    v = np.random.default_rng(seed).integers(0, 3, (6, 9))
    lab = kernels.label(v, connectivity)
    steps = kernels.FOUR if connectivity == 4 else kernels.EIGHT
    seen = {}
    for y, x in np.ndindex(v.shape):
        if (y, x) in seen:
            continue
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if (a, b) in seen:
                continue
            seen[a, b] = y * 9 + x
            todo += [(a + dy, b + dx) for dy, dx in steps if 0 <= a + dy < 6 and 0 <= b + dx < 9 and v[a + dy, b + dx] == v[a, b]]
    assert all(lab[k] == c for k, c in seen.items())


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(1, 4))
def test_assign_like_all_permutations(seed, n, m):
    c = np.random.default_rng(seed).integers(0, 12, (n, m)).astype(float)
    got = kernels.assign(c, 9)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(c[i, j] < 9 for i, j in got)
    best = None
    for k in range(min(n, m), -1, -1):
        for rows in itertools.combinations(range(n), k):
            for cols in itertools.permutations(range(m), k):
                if all(c[i, j] < 9 for i, j in zip(rows, cols)):
                    total = sum(c[i, j] for i, j in zip(rows, cols))
                    best = total if best is None else min(best, total)
        if best is not None:
            assert len(got) == k and sum(c[i, j] for i, j in got) == best
            return


def test_assign_ties_and_nothing():
    assert kernels.assign(np.ones((2, 2)), 5) == [(0, 0), (1, 1)]
    assert kernels.assign(np.full((2, 2), 9.0), 5) == [] and kernels.assign(np.empty((0, 3)), 5) == []


def test_thin_keeps_connection_and_thins():
    m = np.zeros((12, 20), bool)
    m[3:8, 2:18] = True
    s = kernels.thin(m)
    assert s.any() and not (s & ~m).any()
    assert len(np.unique(kernels.label(s.astype(int), 8)[s])) == 1
    assert not (s[:-1, :-1] & s[1:, :-1] & s[:-1, 1:] & s[1:, 1:]).any()


def test_outline_of_a_rectangle():
    m = np.zeros((6, 7), bool)
    m[1:4, 2:6] = True
    (path,) = kernels.outline(m)
    assert path[0] == (2.5, 1.5) and len(path) == len(set(path)) == 10
    area = 0.5 * sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(path, path[1:] + path[:1]))
    assert area == 6.0  # positive: clockwise with y downwards
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert kernels.outline(one) == [[(1.5, 1.5)]]


def test_simplify_keeps_corners_within_distance():
    p = np.array([(0, 0), (1, 0.1), (2, -0.1), (3, 0), (3, 5), (3.05, 7), (3, 10)], float)
    assert kernels.simplify(p, 0.5).tolist() == [0, 3, 6]
    assert kernels.simplify(p, 0.01).tolist() == list(range(7))


def test_noise_fixed_values():
    # Equal results are equal bits.
    assert noise.lattice(noise.seed(0), np.array([0, 1, -1, 17]), np.array([0, 5, -3, 17])).tolist() == [0.09200957022353329, -0.901923659960195, 0.10248061539381315, 0.6993286043370921]
    assert float(noise.field(noise.seed(0), np.array([3.25]), np.array([-1.5]))[0]) == 0.2941145434226272


def test_noise_range_and_slabs():
    r = np.random.default_rng(1)
    x, y = r.uniform(-50, 50, 4000), r.uniform(-50, 50, 4000)
    v = noise.moving_field(5, x, y, 1.7)
    assert abs(v).max() <= 1 and abs(v.mean()) < 0.05
    assert (noise.moving_field(5, x, y, 3.0) == noise.field(5, x, y, 3)).all()
    assert noise.seed(1, 2) != noise.seed(2, 1)


def test_temporal_kernel():
    assert math.isclose(kernel_rho(0.7), 0.3 / 1.7) and kernel_radius(0.7) == 2 and kernel_radius(1) == 0 and kernel_radius(0.05) == 8


def test_ellipse():
    assert ellipse(0) == [(0, 0)] and sorted(ellipse(1)) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]


def test_tracker_ids_and_prefix():
    r = np.random.default_rng(2)
    base = [r.uniform(0, 200, (12, 2)) for _ in range(4)]
    frames = [[("line", b + t * 0.5) for b in base[: 4 - (t == 3)]] for t in range(6)]
    whole, t = [], Tracker(5.0)
    for f in frames:
        whole.append(t.step(f))
    assert whole == [[1, 2, 3, 4]] * 3 + [[1, 2, 3]] + [[1, 2, 3, 5]] * 2
    part = Tracker(5.0)
    assert [part.step(f) for f in frames[:3]] == whole[:3]
