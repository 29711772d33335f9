"""Drawn strokes and crop boxes against shapes and frames that are known."""

import math

import numpy as np
import pytest

from framewright.operators import draw
from framewright.plans import stylize
from framewright.plans.crop import Crop, crops, find_crop
from framewright.plans.stylize import Pen
from framewright.sources.frames import decode_png

TURN = np.linspace(0, 2 * np.pi, 400, endpoint=False)
CIRCLE = np.stack([50 + 20 * np.cos(TURN), 50 + 20 * np.sin(TURN)], axis=1)


def test_resample_keeps_ends_and_distances():
    p = np.array([(0.0, 0.0), (3.0, 0.0), (3.0, 7.0)])
    q = draw.resample(p, False, 1.0)
    assert len(q) == 11 and (q[[0, -1]] == p[[0, 2]]).all()
    assert (draw.resample(np.ones((3, 2)), False, 1.0) == 1).all()
    ring = draw.resample(CIRCLE, True, 1.0)
    assert len(ring) == round(2 * np.pi * 20) and np.ptp(np.linalg.norm(np.diff(ring, axis=0), axis=1)) < 0.01


def test_smoothing_pins_ends_and_corners_and_leaves_lines():
    line = np.stack([np.arange(60.0), np.arange(60.0) * 0.5], axis=1)
    assert np.allclose(draw.smooth(line, False, 5.0, 1.0), draw.resample(line, False, 1.0))
    noisy = line + np.random.default_rng(1).normal(0, 0.4, line.shape)
    soft = draw.smooth(noisy, False, 5.0, 1.0)
    assert (soft[[0, -1]] == noisy[[0, -1]]).all() and np.abs(np.diff(soft, 2, axis=0)).max() < np.abs(np.diff(noisy, 2, axis=0)).max() / 4
    hook = np.concatenate([np.stack([np.arange(30.0), np.zeros(30)], axis=1), np.stack([np.full(30, 30.0), np.arange(30.0)], axis=1)])
    assert np.linalg.norm(draw.smooth(hook, False, 5.0, 1.0) - (30, 0), axis=1).min() < 0.8
    assert draw.corners(draw.resample(hook, False, 1.0), False) and not draw.corners(draw.resample(CIRCLE, True, 1.0), True)
    square = np.array([(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0)])
    soft = draw.smooth(square, True, 5.0, 1.0)
    assert all(np.linalg.norm(soft - c, axis=1).min() < 0.8 for c in square) and len(soft) == 160


def test_smooth_open_like_a_sum_over_the_reflected_line():
    p = np.random.default_rng(2).normal(size=(9, 2))
    for sigma in (0.7, 2.0, 5.0):
        reach, mirrored = int(3 * sigma + 0.5), min(math.ceil(3 * sigma), 8)

        def at(i):
            i = max(-mirrored, min(8 + mirrored, i))
            return 2 * p[0] - p[-i] if i < 0 else 2 * p[8] - p[16 - i] if i > 8 else p[i]

        w = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)}
        want = np.array([sum(w[d] * at(i + d) for d in w) / sum(w.values()) for i in range(9)])
        want[[0, -1]] = p[[0, -1]]
        assert np.allclose(draw.smooth_open(p, sigma), want)


def test_spline_goes_through_points_and_doubles_until_near():
    p = np.array([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (20.0, 10.0)])
    coarse, fine = draw.spline(p, False, 0.5, 4, 1e9), draw.spline(p, False, 0.5, 4, 0.001)
    assert len(coarse) == 13 and np.allclose(coarse[::4], p) and len(fine) > len(coarse)
    ring = draw.spline(p, True, 0.5, 4, 1e9)
    assert len(ring) == 16 and np.allclose(ring[::4], p)
    assert (draw.spline(p[:2], False, 0.5, 4, 0.1) == p[:2]).all()


def test_pieces_off_the_edge_are_run_on():
    path = np.array([(x + 0.5, y + 0.5) for x, y in [(x, 40) for x in range(0, 60)] + [(59, y) for y in range(41, 80)]])
    pen = Pen(smooth=0, epsilon=0, width=4)
    (ring, edge, line) = stylize.stroke_pieces(path, False, 100, 80, pen)[0]
    assert not ring and not edge and line[0].tolist() == [-3.0, 40.5] and line[-1].tolist() == [59.5, 83.0]
    kept = stylize.stroke_pieces(path, False, 100, 80, Pen(smooth=0, epsilon=0, draw_edge=True))
    assert [e for _, e, _ in kept] == [False] and kept[0][2][0].tolist() == [0.5, 40.5]
    flat = draw.run_on(np.array([50.0, 79.5]), np.array([1.0, 0.2]), ["bottom"], 100, 80, 4)
    assert flat.tolist() == [50.0, 83.0]


def test_closed_strokes_on_the_edge_are_cut():
    box = np.array([(x + 0.5, 20.5) for x in range(0, 30)] + [(29.5, y + 0.5) for y in range(21, 60)] + [(x + 0.5, 59.5) for x in range(28, -1, -1)] + [(0.5, y + 0.5) for y in range(58, 20, -1)])
    (piece,) = stylize.stroke_pieces(box, True, 100, 80, Pen(smooth=0, epsilon=0))
    assert not piece[0] and piece[2][0][0] < 0 and piece[2][-1][0] < 0
    both = stylize.stroke_pieces(box, True, 100, 80, Pen(smooth=0, epsilon=0, draw_edge=True))
    assert sorted(e for _, e, _ in both) == [False, True]
    edge = np.array([(0.5, y + 0.5) for y in range(5)])
    assert stylize.stroke_pieces(edge, False, 100, 80, Pen()) == []
    assert stylize.stroke_pieces(edge[:1], False, 100, 80, Pen()) == []


def test_circle_stays_round():
    ((ring, _, line),) = stylize.stroke_pieces(CIRCLE, True, 100, 100, Pen(epsilon=0.3))
    r = np.linalg.norm(line - 50, axis=1)
    assert ring and 18.5 < r.min() and r.max() < 20.5


def test_coverage_has_the_area_of_the_shape():
    line = np.array([(10.0, 20.0), (50.0, 20.0)])
    c = draw.coverage([(line, np.full(2, 6.0), False)], 64, 40, 4)
    assert c.sum() == pytest.approx(40 * 6 + np.pi * 9, rel=0.01) and c[20, 30] == 1 and c[30, 30] == 0
    cone = draw.coverage([(line, np.array([2.0, 8.0]), False)], 64, 40, 4)
    assert 40 * 5 < cone.sum() < 40 * 5 + np.pi * 16
    ring = draw.coverage([(CIRCLE, np.full(400, 3.0), True)], 100, 100, 4)
    assert ring.sum() == pytest.approx(2 * np.pi * 20 * 3, rel=0.01)
    outside = draw.coverage([(line - 500, np.full(2, 6.0), False)], 64, 40, 2)
    assert not outside.any()
    two = [(line, np.full(2, 6.0), False)]
    assert draw.ink([(1.0, two), (0.5, two)], 64, 40, 4)[20, 30] == 1
    assert draw.ink([(0.5, two), (0.5, two)], 64, 40, 4)[20, 30] == 0.75 and draw.ink([(0.5, two + two)], 64, 40, 4)[20, 30] == 0.5


def test_pieces_and_pictures_of_tables(spark):
    point = "array<struct<x double, y double>>"
    df = spark.createDataFrame([(1, 0, True, CIRCLE.tolist()), (2, 0, None, [(10.0, 10.0), (30.0, 10.0), (30.0, 40.0)]), (3, 0, False, []), (4, 1, False, None)], f"stroke long, frame int, closed boolean, points {point}")
    out = stylize.pieces(df, ["stroke", "frame"], 100, 100, Pen(epsilon=0.3))
    assert sorted((r.stroke, r.closed) for r in out.collect()) == [(1, True), (2, False)]
    (picture,) = stylize.pictures(out, 100, 100, Pen(width=3.0)).collect()
    shades = decode_png(bytes(picture.png))
    assert picture.frame == 0 and shades.shape == (100, 100, 3) and shades[50, 70].max() < 40 and shades[0, 0].min() == 255
    assert picture.ink == pytest.approx((255 - shades[..., 0].astype(float)).sum() / 255, rel=0.01)


def clip(bands=(0, 0, 0, 0), text=(0, 0), h=100, w=80, seed=0):
    r = np.random.default_rng(seed)
    mean, deviation = r.uniform(0, 255, (h, w, 3)), np.full((h, w), 20.0)
    top, bottom, left, right = bands
    for a, b in ((top, text[0]), (bottom, text[1])):
        at = slice(a, a + b) if (a, b) == (top, text[0]) else slice(h - a - b, h - a)
        deviation[at] = 0
    for at in ((slice(0, top),), (slice(h - bottom, h),), (slice(None), slice(0, left)), (slice(None), slice(w - right, w))):
        mean[at], deviation[at] = 16, 0
    return mean, deviation


@pytest.mark.parametrize(
    "bands, text, box",
    [
        ((10, 12, 0, 0), (0, 0), (0, 10, 79, 87)),
        ((0, 0, 9, 11), (0, 0), (9, 0, 68, 99)),
        ((15, 0, 0, 0), (0, 0), (0, 0, 79, 99)),
        ((7, 7, 0, 0), (0, 0), (0, 0, 79, 99)),
        ((8, 8, 0, 0), (0, 0), (0, 8, 79, 91)),
        ((10, 11, 0, 0), (6, 0), (0, 16, 79, 88)),
        ((0, 0, 0, 0), (6, 0), (0, 0, 79, 99)),
        ((46, 46, 0, 0), (0, 0), (0, 0, 79, 99)),
        ((10, 10, 0, 12), (0, 0), (0, 10, 79, 89)),
    ],
)
def test_crop_boxes(bands, text, box):
    found = find_crop(*clip(bands, text), Crop())
    assert (found["x0"], found["y0"], found["x1"], found["y1"]) == box
    assert found["text_top"] == (text[0] if bands[0] else 0)


def test_crops_of_a_table(spark):
    r = np.random.default_rng(4)
    rows = []
    for f in range(5):
        v = r.integers(0, 255, (12, 14))
        v[:3], v[-3:] = 7, 9
        rows += [("a", f, y, x, int(v[y, x])) for y in range(12) for x in range(14)]
    rows += [("b", 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "clip string, frame int, y int, x int, v int")
    got = {c.clip: c for c in crops(df, ["v"], Crop(least_band=3)).collect()}
    assert (got["a"].cut, got["a"].y0, got["a"].y1, got["a"].x0, got["a"].x1) == (True, 3, 8, 0, 13)
    assert (got["b"].x1, got["b"].y1, got["b"].top) == (0, 0, 0)
    assert crops(df.limit(0), ["v"], Crop()).count() == 0
