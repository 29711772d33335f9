"""Queries that do the whole job, against loops over the rows of their views."""

import os
from collections import defaultdict

import pytest

from framewright import catalogue
from framewright.sources import views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def points(spark):
    out = defaultdict(list)
    for r in views.poly(spark, SF).orderBy("stroke", "j").collect():
        out[r.stroke].append((r.x, r.y))
    return out


def test_segment_crossings_counts_all_pieces(spark):
    def side(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return (v > 0) - (v < 0)

    def count(p):
        pairs = [(p[i], p[i + 1], p[k], p[k + 1]) for i in range(len(p) - 1) for k in range(i + 2, len(p) - 1)]
        return sum(side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0 for a, b, c, d in pairs)

    got = {r.stroke: r.crossings for r in catalogue.QUERIES["segment_crossings"](spark, SF).collect()}
    assert got == {s: count(p) for s, p in points(spark).items()} and got


def test_svg_document_writes_all_points(spark):
    got = {r.stroke: r.svg for r in catalogue.QUERIES["svg_document"](spark, SF).collect()}
    assert got == {s: '<path d="M' + " L".join(f"{x:.3f} {y:.3f}" for x, y in p) + '"/>' for s, p in points(spark).items()} and got


def test_frame_list_names_frames_of_all_orders(spark):
    got = {(r.clip, r.i, r.name) for r in catalogue.QUERIES["frame_list"](spark, SF).collect()}
    orders = views.table(spark, SF, "orders").select("o_orderkey", "o_custkey").collect()
    assert got == {(o.o_orderkey, i, f"frame_{i:05d}.png") for o in orders for i in range(3, 3 + o.o_custkey % 5)} and got


def test_jobs_by_shot_takes_all_prompts(spark):
    shots, jobs = defaultdict(list), defaultdict(list)
    for r in views.seq(spark, SF).orderBy("clip", "i").collect():
        shots[r.clip, r.i // 20].append(r.i)
        jobs[r.clip, r.i // 20, 1 + int(r.v // 1) % 3].append(f"{r.i}:{int(r.k != 'error')}")
    want = {(c, s, t, min(shots[c, s]), max(shots[c, s]), " ".join(p)) for (c, s, t), p in jobs.items()}
    got = {(r.clip, r.shot, r.target, r.lo, r.hi, r.prompts) for r in catalogue.QUERIES["jobs_by_shot"](spark, SF).collect()}
    assert got == want and got
