"""Operators on tables of their own: matching costs, resampling, windows."""

import math
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from framewright.plans import matching, metrics

POINT = "array<struct<x:double,y:double>>"


def test_chamfer_of_strokes_of_any_length(spark):
    r = random.Random(3)
    line = lambda n, at: [(at + r.uniform(0, 20), r.uniform(0, 20)) for _ in range(n)]
    rows = [(i, line(r.randrange(1, 9), 0), line(r.randrange(1, 9), 10 * (i % 4))) for i in range(60)]
    df = spark.createDataFrame(rows, f"id int, p {POINT}, q {POINT}")

    def cost(p, q):
        near = lambda a, b: sum(min(math.dist(u, v) for v in b) for u in a) / len(a)
        return (near(p, q) + near(q, p)) / 2

    got = {x.id: x.cost for x in matching.chamfer(df).collect()}
    assert got.keys() == {i for i, _, _ in rows} and all(abs(got[i] - cost(p, q)) < 1e-9 for i, p, q in rows)
    some = {x.id: x.cost for x in matching.chamfer(df, 8.0).collect()}
    assert len(some) < len(rows) and {i for i, c in got.items() if c < 8} <= set(some) and all(some[i] == got[i] for i in some)
    same = spark.createDataFrame([(i, line(4, 0), line(6, 5)) for i in range(5)], f"id int, p {POINT}, q {POINT}")
    assert all(abs(x.cost - cost([tuple(v) for v in x.p], [tuple(v) for v in x.q])) < 1e-9 for x in same.join(matching.chamfer(same), "id").collect())


def test_resampling_of_tracks_like_a_loop(spark):
    r = random.Random(5)
    rows = [(f"s{i % 3}", i // 4, r.randrange(2), 1 + i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "source string, track long, y int, w int")
    num, den = F.col("w") * F.col("y"), F.col("w")
    got = {(x.stratum, x.rep): (x.num, x.den) for x in metrics.bootstrap_sums(df, "source", "track", num, den, reps=300, seed=4).collect()}
    keys = {(x.source, x.track): x.k for x in df.select("source", "track", F.xxhash64(F.lit(4), "source", "track").alias("k")).distinct().collect()}
    want = {}
    for (s, t), k in keys.items():
        n, d = (sum(f(x) for x in rows if x[:2] == (s, t)) for f in (lambda x: x[2] * x[3], lambda x: x[3]))
        for rep, times in enumerate(metrics.draws(k, 300)):
            a, b = want.get((s, rep), (0.0, 0.0))
            want[s, rep] = (a + times * n, b + times * d)
    assert got == want
    again = {(x.stratum, x.rep): (x.num, x.den) for x in metrics.bootstrap_sums(df.repartition(7), "source", "track", num, den, reps=300, seed=4).collect()}
    assert again == got
    assert abs(np.mean([metrics.draws(k, 2000).mean() for k in keys.values()]) - 1) < 0.02 and max(metrics.draws(k, 2000).max() for k in keys.values()) > 4


def test_window_with_too_little_margin_differs(spark):
    frames = spark.createDataFrame([(c, i, float((i * 37 + c) % 101), "k") for c in range(3) for i in range(30)], "clip int, i int, v double, k string")
    assert all(x.same and x.n == 10 for x in metrics.same_in_window(frames, 5, 14, 2).collect())
    assert not any(x.same for x in metrics.same_in_window(frames, 5, 14, 1).collect())


def test_entry_without_a_library_of_the_optional_part():
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(x.startswith('op1') for x in q), 'pipeline' in q, len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 150 and out[1:3] == ["False", "False"] and int(out[3]) > 150
