import random

import pytest

from framewright.llm import common


def brute(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        up[hi] = lo
    return {x: root(x) for x in up}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_like_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    cases = [[(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(5, 5), (3, 9), (9, 3), (3, 9)], chain, [(-7, x) for x in range(50)] + [(49, 100), (101, 100)]]
    for edges in cases:
        got = {x.id: x.component for x in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = {x: c for x, c in brute(edges).items() if any(x in e and e[0] != e[1] for e in edges)}
        assert got == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
