import itertools
import random

import pytest

from framewright.llm import decontaminate as m
from tests.llm.helpers import ODD, docs, prose, rows

ITEM = prose(50, 30)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as start", "2 as hash")


def changed(text, every):
    return " ".join(f"x{i}" if i % every == every - 1 else w for i, w in enumerate(text.split()))


def test_finds_exact_and_substituted_passages_only(spark):
    data = [(1, prose(1, 40) + " " + ITEM + " " + prose(2, 40)), (2, prose(3, 9) + "\n" + changed(ITEM, 6).upper() + "!"), (3, changed(ITEM, 3)), (4, prose(4, 200)), (5, " ".join(ITEM.split()[:12])), (6, ITEM), (7, ITEM[len(ITEM.split()[0]) + 1 :])]
    got = rows(m.overlaps(docs(spark, data), bench(spark, [(0, ITEM), (1, "too short"), (2, None), (None, ITEM)])), "doc_id", "item_id", "start", "n_words", "n_equal")
    assert got == [(1, 0, 40, 30, 30), (2, 0, 9, 30, 25), (6, 0, 0, 30, 30), (7, 0, -1, 30, 29)]


def test_short_items_and_ties(spark):
    data = [(1, "a b c d e f g h"), (2, "q r s t u q r s t u")]
    got = rows(m.overlaps(docs(spark, data), bench(spark, [(0, "b c d e f"), (1, "Q, r. s t u"), (2, "B C D E F")])), "doc_id", "item_id", "start", "n_equal")
    assert got == [(1, 0, 1, 5), (1, 2, 1, 5), (2, 1, 0, 5)]


def test_shuffled_side_gives_the_same(spark, monkeypatch):
    data = [(i, prose(i, 30) + " " + (ITEM if i % 3 == 0 else "")) for i in range(30)]
    want = rows(m.overlaps(docs(spark, data), bench(spark, [(0, ITEM)])), "doc_id", "item_id", "start")
    monkeypatch.setattr("framewright.llm.common.BROADCAST_BYTES", -1)
    assert rows(m.overlaps(docs(spark, data), bench(spark, [(0, ITEM)])), "doc_id", "item_id", "start") == want and len(want) == 10


def test_odd_rows(spark):
    b = bench(spark, [(0, ITEM)])
    d = docs(spark, [*ODD, (None, ITEM), (20, ITEM), (20, ITEM)])
    assert rows(m.overlaps(d, b), "doc_id", "item_id") == [(20, 0), (None, 0)]
    kept = m.clean(d, b)
    assert kept.columns == d.columns and kept.count() == len(ODD)
    assert m.clean(d, bench(spark, [])).count() == len(ODD) + 3 and m.overlaps(docs(spark, []), b).count() == 0


def brute(data, items):
    """All placements of all items."""
    out = []
    for i, text in data:
        w = text.lower().split()
        for j, item in items:
            v = item.lower().split()
            best = max((sum(0 <= s + x < len(w) and w[s + x] == y for x, y in enumerate(v)), -s) for s in range(-len(v), len(w) + 1))
            if best[0] >= 0.8 * len(v):
                out.append((i, j, -best[1], best[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [5, 6, 7, 8, 10, 12, 15])
def test_every_pattern_of_a_fifth_substituted(spark, n):
    item = prose(700 + n, n)
    data = []
    for places in itertools.combinations(range(n), n // 5):
        w = item.split()
        for p in places:
            w[p] = f"x{p}"
        data.append((len(data), f"some words {' '.join(w)} and more"))
    got = rows(m.overlaps(docs(spark, data, clash=False), bench(spark, [(0, item)])), "doc_id", "n_equal")
    assert got == sorted(((i, n - n // 5) for i, _ in data), key=str)


def test_like_all_placements(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(5, 40)))) for i in range(12)]
    data = []
    for i in range(60):
        w = r.choice(items)[1].split()
        for _ in range(r.randrange(0, 2 + len(w) // 4)):
            w[r.randrange(len(w))] = r.choice(words)
        cut = r.choice([0, 0, 1, 3])
        data.append((i, " ".join([r.choice(words) for _ in range(r.randrange(6))] + w[cut:] + [r.choice(words) for _ in range(r.randrange(6))])))
    got = rows(m.overlaps(docs(spark, data, clash=False), bench(spark, items)), "doc_id", "item_id", "start", "n_equal")
    assert got == brute(data, items) and len(got) > 30


def test_parameters_beyond_the_masks(spark):
    with pytest.raises(ValueError):
        m.overlaps(docs(spark, []), bench(spark, []), share=0.7)
