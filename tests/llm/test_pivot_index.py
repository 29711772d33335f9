import numpy as np

from framewright.llm import pivot_index as m


def vectors(seed=1, n=300, copies=120):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 24))
    near = x[r.integers(0, n, copies)] + r.normal(size=(copies, 24)) * 0.12
    return np.concatenate([x, near, x[:5], x[:3] * 2.5])


def brute(x, least=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T >= least
    np.fill_diagonal(g, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], *label[g[i]]) if g[i].any() else label[i] for i in range(len(x))])
        if (new == label).all():
            return g.sum(1), label
        label = new


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rep int").selectExpr("*", "1 as cid", "2 as m", "3 as u", "4 as n")


def test_recall_and_no_false_link(spark):
    x = vectors()
    want, label = brute(x)
    got = {r.vec_id: r for r in m.near_duplicates(frame(spark, x)).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.9 * want.sum()
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert sum(got[i].component_id == label[i] for i in got) >= 0.9 * len(x)


def test_blocks_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 16)
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(1, 16)) + r.normal(size=(90, 16)) * 0.02, r.normal(size=(40, 16))])
    got = {r.vec_id: r for r in m.near_duplicates(frame(spark, x)).collect()}
    want, label = brute(x)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum() and all(got[i].component_id == 0 for i in range(90))


def test_recall_at_the_threshold(spark):
    """3,000 pairs at cosines of 0.9 to 0.93 in 64 dimensions, with the query's parameters."""
    r = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, o, c = unit(r.normal(size=(3000, 64))), r.normal(size=(3000, 64)), r.uniform(0.9, 0.93, (3000, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * unit(o - (o * a).sum(1, keepdims=True) * a)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {q.vec_id: q for q in m.near_duplicates(df).collect()}
    want, label = brute(x.astype(float))
    n = np.array([got[i].n_links for i in range(len(x))])
    print("recall", n.sum() / want.sum())
    assert want.sum() >= 5900 and (n <= want).all() and n.sum() >= 0.98 * want.sum()


def test_order_decides_which_pivots_count():
    near = np.array([[5, 2, 9, 1]])
    assert m.lists(near, 10, 2).tolist() == [[25, 59]] and m.lists(near, 10, 3).tolist() == [[25, 59, 15, 29]]
    assert m.lists(np.array([[0]]), 1, 9).tolist() == [[0]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(0, None), (1, []), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, a), (7, a), (7, a), (8, [2.0, 4.0, 6.0]), (9, b), (10, [1.0, 2.0]), (None, a), (11, [1e200, 2e200, 3e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in m.near_duplicates(df).collect()), key=str)
    want = [(i, 0, i, True) for i in range(6)] + [(6, 3, 6, True), (7, 3, 6, False), (7, 3, 6, False), (8, 3, 6, False), (9, 0, 9, True), (10, 0, 10, True), (11, 3, 6, False), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert m.near_duplicates(df.where("false")).count() == 0
    assert m.near_duplicates(df.where("vec_id < 3")).count() == 3
