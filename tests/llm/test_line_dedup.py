import random

from framewright.llm import line_dedup as m
from tests.llm.helpers import ODD, docs, prose, rows


def brute(data, words):
    """Lines in later copies of any repeated run of enough words, by trying all runs."""
    seq = []
    for d, (i, t) in enumerate(sorted({(i, t) for i, t in data if t is not None}, key=lambda x: x[0])):
        lines = [(p, x) for p, x in enumerate(t.split("\n")) if x.strip()]
        seq.append((i, lines))
    first, gone = {}, set()
    for i, lines in seq:
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                key = tuple(x for _, x in lines[a:b])
                if sum(len(x.split()) for x in key) >= words:
                    if key in first:
                        gone |= {(i, p) for p, _ in lines[a:b]}
                    else:
                        first[key] = (i, a)
    return {i: sorted(p for j, p in gone if j == i) for i, _ in seq}


def made(seed):
    r = random.Random(seed)
    pool = [prose(s, r.choice([1, 3, 5, 9])) for s in range(14)]
    data = []
    for i in range(25):
        lines = []
        for _ in range(r.randrange(1, 6)):
            a = r.randrange(len(pool))
            lines += pool[a : a + r.randrange(1, 5)]
            lines += ["", f"unique {i} {len(lines)}"][: r.randrange(3)]
        data.append((i, "\n".join(lines)))
    return data


def test_same_lines_as_brute_force(spark):
    for seed in (1, 2):
        data = made(seed)
        got = {r.doc_id: list(r.removed) for r in m.dedup_lines(docs(spark, data), words=12).collect()}
        assert got == brute(data, 12)


def test_every_removed_line_survives_once(spark):
    data = made(3)
    out = m.dedup_lines(docs(spark, data), words=8).collect()
    left = {x for r in out for x in r.text.split("\n")}
    assert {x for _, t in data for x in t.split("\n") if x.strip()} <= left


def test_odd_rows(spark):
    passage = prose(8, 55)
    data = [*ODD, (11, f"a\n{passage}\nb"), (12, f"c\n\n{passage}\nd"), (13, f"{passage}\n{passage}")]
    out = m.dedup_lines(docs(spark, data))
    assert out.columns == [c for c in docs(spark, []).columns if c not in ("removed", "n_lines")] + ["n_lines", "removed"]
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and by[1][0].n_lines == 0 and by[2][0].text == "" and by[2][0].n_lines == 1
    assert [r.removed for r in by[4]] == [[], []]  # rows that repeat are one document
    assert by[11][0].removed == [] and by[12][0].text == "c\n\nd" and by[13][0].text == ""
    assert m.dedup_lines(docs(spark, [])).count() == 0


def test_null_columns_and_hot_line(spark):
    data = [(i, "\n".join(["the same first line"] * 3 + [f"own line {i}"])) for i in range(200)]
    out = rows(m.dedup_lines(docs(spark, data, clash=False), words=12), "doc_id", "removed")
    assert out[0][1] == [] and sum(1 for _, r in out if r == [0, 1, 2]) == 199
