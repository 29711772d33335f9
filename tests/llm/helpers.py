"""Small tables with everything that may go wrong in them."""

import random

WORDS = [a + b for a in ("ba", "ko", "ti", "su", "me", "ra", "lo", "ni") for b in ("dra", "len", "mor", "sta", "vik", "zon", "pul", "gar")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(99, 30_000)
#: doc_id, text: nulls, empty, blank, repeated rows, one id with two texts, a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, prose(1, 40)), (None, None), (4, prose(2, 60)), (4, prose(2, 60)), (5, prose(3, 60)), (5, prose(4, 60)), (6, LONG), (7, "one"), (8, "..., !")]
#: Names that operators use inside, as extra columns of their input.
CLASH = ["h", "did", "rank", "cid", "node", "n", "size", "component", "kept", "score", "removed", "n_lines", "hash", "lead"]


def docs(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        df = df.selectExpr("*", *(f"'x' as `{c}`" for c in CLASH), "cast(null as string) as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    return df


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
