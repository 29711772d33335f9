"""Each stage of the corpus pipeline against brute force on its own input, and the whole."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from framewright.llm import bpe, langid
from framewright.llm.common import crc_mod
from tests.llm import test_decontaminate, test_line_dedup, test_minhash_dedup
from tests.llm.helpers import ODD, docs, prose

STAGE = dict(cp.STAGES)
ITEM = prose(321, 30)


def made():
    data = [(i, prose(400 + i, 60 + i)) for i in range(20)]
    passage = "\n".join(prose(77 + i, 20) for i in range(3))
    data += [(100 + i, f"{prose(500 + i, 30)}\n{passage}\n{prose(600 + i, 25)}") for i in range(4)]
    for i in range(6):
        w = prose(400 + i, 60 + i).split()
        w[10 + 3 * i] = "changed"
        data.append((200 + i, " ".join(w)))
    data += [(300, f"{prose(901, 20)} {ITEM}"), (301, ITEM.upper() + " end"), (302, " ".join(ITEM.split()[:20]))]
    return data + ODD


def table(spark, data=None):
    df = docs(spark, made() if data is None else data, clash=False)
    return df.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source", "cast(length(text) as long) as n_chars")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    table(spark).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(0, ITEM), (1, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_language(spark, sf_dir):
    d = table(spark)
    model = langid.train(d.where(crc_mod("doc_id", 4) != 2))
    ok = lambda t: (p := model.predict(t))[0] != "und" and p[1] >= cp.LEAST_SCORE
    out = STAGE["language ID"](spark, d, sf_dir)
    assert out.columns == d.columns and pairs(out) == sorted(((i, t) for i, t in made() if ok(t)), key=str)
    assert {i for i, _ in pairs(out)} >= set(range(20)) and not {1, 2, 3} & {i for i, t in pairs(out) if not t}


def test_lines(spark, sf_dir):
    data = [x for x in made() if x[0] is not None]
    gone = test_line_dedup.brute(data, 50)
    out = STAGE["line dedup"](spark, table(spark, data), sf_dir)
    want = []
    for i, t in data:
        left = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])
        if left == t or left.strip():
            want.append((i, left))
    assert pairs(out) == sorted(want, key=str) and sum(map(len, gone.values())) >= 9


def test_near_copies(spark, sf_dir):
    data = made()
    root = test_minhash_dedup.brute(data, 5, 80)
    out = STAGE["MinHash near-dedup"](spark, table(spark, data), sf_dir)
    want = {(i, t) for i, t in data if i is not None and root[i] == i}
    assert pairs(out) == sorted([*want, *((i, t) for i, t in data if i is None)], key=str)
    assert sum(i != c for i, c in root.items()) >= 6 and {t for i, t in pairs(out) if i == 5} >= {prose(3, 60), prose(4, 60)}  # different texts of one id stay together


def test_benchmarks(spark, sf_dir):
    data = made()
    hit = {(i, t) for i, t in data if t and test_decontaminate.brute([(i, t)], [(0, ITEM)])}
    out = STAGE["benchmark decontamination"](spark, table(spark, data), sf_dir)
    assert pairs(out) == sorted((x for x in data if x not in hit), key=str) and {i for i, _ in hit} == {300, 301}


def token_rows(data):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return sorted(((i, lib.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data), key=str)


def test_tokens(spark, sf_dir):
    out = STAGE["byte-level BPE"](spark, table(spark), sf_dir)
    assert sorted(((r.doc_id, list(r.ids), r.decoded_sha256) for r in out.collect()), key=str) == token_rows(made())


def test_whole(spark, sf_dir):
    d = table(spark)
    for _, stage in cp.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, sf_dir).collect(), d.schema)
    got = sorted(((r.doc_id, list(r.ids), r.decoded_sha256) for r in cp.run(spark, sf_dir).collect()), key=str)
    assert got == token_rows([(r.doc_id, r.text) for r in d.collect()]) and len(got) > 20


def test_empty_table(spark, sf_dir):
    d = table(spark, [])
    for name, stage in cp.STAGES:
        out = stage(spark, d, sf_dir)
        assert out.count() == 0
        assert name == "byte-level BPE" or out.columns == d.columns
