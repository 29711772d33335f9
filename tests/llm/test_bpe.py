import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import bpe
from tests.llm.helpers import ODD, docs

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def pair():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe.load(PATH, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(pair):
    enc = pair[0]
    assert sorted(enc.mph.slot_of.tolist()) == list(range(len(enc.tokens)))
    assert all(enc.whole(t) == i for t, i in enc.ranks.items())
    assert all(enc.whole(t + b"\xff\xfe\x00") is None for t in enc.tokens[:500])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_like_the_library(pair, text):
    ids = pair[1].encode_ordinary(text)
    assert pair[0].encode(text) == ids and pair[0].decode(ids) == text.encode()


def test_long_run_and_foreign_scripts(pair):
    for text in ("a" * 3000, " " * 500 + "\n\n", "日本語のテキスト " * 50, "'s't're x'LL <|endoftext|> 12345", "é́‍👩‍👩‍👧 "):
        assert pair[0].encode(text) == pair[1].encode_ordinary(text)


def test_odd_rows(spark, pair):
    d = docs(spark, ODD)
    out = bpe.encode_decode(d, ids=True)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.decoded)) for r in out.collect()), key=str)
    want = []
    for i, t in ODD:
        ids = pair[1].encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), (t or "").encode()))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(docs(spark, [])).count() == 0
