"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

Tier one resolves a whole pre-token that is itself in the vocabulary through a minimal perfect hash
(one displacement per bucket, a slot per token, no gaps) whose slot holds the token's fingerprint and
rank; the bytes are compared, so nothing foreign is accepted. Tier two merges the rest: the bytes are
a doubly linked list and a heap hands out the pair of lowest rank, leftmost first, stale entries
being skipped. That is the order in which the public libraries merge.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import arrow, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers: half of them from now, half from before, so its memory is bounded.
MEMO = 400_000


_h = xxhash.xxh3_64_intdigest


class PerfectHash:
    """Minimal perfect hash over the vocabulary's tokens: hash, displace, and place every token in a slot of its own."""

    def __init__(self, tokens: list[bytes]):
        n = self.n = len(tokens)
        self.buckets = max(1, n // 3)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [_h(t) for t in tokens]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_of = np.full(n, -1, np.int64)
        left = None
        for g in sorted(range(self.buckets), key=lambda g: -len(groups[g])):
            members, d = groups[g], 0
            if not members:
                continue
            if len(members) == 1:  # groups of one come last and take the slots that are left, kept as ~slot
                left = iter(np.flatnonzero(self.slot_of < 0).tolist()) if left is None else left
                slot = next(left)
                self.shift[g], self.slot_of[slot] = ~slot, members[0]
                continue
            while True:
                slots = {self._slot(hashes[i], d) for i in members}
                if len(slots) == len(members) and all(self.slot_of[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[g] = d
            for i in members:
                self.slot_of[self._slot(hashes[i], d)] = i

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n

    def find(self, token: bytes) -> int:
        """Index of the only token that could be this one."""
        h = _h(token)
        d = int(self.shift[h % self.buckets])
        return int(self.slot_of[~d if d < 0 else self._slot(h, d)])


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = list(ranks)
        self.ids = [ranks[t] for t in self.tokens]
        self.ranks = ranks
        self.mph = PerfectHash(self.tokens)
        self.split = regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.ids}
        self.memo = Memory(self)

    def whole(self, word: bytes) -> int | None:
        i = self.mph.find(word)
        return self.ids[i] if self.tokens[i] == word else None

    def merge(self, word: bytes) -> list[int]:
        """Heap over linked bytes: a part links to where it ends, which is where the next begins, and to the part before; 0 marks a part that is gone."""
        n, ranks, rank = len(word), self.ranks, self.ranks.get
        width = n.bit_length()
        high, mask = 2 * width, (1 << width) - 1
        heap = [r << high | i << width | i + 2 for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        end, before, push, pop = list(range(1, n + 1)), list(range(-1, n - 1)), heapq.heappush, heapq.heappop
        while heap:
            key = pop(heap)
            stop, i = key & mask, key >> width & mask
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two parts has been merged with another since
            end[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                last = end[stop]
                if (r := rank(word[i:last])) is not None:
                    push(heap, r << high | i << width | last)
            if (p := before[i]) >= 0 and (r := rank(word[p:stop])) is not None:
                push(heap, r << high | p << width | stop)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : (i := end[i])]])
        return out

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        i = self.whole(raw)
        return [i] if i is not None else self.merge(raw)

    def encode(self, text: str) -> list[int]:
        return [i for w in self.split.findall(text) for i in self.encode_word(w)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Memory(dict):
    """Pre-token -> its ids; worked out when first asked for.

    When half of ``MEMO`` is reached the table becomes the one from before and a new one begins; what
    is asked for again comes over from there, so that frequent words stay.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.before = encoder, {}

    def __missing__(self, word: str) -> list[int]:
        if (got := self.before.get(word)) is None:
            got = self.encoder.encode_word(word)
        if len(word) <= 64:
            if len(self) >= MEMO // 2:
                self.before = dict(self)
                self.clear()
            self[word] = got
        return got


_encoders: dict[str, Encoder] = {}


def load(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, built once in each Python worker."""
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = Encoder(ranks, pattern)
    return _encoders[path]


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]), a row for each row of ``docs`` (doc_id, text, any others).

    Whole texts are encoded without special tokens by the rank file at ``path`` (the installed public
    vocabulary by default, read on each worker from its own installation), then decoded from the ids.
    A null text counts as the empty one: 0 tokens, the hash of no bytes. Rows that repeat are each
    encoded; null doc_ids stay null. Texts aren't shuffled, so no key can be hot.
    """
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path, pattern)
        table_of = enc.bytes_of
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, sha, back, all_ids, raw = [], [], [], [], []
                for t in part.column("text"):
                    own = list(chain.from_iterable(map(enc.memo.__getitem__, enc.split.findall(t.as_py() or ""))))
                    joined = " ".join(map(enc.decimal.__getitem__, own))
                    plain = b"".join(map(table_of.__getitem__, own))
                    n.append(len(own))
                    sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(plain).hexdigest())
                    if ids:
                        all_ids.append(own)
                        raw.append(plain)
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols, names = [*cols, pa.array(all_ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * ids
    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
