"""Language identification, words first.

Training counts words per language over a bounded sample of documents and, from the distinct words,
character n-grams. A known word scores its smoothed log frequency in each language; an unseen word
falls back to its character n-grams of the longest order of which the model knows any, down to
single letters. A document's score is the softmax of its words' summed log frequencies divided by the
root of their number.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import arrow, crc_mod, table

#: A word is a run of letters, marks kept out; digits, other numerals and underscores end it.
WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
UND = "und"
#: Unseen words whose scores a worker remembers.
KEPT = 100_000


def words_of(text: str | None) -> Counter:
    """The distinct lower-cased words of a text with their numbers."""
    found = Counter(WORD.findall((text or "").lower()))
    for w in [w for w in found if not w.isalpha()]:  # holds a numeral that is no decimal digit, such as the superscript two
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def _grams(word: str) -> Iterator[str]:
    """Character n-grams, the longest order first; all but single letters see the word's ends."""
    marked = f"<{word}>"
    for m in ORDERS:
        src = word if m == 1 else marked
        for a in range(len(src) - m + 1):
            yield src[a : a + m]


def _logs(counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Smoothed log share of each row within the rows of its order, for each language."""
    out = np.empty(counts.shape, np.float32)
    for m in np.unique(order):
        own = order == m
        out[own] = np.log((counts[own] + 0.5) / (counts[own].sum(axis=0) + 0.5 * own.sum()))
    return out


class Model:
    """Per-language log frequencies of words and of character n-grams, a row of one matrix for each."""

    def __init__(self, langs: list[str], words: dict[str, int], word_logs: np.ndarray, grams: dict[str, int], gram_logs: np.ndarray):
        self.parts = (langs, words, word_logs, grams, gram_logs)
        self.langs, self.words, self.word_logs, self.grams, self.gram_logs = self.parts
        self.fresh: dict[str, int] = {}
        self.table: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: Iterable[tuple[str, str, int]]) -> Model:
        """From (language, word, count)."""
        index: dict[str, int] = {}
        words: dict[str, int] = {}
        at, of, n = array("q"), array("q"), array("d")
        for lang, w, c in counts:
            at.append(words.setdefault(w, len(words)))
            of.append(index.setdefault(lang, len(index)))
            n.append(c)
        langs = sorted(index)
        column = np.array([langs.index(x) for x in index], np.int64)
        seen = np.zeros((len(words), len(langs)))
        if len(at):
            np.add.at(seen, (np.frombuffer(at, np.int64), column[np.frombuffer(of, np.int64)]), np.frombuffer(n, float))
        weight = np.log1p(seen)
        grams: dict[str, int] = {}
        at, of = array("q"), array("q")
        for w, i in words.items():
            for g in _grams(w):
                at.append(grams.setdefault(g, len(grams)))
                of.append(i)
        held = np.zeros((len(grams), len(langs)))
        rows, of = np.frombuffer(at, np.int64), np.frombuffer(of, np.int64)
        for a in range(0, len(rows), 1 << 20):
            np.add.at(held, rows[a : a + (1 << 20)], weight[of[a : a + (1 << 20)]])
        order = np.fromiter(map(len, grams), np.int64, len(grams))
        return cls(langs, words, _logs(seen, np.zeros(len(words), np.int64)), grams, _logs(held, order))

    def _unseen(self, w: str) -> np.ndarray:
        """Mean log share of the n-grams of the longest order of which any is known; even between languages without any."""
        known: list[int] = []
        last = 0
        for g in _grams(w):
            if known and len(g) != last:
                break  # a longer order has answered
            last = len(g)
            if (i := self.grams.get(g)) is not None:
                known.append(i)
        return self.gram_logs[known].mean(axis=0) if known else np.zeros(len(self.langs), np.float32)

    def _row(self, w: str) -> int:
        """Where the scores of an unseen word are kept; the table is emptied when full, so its memory is bounded."""
        if len(self.fresh) >= KEPT:
            self.fresh.clear()
        i = self.fresh[w] = len(self.words) + len(self.fresh)
        self.table[i] = self._unseen(w)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the scores; mean log frequencies weigh as much as the root of the number of words."""
        words = words_of(text)
        if not words or not self.langs:
            return UND, 0.0
        if self.table is None:
            self.table = np.concatenate([self.word_logs, np.zeros((KEPT, len(self.langs)), np.float32)])
        total, seen = np.zeros(len(self.langs)), 0
        each = list(words)
        for a in range(0, len(each), KEPT):
            part = each[a : a + KEPT]
            if len(part) + len(self.fresh) > KEPT:
                self.fresh.clear()
            known, fresh = self.words.get, self.fresh.get
            rows = [i if (i := known(w)) is not None else i if (i := fresh(w)) is not None else self._row(w) for w in part]
            n = np.fromiter(map(words.__getitem__, part), float, len(part))
            total += n @ self.table[rows]
            seen += n.sum()
        z = total / math.sqrt(seen)
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """About ``per_lang`` documents of each language, chosen by a hash of id and text: the same rows on every run."""
    labelled = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    return labelled.where(F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(1 << 30)) < share * (1 << 30))


def train(docs: DataFrame, per_lang: int = 1000) -> Model:
    """A model from documents (doc_id, text, lang): fitted on a bounded sample of ``per_lang`` documents a language.

    Word counts of the sample are summed per partition, then by Spark; the driver gets a row for each
    language and distinct word of the sample, so its size is bounded by ``per_lang`` and not by the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text.as_py()))
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    rows = arrow(sample(docs, per_lang).select("lang", "text"), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Model.fit(map(tuple, rows.orderBy("lang", "word").toLocalIterator()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of ``docs`` (doc_id, text, any others).

    ``und`` with score 0 where the text is null, empty or has no letter, or the model knows no
    language. Repeated rows are each judged; equal scores go to the first language by name. Whole
    texts are read, and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            got = [own.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is predicted with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            got = [own.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UND and s >= least for lang, s in got], pa.bool_()))

    return arrow(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
