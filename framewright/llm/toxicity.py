"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

Each class (toxic, ordinary) has discounted counts of the longest letter n-grams of its training
words. Where a class knows little it backs off to lower orders that both classes share: continuation
counts of the pooled n-grams. So an expression that neither class knows costs both the same, and
inflected or newly joined forms of a known toxic stem are still found. Toxic and ordinary
log-likelihood are compared after dividing by the length in letters: once over the whole document,
and once for each expression, of which the most toxic one counts, because a long document isn't
harmless for the harmless text around it. A logistic curve over both differences, fitted on training
rows that the counts left out, maps them to 0..1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import arrow, crc_mod, table

WORD = re.compile(r"[^\W\d_]+")
DISCOUNT = 0.75


def _marked(word: str, order: int) -> str:
    return "<" * (order - 1) + word + ">"


def difference_tables(grams: list[dict[str, int]], order: int) -> tuple[dict[str, float], dict[str, float]]:
    """Log ratio of toxic to ordinary probability: of each n-gram that a class knows, and of any other letter after a known context.

    ``grams`` has the counts of the longest n-grams of the ordinary and the toxic class. After a
    context that neither knows, the two share their backoff and the ratio is 1.
    """
    types = set(grams[0]) | set(grams[1])
    cont: list[dict[str, int]] = [{} for _ in range(order)]
    known = types
    for m in range(order - 1, 0, -1):
        cont[m] = Counter(g[1:] for g in known)
        known = set(cont[m])
    total = [Counter() for _ in range(order)]
    kinds = [Counter() for _ in range(order)]
    for m in range(1, order):
        for g, n in cont[m].items():
            total[m][g[:-1]] += n
            kinds[m][g[:-1]] += 1
    floor = 1 / (len(cont[1]) + 1)

    def shared(g: str) -> float:
        p = floor
        for m in range(1, len(g) + 1):
            part = g[len(g) - m :]
            if n := total[m].get(part[:-1], 0):
                p = (max(cont[m].get(part, 0) - DISCOUNT, 0) + DISCOUNT * kinds[m][part[:-1]] * p) / n
        return p

    seen, spread = [Counter(), Counter()], [Counter(), Counter()]
    for y in (0, 1):
        for g, n in grams[y].items():
            seen[y][g[:-1]] += n
            spread[y][g[:-1]] += 1

    def own(y: int, g: str, p: float) -> float:
        n = seen[y].get(g[:-1], 0)
        return (max(grams[y].get(g, 0) - DISCOUNT, 0) + DISCOUNT * spread[y][g[:-1]] * p) / n if n else p

    def back(y: int, context: str) -> float:
        n = seen[y].get(context, 0)
        return DISCOUNT * spread[y][context] / n if n else 1.0

    ratio = {}
    for g in types:
        p = shared(g[1:])
        ratio[g] = math.log(own(1, g, p) / own(0, g, p))
    return ratio, {c: math.log(back(1, c) / back(0, c)) for c in set(seen[0]) | set(seen[1])}


class Scorer:
    """Evidence of whole texts; remembers a bounded number of words."""

    def __init__(self, ratio: dict[str, float], other: dict[str, float], order: int):
        self.ratio, self.other, self.order, self.memo = ratio, other, order, {}

    def word(self, w: str) -> float:
        """Difference of the word's two log-likelihoods."""
        if (got := self.memo.get(w)) is None:
            s, k = _marked(w, self.order), self.order
            got = 0.0
            for a in range(len(s) - k + 1):
                r = self.ratio.get(s[a : a + k])
                got += self.other.get(s[a : a + k - 1], 0.0) if r is None else r
            if len(w) <= 64:
                if len(self.memo) >= 200_000:
                    self.memo.clear()
                self.memo[w] = got
        return got

    def text(self, text: str | None) -> tuple[float, float]:
        """Difference a letter, over the whole text and in its most toxic word; 0 for both without words. A word is as long as its marked form."""
        whole, length, worst = 0.0, 0, 0.0
        for w, n in Counter(WORD.findall((text or "").lower())).items():
            d = self.word(w)
            whole += n * d
            length += n * (len(w) + self.order)
            worst = max(worst, d / (len(w) + self.order))
        return whole / max(length, 1), worst


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and offset by Newton's method on targets drawn in from 0 and 1, so that separable data have a finite fit."""
    n1 = float(y.sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    mid, width = x.mean(axis=0), x.std(axis=0)
    width[width == 0] = 1.0
    z = np.column_stack([(x - mid) / width, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-4 * np.eye(len(w)), z.T @ (t - p) - 1e-4 * w)
        w += np.clip(step, -4, 4)
        if abs(step).max() < 1e-8:
            break
    slopes = w[:-1] / width
    return np.append(slopes, w[-1] - slopes @ mid)


class Model:
    def __init__(self, scorer: Scorer | None, slopes: tuple[float, float], offset: float):
        self.scorer, self.slopes, self.offset = scorer, slopes, offset

    def score(self, text: str | None) -> float:
        whole, worst = self.scorer.text(text) if self.scorer else (0.0, 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slopes[0] * whole + self.slopes[1] * worst + self.offset))))


def train(docs: DataFrame, labels: DataFrame, most: int = 200_000, order: int = 5) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic 0 or 1).

    The classifier is fitted on at most about ``most`` labelled documents, chosen by a hash of the
    id: below that bound all of them. Four fifths of them are counted, the rest fit the curve. The
    n-gram counts are summed by partition and then by Spark; their number follows the sample, which
    bounds what reaches the driver and the workers. A document labelled more than once is toxic if
    any of its labels is; null labels and ids teach nothing. Without both classes every score is
    the share of toxic rows, near 0 without any.
    """
    own = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n, bad = own.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not bad or bad == n:
        return Model(None, (0.0, 0.0), 30.0 if n and bad else -30.0)
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, most / n) * (1 << 30))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(own), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Counter(), Counter()]
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words[y].update(WORD.findall(text.as_py().lower()))
        for y in (0, 1):
            grams: Counter = Counter()
            for w, c in words[y].items():
                s = _marked(w, order)
                for a in range(len(s) - order + 1):
                    grams[s[a : a + order]] += c
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(grams), pa.int32()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["toxic", "gram", "n"])

    def tables(part: DataFrame) -> Scorer:
        grams: list[dict[str, int]] = [{}, {}]
        for y, g, c in arrow(part.select("text", "toxic"), count, "toxic int, gram string, n long").groupBy("toxic", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
            grams[y][g] = c
        return Scorer(*difference_tables(grams, order), order)

    scorer = tables(rows.where("fold <> 0"))
    curve = evidence(rows.where("fold = 0"), scorer, ["toxic"]).toPandas()
    if curve.toxic.nunique() < 2:  # a handful of rows: the curve has to use the counted ones
        curve = evidence(rows, scorer, ["toxic"]).toPandas()
    if curve.toxic.nunique() < 2:
        return Model(None, (0.0, 0.0), math.log(bad / (n - bad)))
    *slopes, offset = _logistic(curve[["whole", "worst"]].to_numpy(float), curve.toxic.to_numpy(float)).tolist()
    return Model(scorer, tuple(slopes), offset)


def evidence(docs: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    """(keep, whole, worst): the evidence of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer.ratio, scorer.other, scorer.order))
    kept = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*shared.value)
        for batch in batches:
            got = [own.text(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([g[i] for g in got], pa.float64()) for i in (0, 1))], [*keep, "whole", "worst"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return arrow(kept, run, f"{fields}, whole double, worst double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted), a row for each row of ``docs`` (doc_id, text, any others); whole texts, nothing shuffled.

    A null or empty text, or one without letters, has evidence 0, as ordinary text has. Repeated rows score alike.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model.scorer is None:
        out = rows.select("doc_id", F.lit(model.score(None)).alias("score"))
    else:
        z = F.lit(model.slopes[0]) * F.col("whole") + F.lit(model.slopes[1]) * F.col("worst") + F.lit(model.offset)
        out = evidence(rows, model.scorer, ["doc_id"]).select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
