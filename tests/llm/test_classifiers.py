import math
import random

from framewright.llm import langid, toxicity
from tests.llm.helpers import ODD, WORDS, docs, prose, rows

STEMS = {"xx": ["ala", "bol", "cer"], "yy": ["öst", "ünd", "ßer"], "zz": ["qui", "xou", "wyk"]}


def text_of(lang, seed, n=30):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def lang_docs(spark, n=40):
    data = [(i, text_of(("xx", "yy", "zz")[i % 3], i), ("xx", "yy", "zz")[i % 3]) for i in range(n)]
    return data, spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_language_of_known_and_unseen_words(spark):
    data, d = lang_docs(spark)
    model = langid.train(d)
    assert all(model.predict(text_of(l, 10_000 + i, 5))[0] == l for l in STEMS for i in range(5))
    assert model.predict("alabolcerala")[0] == "xx" and model.predict("xouxouxouxou")[0] == "zz"  # unseen: n-grams
    assert model.predict("") == model.predict(None) == model.predict("12 ... _ 5") == ("und", 0.0)
    got = rows(langid.identify(docs(spark, ODD), model), "doc_id", "lang_pred", "score")
    assert len(got) == len(ODD) and all(0 <= s <= 1 for _, _, s in got)
    assert {p for i, p, _ in got if i in (1, 2, 3, 8)} == {"und"}


def test_numerals_are_no_letters(spark):
    model = langid.train(lang_docs(spark)[1])
    for text in ("\u00b2", "\u00bd\u2460", "\u2167 \u00b3 7_7", "\U0001f101"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("ala\u00b2bol") == model.predict("ala bol")


def plain_language(train, text):
    """The same method word by word, in dictionaries."""
    langs = sorted({l for _, _, l in train})
    counts = {l: {} for l in langs}
    for _, t, l in train:
        for w in t.lower().split():
            counts[l][w] = counts[l].get(w, 0) + 1
    known = {w for l in langs for w in counts[l]}
    share = {l: {w: math.log((counts[l].get(w, 0) + 0.5) / (sum(counts[l].values()) + 0.5 * len(known))) for w in known} for l in langs}
    cut = lambda w, m: [w[a : a + 1] for a in range(len(w))] if m == 1 else [f"<{w}>"[a : a + m] for a in range(len(w) + 3 - m)]
    grams = {m: {l: {} for l in langs} for m in langid.ORDERS}
    for m in langid.ORDERS:
        for l in langs:
            for w, c in counts[l].items():
                for g in cut(w, m):
                    grams[m][l][g] = grams[m][l].get(g, 0) + math.log1p(c)

    def score(w, l):
        if w in known:
            return share[l][w]
        for m in langid.ORDERS:
            kinds = {g for x in langs for g in grams[m][x]}
            if found := [g for g in cut(w, m) if g in kinds]:
                return sum(math.log((grams[m][l].get(g, 0) + 0.5) / (sum(grams[m][l].values()) + 0.5 * len(kinds))) for g in found) / len(found)
        return 0.0

    words = text.lower().split()
    z = {l: sum(score(w, l) for w in words) / math.sqrt(len(words)) for l in langs}
    total = sum(math.exp(v - max(z.values())) for v in z.values())
    best = max(langs, key=lambda l: z[l])
    return best, 1 / total


def test_language_by_brute_force(spark):
    data, d = lang_docs(spark, 24)
    texts = [text_of(l, 500 + i, n) + tail for l in STEMS for i, n in enumerate((1, 3, 12)) for tail in ("", " alxqu", " zzz")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, list(enumerate(texts))), langid.train(d)).collect()}
    for i, t in enumerate(texts):
        lang, score = plain_language(data, t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4


def test_kept_rows_are_those_identified(spark):
    _, d = lang_docs(spark)
    model = langid.train(d)
    data = [*ODD, (30, text_of("xx", 77)), (31, "ala \u00f6st qui")]
    table = docs(spark, data)
    kept = langid.keep(table, model, 0.9)
    assert kept.schema == table.schema
    want = sorted((t for _, t in data if model.predict(t)[0] != "und" and model.predict(t)[1] >= 0.9), key=str)
    assert sorted((r.text for r in kept.collect()), key=str) == want and text_of("xx", 77) in want


def test_language_without_training_rows(spark):
    model = langid.train(spark.createDataFrame([(1, None, "xx"), (2, "abc", None)], "doc_id long, text string, lang string"))
    assert rows(langid.identify(docs(spark, [(1, "abc")]), model), "doc_id", "lang_pred", "score") == [(1, "und", 0.0)]
    assert langid.identify(docs(spark, []), model).count() == 0


def test_language_more_words_than_are_remembered(spark, monkeypatch):
    _, d = lang_docs(spark)
    model = langid.train(d)
    text = " ".join(text_of("yy", s, 8) for s in range(60))
    want = model.predict(text)
    monkeypatch.setattr(langid, "KEPT", 7)
    again = langid.Model(*model.parts)
    assert again.predict(text)[0] == want[0] == "yy" and abs(again.predict(text)[1] - want[1]) < 1e-6


def test_sample_is_bounded_and_stable(spark):
    d = spark.createDataFrame([(i, prose(i, 3), "xx" if i % 4 else "yy") for i in range(400)], "doc_id long, text string, lang string")
    a, b = (rows(langid.sample(d.repartition(n), 50), "doc_id") for n in (1, 7))
    assert a == b and 60 < len(a) < 140


def toxic_data(n=400):
    data, labels = [], []
    for i in range(n):
        w = prose(i, 40).split()
        y = int(i % 5 == 0)
        if y:
            w[i % 40] = ("vrek" + random.Random(i).choice(WORDS)) if i % 2 else "jolter"
        data.append((i, " ".join(w)))
        labels.append((i, 0, y))
    return data, labels


def test_toxicity_held_out(spark):
    data, labels = toxic_data()
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, data), l.where("doc_id % 7 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(docs(spark, data), model).collect()}
    held = [i for i in range(400) if i % 7 == 0]
    assert sum(got[i].predicted == int(i % 5 == 0) for i in held) >= 0.95 * len(held)
    unseen = toxicity.score(docs(spark, [(1, prose(9999, 30) + " vrekzonmor"), (2, prose(9998, 30))]), model).collect()
    assert {r.doc_id: r.predicted for r in unseen} == {1: 1, 2: 0}  # a new form of a known stem
    odd = toxicity.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_toxicity_degenerate_labels(spark):
    data, _ = toxic_data(20)
    for labels, most in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0), ([(1, None), (None, 1)], 0.0)):
        model = toxicity.train(docs(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {round(r.score, 3) for r in toxicity.score(docs(spark, data), model).collect()} == {most}


def plain_difference(grams, order, word):
    """Interpolated Kneser-Ney of both classes by the textbook, letter by letter."""
    d = toxicity.DISCOUNT
    pooled = {order: set(grams[0]) | set(grams[1])}
    for m in range(order - 1, 0, -1):
        pooled[m] = {g[1:] for g in pooled[m + 1]}
    before = lambda m, g: sum(x[1:] == g for x in pooled[m + 1])

    def shared(g):
        m = len(g)
        if not m:
            return 1 / (len(pooled[1]) + 1)
        same = [x for x in pooled[m] if x[:-1] == g[:-1]]
        total = sum(before(m, x) for x in same)
        return (max(before(m, g) - d, 0) + d * len(same) * shared(g[1:])) / total if total else shared(g[1:])

    def own(y, g):
        same = {x: n for x, n in grams[y].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        return (max(grams[y].get(g, 0) - d, 0) + d * len(same) * shared(g[1:])) / total if total else shared(g[1:])

    s = "<" * (order - 1) + word + ">"
    return sum(math.log(own(1, s[a : a + order]) / own(0, s[a : a + order])) for a in range(len(s) - order + 1))


def test_toxicity_by_brute_force():
    order, grams = 4, [{}, {}]
    for y, words in ((0, "bana kolo tisu bana mera nilo".split()), (1, "vrek vreka jolter vrek".split())):
        for w in words:
            s = "<" * (order - 1) + w + ">"
            for a in range(len(s) - order + 1):
                grams[y][s[a : a + order]] = grams[y].get(s[a : a + order], 0) + 1
    own = toxicity.Scorer(*toxicity.difference_tables(grams, order), order)
    for w in ("vrek", "vreko", "bana", "banavrek", "xyz", "jolt", "é"):
        assert abs(own.word(w) - plain_difference(grams, order, w)) < 1e-9
    words = "bana Vreko, bana".lower().replace(",", "").split()
    each = [plain_difference(grams, order, w) for w in words]
    whole, worst = own.text("bana Vreko, bana")
    assert abs(whole - sum(each) / sum(len(w) + order for w in words)) < 1e-9
    assert abs(worst - max(0, *(x / (len(w) + order) for x, w in zip(each, words, strict=True)))) < 1e-9 and own.text(None) == (0.0, 0.0)


def test_shared_backoff_costs_both_classes_the_same():
    ratio, other = toxicity.difference_tables([{"<<ab": 4, "<abc": 4}, {"<<ab": 2, "<abd": 2}], 4)
    assert ratio["<abd"] > 0 > ratio["<abc"] and "zzz" not in other
    assert toxicity.Scorer(ratio, other, 4).word("zzzz") == 0
