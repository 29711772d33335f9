from framewright.llm import chat_format, url_rules
from tests.llm.helpers import rows


def turns(spark, data):
    return spark.createDataFrame(data, "pair_id long, side string, turn long, role string, text string").selectExpr("*", "1 as c", "2 as r", "3 as n")


def test_longest_common_prefix_and_masks(spark):
    data = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "chosen", 2, "user", "more"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no")]
    r = chat_format.format_preferences(turns(spark, data)).first()
    assert (r.n_prefix, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert r.chosen == "<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n" and r.chosen_mask == "0:14 1:11 0:9 0:12"
    assert r.rejected == "<|assistant|>\nno<|end|>\n" and r.rejected_mask == "0:14 1:10"


def test_chat_odd_rows(spark):
    same = [(2, s, t, "user", "a") for s in ("chosen", "rejected") for t in (0, 1)]
    data = [*same, *same[:1], (3, "chosen", 0, None, None), (4, "rejected", None, "assistant", "x"), (None, "chosen", 0, "user", "a"), (5, "other", 0, "user", "a"), (6, "chosen", 0, "user", "b"), (6, "chosen", 0, "user", "a"), (6, "rejected", 0, "user", "a")]
    got = {r.pair_id: r for r in chat_format.format_preferences(turns(spark, data)).collect()}
    assert set(got) == {2, 3, 4, 6}
    assert got[2].n_prefix == 2 and got[2].chosen == got[2].rejected == "" and got[2].chosen_mask == ""
    assert got[3].n_prefix == 0 and got[3].prompt == "" and got[3].chosen == "<|unknown|>\n<|end|>\n" and got[3].rejected == ""
    assert got[4].rejected_mask == "0:14 1:9" and got[6].n_prefix == 1 and got[6].rejected == ""
    assert chat_format.format_preferences(turns(spark, [])).count() == 0


def test_turns_without_a_number_come_last(spark):
    data = [(1, s, t, "user", x) for s in ("chosen", "rejected") for t, x in ((0, "hi"), (1, "there"))] + [(1, "chosen", None, "assistant", "late")]
    r = chat_format.format_preferences(turns(spark, data)).first()
    assert (r.n_prefix, r.chosen, r.rejected) == (2, "<|assistant|>\nlate<|end|>\n", "")
    conv = spark.createDataFrame([(1, None, "assistant", "late"), (1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    r = chat_format.format_preferences(chat_format.stale_reply_pairs(conv)).first()
    assert (r.n_prefix, r.chosen, r.rejected) == (2, "<|assistant|>\nlate<|end|>\n", "<|assistant|>\na<|end|>\n")


def test_stale_reply_pairs(spark):
    conv = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "old"), (1, 2, "user", "q2"), (1, 3, "assistant", "new"), (1, 4, "user", "bye"), (2, 0, "user", "q"), (2, 1, "assistant", "only"), (3, 0, "user", "alone"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat_format.format_preferences(chat_format.stale_reply_pairs(conv)).collect()}
    assert (got[1].n_prefix, got[1].chosen, got[1].rejected) == (3, "<|assistant|>\nnew<|end|>\n", "<|assistant|>\nold<|end|>\n")
    assert got[2].rejected == "<|assistant|>\n<|end|>\n" and got[3].n_prefix == 1 and set(got) == {1, 2, 3}


URLS = ["http://example.org/es/x", "https://A.EXAMPLE.org/es/?q", "https://example.org/en/12", "https://example.org/en/2", "https://org/", "https://org", "https://xexample.org/es/", "http://a.com/fr/1", "http://a.com/de/1", "http://com/de/", "http://a.net/de/", "nothing", "", None, "://org/x", "http://u@org/x", "http://org:80/x", "http://b.org?x=/", "http://b.org/#/es/"]


def judged(url, rules, default="allow"):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(r), len(r.partition("/")[0]), v, r) for v, r in rules if host and (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def test_rules_like_brute_force(spark):
    rules = [*url_rules.RULES, ("block", "a.example.org/"), ("allow", "a.example.org/es/"), ("block", "example.org/e"), ("block", "org/"), ("allow", "net/d"), ("block", "net/de/x")]
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[2])], "page_id long, url string").selectExpr("*", "'a' as host", "'b' as key", "'c' as rule")
    got = rows(url_rules.judge(pages, url_rules.rule_table(spark, rules)), "page_id", "host", "path", "rule", "verdict")
    want = [(i, *judged(u, rules)) for i, u in [*enumerate(URLS), (0, URLS[0]), (None, URLS[2])]]
    assert got == sorted(want, key=str)


def test_rules_over_many_partitions(spark):
    rules = [("block" if (i + j) % 2 else "allow", f"{h}/{'x' * j}") for i, h in enumerate(["org", "b.org", "a.b.org", "com", "z.com"]) for j in range(4)]
    urls = [f"http://{h}/{p}" for h in ("org", "q.org", "b.org", "c.b.org", "a.b.org", "t.a.b.org", "com", "z.com", "net", "zz.com") for p in ("", "x", "xx", "xxx", "xxxx", "y", "xy")] * 3
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_rules.rule_table(spark, rules)), "page_id", "host", "path", "rule", "verdict")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == sorted(((i, *judged(u, rules)) for i, u in enumerate(urls)), key=str)


def test_deep_nesting_like_brute_force(spark):
    rules = [("block" if j % 2 else "allow", f"{'.'.join(['d', 'c', 'b', 'a'][4 - d :])}/{'x/' * j}") for d in range(1, 5) for j in range(6)]
    urls = [f"http://{h}/{p}" for h in ("a", "b.a", "c.b.a", "d.c.b.a", "e.d.c.b.a", "bb.a", "z.a", "ba") for p in ("", "x", "x/", "x/x/", "x/x/y", "x/x/x/x/x/x/x/", "x/􏿿", "y")]
    got = rows(url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_rules.rule_table(spark, rules)), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *judged(u, rules)) for i, u in enumerate(urls)), key=str)


def test_url_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(none, url_rules.rule_table(spark, url_rules.RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert rows(url_rules.judge(one, url_rules.rule_table(spark, [])), "page_id", "rule", "verdict") == [(1, None, "allow")]


def test_native_plans_have_no_python(spark):
    import re

    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_rules.judge(pages, url_rules.rule_table(spark, url_rules.RULES))._jdf.queryExecution().toString()
    assert not re.search("ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas", plan)
