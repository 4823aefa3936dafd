import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from filigree.llm import quality_rules, url_filter
from tests.llm.helpers import frame, odd_rows, prose


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_rules(spark):
    rows = odd_rows() + [(50, "a b c a b c d"), (51, "x x x x x " * 30), (52, "l1\nl1\n\n \nl2 # |\nl1"), (53, prose(8, 90) + "\n" + prose(8, 90))]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.base_rules(frame(spark, rows)).collect())
    assert got == sorted((i is None, i or 0, *counts(t)) for i, t in rows)


def test_long_texts_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 3)
    rows = [(1, "a b c a b c d e f g h a b c"), (2, "q " * 40)]
    assert sorted(r.n_repeat_words for r in quality_rules.base_rules(frame(spark, rows)).collect()) == sorted(counts(t)[4] for _, t in rows)


def test_frequent_lines_deplete_documents(spark):
    common = prose(9, 60).replace("\n", " ")
    rows = [(i, f"{common}\n{prose(700 + i, 20)}") for i in range(12)] + [(20, f"{common}\n{prose(800, 400)}"), (21, prose(801, 80)), (21, prose(801, 80)), (None, prose(802, 90)), (22, None)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, rows), max_docs=10).collect()}
    assert not any(got[i] for i in range(12)) and got[20] and got[21] and got[None] and not got[22]
    assert all(r.kept for r in quality_rules.quality_rules(frame(spark, rows), max_docs=13).where("doc_id < 21").collect())
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


PAGES = [
    (1, "https://WWW.Example.com/en/x?q=1"), (2, "http://a.example.com/en/"), (3, "http://example.com"), (4, "ftp://x.net/fr/1#a/b"), (5, "http://xnet/es/"), (6, None), (7, "no scheme"), (8, "http://b.org/?/en/"),
    (9, "http://h.net?x=://y"), (9, "http://h.net?x=://y"),
]


def test_listed_rules(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in PAGES], "page_id long, url string, host string, bad string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("example.com", "", None, "allow") and got[4] == ("x.net", "/fr/1", "net/fr/", "block") and got[5] == ("xnet", "/es/", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("b.org", "/", None, "allow") and got[9] == ("h.net", "", None, "allow")
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


def test_mined_rules(spark):
    pages = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}{i % 4}.org/{'win' if i % 2 else 'read'}/{i}") for i in range(240)]
    labels = [(i, int(not (i % 3 == 0 and i % 2)), 0) for i in range(120)] + [(None, 0, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), min_count=5).collect()}
    assert {i for i, v in got.items() if v == "block"} == {i for i in range(240) if i % 3 == 0 and i % 2}


def test_rules_are_those_of_a_plain_itemset_count(spark):
    """Every combination of tokens is counted; the operator finds the same blocked urls, and names a rule that holds."""
    rows = [(i, f"http://{'cheap-' if i % 4 == 0 else ''}shop{i % 5}.{'biz' if i % 3 else 'org'}/{'buy' if i % 2 else 'see'}/p{i % 7}") for i in range(210)]
    bad = {i for i in range(210) if i % 4 == 0 and i % 2 == 0 or i % 7 == 3 and i % 3}
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    parts = url_filter.with_parts(df).select("page_id", url_filter.tokens(F.col("url"), F.col("host"), F.col("path")).alias("t"))
    held = {r.page_id: frozenset(r.t) for r in parts.collect()}
    n, n_bad = Counter(), Counter()
    for i in range(150):
        for k in range(1, len(held[i]) + 1):
            for c in combinations(sorted(held[i]), k):
                n[c] += 1
                n_bad[c] += i in bad
    share = len([i for i in range(150) if i in bad]) / 150
    rules = [set(c) for c in n if n_bad[c] >= 6 and n_bad[c] / n[c] >= 0.8 and n_bad[c] / n[c] / share >= 1.2]
    wanted = {i for i, t in held.items() if any(r <= t for r in rules)}
    got = {r.page_id: (r.verdict, r.mined_rule) for r in url_filter.filter_urls(df, labels, min_count=6).collect()}
    assert rules and {i for i, (v, _) in got.items() if v == "block"} == wanted
    assert all(set(rule.split(" ")) in [r for r in rules if r <= held[i]] for i, (v, rule) in got.items() if v == "block")


def test_long_and_odd_urls(spark):
    pages = [(1, "http://a.org/" + "x/" * 20_000), (2, "://"), (3, ""), (None, "http://b.net/es/"), (4, "http://é.net/fr/ü?" + "k=v&" * 5000)]
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    assert got == {1: ("a.org", None, "allow"), 2: ("", None, "allow"), 3: ("", None, "allow"), None: ("b.net", "net/es/", "block"), 4: ("é.net", "net/fr/", "block")}
