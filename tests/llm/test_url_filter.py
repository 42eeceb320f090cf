import itertools
import random
import re

from framewright.llm import url_filter as uf
from pyspark.sql import functions as F

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM", "https://www.example.com/en/1?x=/de/", "http://example.com/en", "http://example.com/en/",
    "http://x.example.com/en/5#t", "http://notexample.com/en/5", "http://badnet/es/1", "http://a.net/es/1", "http://a.net/fr/", "http://a.net/de/", "http://net/es/",
    "http://a.com?q=://b.net/es/", "http://a.com#f", "x://y://z/es/", "http://www.example.com/de/4", "http://b.www.example.com/en/é", "ftp://u@h.org:80/p",
    "http://É.net/es/", "http://a.org/" + "p/" * 5000,
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in uf.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_listed_rules(spark):
    rows = [(i, u, "h", "p", "t") for i, u in enumerate(URLS)] + [(None, URLS[5], "h", "p", "t"), (5, URLS[5], "h", "p", "t")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, host STRING, tokens STRING, token STRING")
    got = uf.judge(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(URLS[r["page_id"] if r["page_id"] is not None else 5])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_mined_combination(spark):
    """Tokens that mean block only together are found, and decide URLs no list has."""
    rows, labels = [], []
    for i in range(400):
        host = ("spam-shop" if i % 2 else "news") + f".s{i % 7}.org"
        path = "/win/" if i % 4 < 2 else "/read/"
        rows.append((i, f"http://{host}{path}{i}"))
        if i < 300:
            labels.append((i, int(i % 2 == 1 and i % 4 < 2)))
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING")
    marks = spark.createDataFrame(labels + [(None, 1)], "doc_id LONG, toxic INT")
    got = uf.judge(pages, marks, support=0.02, confidence=0.9).toPandas().set_index("page_id")
    for i in range(300, 400):
        assert got.loc[i, "verdict"] == ("block" if i % 2 == 1 and i % 4 < 2 else "allow")
    assert (got["confidence"].dropna() >= 0.9).all()


def test_rules_against_counts(spark):
    data = [(["a", "b"], True)] * 9 + [(["a"], False)] * 5 + [(["a", "b", "c"], True)] * 3 + [(["b"], False)] * 2 + [(["c"], True)]
    mined = uf.mine(spark.createDataFrame(data, "tokens ARRAY<STRING>, block BOOLEAN"), support=0.05, confidence=0.8).collect()
    found = {(tuple(sorted(r["tokens"])), r["verdict"]): r["confidence"] for r in mined}
    for (tokens, verdict), c in found.items():
        rows = [b for t, b in data if set(tokens) <= set(t)]
        assert c == sum(b == (verdict == "block") for b in rows) / len(rows) >= 0.8
    assert (("a", "b"), "block") in found and (("c",), "block") in found
    assert (("a", "c"), "block") not in found  # no better than ("c",)


def test_rules_of_any_length_against_all_combinations(spark):
    """Every confident combination that no part beats, also of four and more tokens; tokens that go together are one item."""
    rng = random.Random(3)
    data = []
    for _ in range(120):
        tokens = [t for t in "abcde" if rng.random() < 0.75]
        tokens += ["x", "y"] * (rng.random() < 0.4)
        data.append((tokens or ["a"], set("abcd") <= set(tokens) or rng.random() < 0.1))
    rules, items = uf.mined_rules(spark.createDataFrame(data, "tokens ARRAY<STRING>, block BOOLEAN"), 0.05, 0.85)
    of = {r["token"]: r["item"] for r in items.collect()}
    assert of["y"] == of["x"] == "x"
    want = {}
    for k in range(1, 7):
        for combo in itertools.combinations("abcdex", k):
            rows = [b for t, b in data if set(combo) <= set(t)]
            for verdict in (True, False):
                both = sum(b == verdict for b in rows)
                if both >= 0.05 * len(data) and both / len(rows) >= 0.85:
                    want[combo, verdict] = both / len(rows)
    kept = {r for r in want if not any(set(p) < set(r[0]) and v == r[1] and want[p, v] >= want[r] for p, v in want)}
    got = {(tuple(sorted(r["tokens"])), r["verdict"] == "block"): r["confidence"] for r in rules.collect()}
    assert set(got) == kept and all(got[r] == want[r] for r in got)
    assert max(len(r[0]) for r in kept) >= 4


def test_long_repeated_url_and_many_labels(spark):
    """Forty parts a hundred times over, six of them shared with other URLs, and a rule on the longest host suffix."""
    path = "/".join(f"p{i}" for i in range(40))
    rows = [(i, f"http://a.org/{path}") for i in range(100)] + [(100 + i, f"http://b{i}.org/p{i % 6}/other") for i in range(100)]
    deep = ".".join(f"l{i}" for i in range(12)) + ".org"
    rows += [(200 + i, f"http://{'x' if i % 2 else 'y'}.{deep}/q") for i in range(100)]
    marks = [(i, int(i < 100 or (i >= 200 and i % 2))) for i in range(300) if i % 10]
    got = uf.judge(spark.createDataFrame(rows, "page_id LONG, url STRING"), spark.createDataFrame(marks, "doc_id LONG, toxic INT"), support=0.02)
    got = got.toPandas().set_index("page_id")
    assert (got.loc[range(100), "verdict"] == "block").all() and (got.loc[range(100, 200), "verdict"] == "allow").all()
    assert all(got.loc[200 + i, "verdict"] == ("block" if i % 2 else "allow") for i in range(100))
    one = spark.range(1).select(uf.url_tokens(F.lit(deep), F.lit("/")).alias("t")).first()["t"]
    assert "under=" + deep in one


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id LONG, url STRING")
    assert uf.judge(pages, spark.createDataFrame([], "doc_id LONG, toxic INT")).count() == 0
    assert pages.select(F.size(uf.url_tokens(F.lit("a.b"), F.lit("/")))).count() == 0
