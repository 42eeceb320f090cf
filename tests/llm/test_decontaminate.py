import hashlib
import random
import re

import pytest
from framewright.llm import decontaminate as dc

WORD = re.compile(dc.WORD)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, window=13):
    out = []
    windows = set()
    for item, text in items:
        w = words(text)
        if w:
            windows |= {(item, tuple(w[i : i + window])) for i in range(max(len(w) - window, 0) + 1)}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, run in windows:
            n = len(run)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == run:
                    hit |= set(range(i, i + n))
                    found |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def make(seed):
    rng = random.Random(seed)
    few = ["the", "of", "É", "éa", "x1"]
    text = lambda n: " ".join(rng.choice(few) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 9, 13, 14, 30, 60]))) for i in range(14)]
    items += [(3, items[5][1].upper()), (None, text(20)), (7, None), (8, ""), (9, "!!"), (20, items[0][1])]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            t = words(rng.choice(items)[1] or "")
            lo = rng.randrange(len(t) + 1) if t and rng.random() < 0.3 else 0
            parts += ["; ".join(t[lo:]), text(rng.randrange(9))]
        docs.append((i, " ".join(parts).title() if i % 3 == 0 else ",".join(parts)))
    docs += [(100, None), (101, ""), (102, "?!"), (None, items[8][1]), (5, items[7][1]), (5, items[7][1]), (103, "the " * 3000 + (items[12][1] or ""))]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(a, b, "c", 1) for a, b in docs], "doc_id LONG, text STRING, item_id STRING, n_words INT")
    b = spark.createDataFrame([(a, t, 2) for a, t in items], "item_id LONG, text STRING, doc_id INT")
    return d, b


def run(spark, docs, items, **kw):
    rows = dc.decontaminate(*frames(spark, docs, items), **kw).drop("text_key").collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    docs, items = make(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_shuffled_index_gives_the_same(spark, monkeypatch):
    docs, items = make(3)
    monkeypatch.setattr(dc, "small_side", lambda df, rows=0: (df, False))
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = make(4)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_clean_documents(spark):
    docs, items = make(5)
    d, b = frames(spark, docs, items)
    left = dc.clean_documents(d, dc.decontaminate(d, b))
    assert left.columns == d.columns
    want = sorted((r[0] for r in brute(docs, items) if not r[5]), key=str)
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == want
