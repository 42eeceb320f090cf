import collections
import math
import random
import zlib

import numpy as np
import pytest
from framewright.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def brute_ids(text):
    folded = "  " + "".join(c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in text.lower()) + "  "
    raw = folded.encode()
    return {raw[i : i + n] for n in tx.SIZES for i in range(len(raw) - n + 1) if b"  " not in raw[i : i + n]}


def test_ngrams_by_hand():
    texts = ["You idiot!! you", None, "", "été trash", "aaaaaaa", "x"]
    for t, ids in zip(texts, tx.ngram_ids(texts, np.ones(1 << 18, bool))):
        assert ids.tolist() == sorted({plain_hash(g, 18) for g in brute_ids(t or "")})


def test_long_texts_in_parts():
    text = "déjà vu idiot " * 3000 + "unique ending"
    whole = tx.ngram_ids([text, "kind"], np.ones(1 << 18, bool), most=10_000_000)
    parts = tx.ngram_ids([text, "kind"], np.ones(1 << 18, bool), most=997)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def plain_hash(raw, bits):
    h = 0
    for b in raw:
        h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
    h ^= len(raw) * 0x9E3779B1 & 0xFFFFFFFF
    h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
    return h >> (32 - bits)


def test_model_and_scores_against_a_plain_computation(spark):
    """Counts, kept n-grams, ratios and the optimum of the fit, each anew."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choices(["good", "day", "sun", "idiot" if i % 3 == 0 else "rain"], k=9)), int(i % 3 == 0)) for i in range(240)]
    rows += [("copied words", 0)] * 50
    bits, l2 = 16, 1e-2
    model = tx.train(spark.createDataFrame(rows, "text STRING, toxic INT"), bits=bits, l2=l2, steps=4000, folds=1)
    sets = [{plain_hash(g, bits) for g in brute_ids(t)} for t, _ in rows]
    y = np.array([t for _, t in rows])
    n = [(y == 0).sum(), (y == 1).sum()]
    counts = [collections.Counter(f for s, t in zip(sets, y) if t == c for f in s) for c in (0, 1)]
    ratio = {}
    for f in counts[0].keys() | counts[1].keys():
        q, p = (counts[0][f] + 1) / (n[0] + 2), (counts[1][f] + 1) / (n[1] + 2)
        b = (counts[0][f] + counts[1][f] + 2) / (len(y) + 4)
        if abs(p - q) / math.sqrt(b * (1 - b) * (1 / n[0] + 1 / n[1]) + 1e-12) >= 3 and abs(math.log(p / q)) >= 0.7:
            ratio[f] = math.log(p / q)
    ids = sorted(ratio)
    assert set(np.flatnonzero(model.weights).tolist()) <= set(ids)
    x = np.array([[ratio[f] if f in s else 0.0 for f in ids] for s in sets])
    w = np.array([model.weights[f] / ratio[f] for f in ids])
    each = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    score = 1 / (1 + np.exp(-(x @ w + model.bias)))
    assert np.abs(x.T @ (each * (score - y)) + l2 * w).max() < 1e-4 and abs((each * (score - y)).sum()) < 1e-4
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i INT, text STRING")
    got = texts.select("i", tx.score_column(model, texts["text"]).alias("s")).toPandas().sort_values("i")["s"].to_numpy()
    assert np.allclose(got, score, atol=1e-5)


def test_held_out_recall_at_scale(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = tx.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    test = got[got["held_out"]]
    toxic = test["toxic"] == 1
    assert (test["predicted"][toxic] == 1).mean() >= 0.9
    assert (test["predicted"][~toxic] == 0).mean() >= 0.97


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return tx.classify(docs, labels).toPandas(), labels.toPandas()


def test_held_out_accuracy(judged):
    got, labels = judged
    assert [bool(h) for h in got["held_out"]] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]
    test = got[got["held_out"]].merge(labels, on="doc_id")
    ranks, toxic = test["score"].rank(), test["toxic"] == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.9
    assert (test["predicted"][~toxic] == 0).mean() > 0.97
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()


def test_edges(spark):
    rows = [(i, ("you idiot " if i % 2 else "kind words ") + "and more text" * (i % 3)) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "you idiot"), (3, "you idiot"), (3, "you idiot"), (202, "you idiot " * 200_000)]
    docs = spark.createDataFrame([(i, t, 9, "s") for i, t in rows], "doc_id LONG, text STRING, toxic INT, score STRING")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (4, None), (5, 7)], "doc_id LONG, toxic INT")
    got = tx.classify(docs, labels).toPandas()
    assert len(got) == len(rows)
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    assert by.loc[200, "score"] == by.loc[201, "score"] and by.loc[202, "predicted"] == 1 and by.loc[78, "predicted"] == 0
    assert not got[got["doc_id"].isna()]["held_out"].any()
    left = tx.drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == (got["score"] < 0.7).sum()
    none = tx.classify(docs, labels.where("false")).toPandas()
    assert (none["score"] < 1e-6).all()
    assert tx.classify(docs.where("false"), labels).count() == 0
    one = tx.classify(docs, labels.where("toxic = 1")).toPandas()
    assert (one["score"] > 0.999).all()
