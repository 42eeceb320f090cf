import math

import pytest
from framewright.llm import mixing

SCHEMA = "doc_id LONG, text STRING, source STRING, size STRING, target STRING, row STRING"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in rows], SCHEMA)


def shares(sizes, weights=(5, 2, 1), share=1.5, repeat=2):
    """Targets by repeated resharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        level = (budget - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= repeat * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: repeat * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100, "d": 100}, {"a": 1000, "b": 10, "c": 10}, {"a": 3, "b": 500, "é": 40, None: 70}, {"a": 0, "b": 9},
    {"only": 50},
])
def test_targets_and_taken(spark, sizes):
    rows, n = [], 0
    for s, words in sizes.items():
        while words > 0:
            k = min(words, 1 + n % 7)
            rows.append((n, " \t".join(["w"] * k) + "\n", s))
            n, words = n + 1, words - k
        rows.append((n, None, s))
        n += 1
    got = mixing.mix(docs_of(spark, rows)).toPandas()
    assert len(got) == len(rows)
    want = shares(sizes)
    source = {i: s for i, _, s in rows}
    for s, target in want.items():
        mine = got[got["doc_id"].map(lambda i: source[i] == s)]
        assert (mine["source_size"] == sizes[s]).all()
        assert all(math.isclose(t, target, rel_tol=1e-12, abs_tol=1e-9) for t in mine["target"])
        assert abs(mine["taken"].sum() - target) <= 0.5
        assert (mine["taken"] <= 2 * mine["size"]).all()
        whole = target // sizes[s] if sizes[s] else 0
        assert (mine["taken"] >= whole * mine["size"]).all()


def test_reruns_and_bucket_count_agree(spark):
    rows = [(i, "w " * (i % 11), "s" + str(i % 4)) for i in range(300)]
    key = lambda df: sorted(map(tuple, df.toPandas().itertuples(index=False)))
    a = key(mixing.mix(docs_of(spark, rows)))
    assert a == key(mixing.mix(docs_of(spark, rows[::-1]).repartition(5)))
    assert a == key(mixing.mix(docs_of(spark, rows), buckets=3))


def test_quality_is_preferred(spark):
    rows = [(i, "w", "s" + str(i % 2)) for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(2000)] + [(None, 1), (1, None)], "doc_id LONG, quality INT")
    got = mixing.mix(docs_of(spark, rows), mixing.quality_weights(labels), share=0.5).toPandas()
    some = got[(got["part"] > 0)]
    good = (some["doc_id"] % 4 < 2).mean()
    assert 0.55 < good < 0.95


def test_edges_and_mixture(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (2, "", "x"), (3, None, "x"), (4, "q  r\ts t u", "y")]
    docs = docs_of(spark, rows)
    mixed = mixing.mix(docs)
    table = mixed.toPandas()
    out = mixing.mixed_documents(docs, mixed)
    assert out.columns == docs.columns
    texts = [r["text"] for r in out.collect()]
    words = sum(len((t or "").split()) for t in texts)
    assert words == table["taken"].sum()
    assert texts.count("") == 1 and texts.count(None) == 1
    assert mixing.mixed_documents(docs_of(spark, []), mixing.mix(docs_of(spark, []))).count() == 0


def test_first_words_keeps_white_space(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a  b\tc d", 3), ("x" * 9, 1)], "t STRING, n INT")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == [" a  b\tc", "x" * 9]


def test_hot_source_is_cut(spark):
    """No bucket of a large source holds more than a small share of it."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'w w' AS text", "'hot' AS source")
    got = mixing.mix(docs).agg({"taken": "sum"}).first()[0]
    assert got == 60_000
