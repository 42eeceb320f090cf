"""Registered queries of the subpackage: SQL where there is some, shape of the rest."""

import corpus_pipeline
import duckdb
import pytest
from check_oracle import canon, connect
from framewright.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_sql(spark, name):
    got = LLM_QUERIES[name](spark, SF).toPandas()
    want = connect(SF).execute(LLM_ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against sets computed by hand."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "training_order",
    ]
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == columns
    scores = LLM_QUERIES["op7_toxicity"](spark, SF).toPandas().set_index("doc_id")["score"]
    kept = {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert kept == set(scores.index[scores < 0.7])

    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    sets = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    single = stages["ngram_jaccard_join"](spark, clean, SF)
    assert single.columns == columns
    left = single.toPandas()
    assert sorted(left["doc_id"]) == sorted({root(i) for i in ids})
    assert dict(zip(left["doc_id"], left["text"])) == {i: texts[i] for i in left["doc_id"]}

    con = duckdb.connect()
    con.register("documents", left)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    judged = con.execute(LLM_ORACLES["op3_benchmark_decontamination"]).fetchdf()
    single = spark.createDataFrame(left)
    fine = stages["benchmark_decontamination"](spark, single, SF)
    assert sorted(r["doc_id"] for r in fine.collect()) == sorted(judged["doc_id"][~judged["contaminated"]])

    mixed = stages["source_mixing"](spark, fine, SF).toPandas()
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in fine.collect()}
    assert list(mixed.columns) == columns
    words = mixed["text"].map(lambda t: len((t or "").split())).sum()
    assert abs(words - 1.5 * sum(sizes.values())) <= fine.select("source").distinct().count()
    rows = stages["training_order"](spark, spark.createDataFrame(mixed), SF).toPandas()
    assert sorted(rows["slot"]) == list(range(len(rows)))
    assert {d for ids in rows["doc_ids"] for d in ids} == set(mixed["doc_id"][mixed["text"].fillna("") != ""])
