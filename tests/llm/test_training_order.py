import hashlib

import numpy as np
import pytest
from framewright.llm import training_order as to


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4096, 4097])
def test_feistel_is_a_permutation(n):
    out = to.feistel(np.arange(n), n, key=5)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 1000 or (out != to.feistel(np.arange(n), n, key=6)).mean() > 0.9
    assert n < 1000 or abs(np.corrcoef(out, np.arange(n))[0, 1]) < 0.15


def test_round_trip(spark, tmp_path):
    texts = [(i, f"Text number {i}: " + "word après mot " * (i % 40)) for i in range(200)]
    texts += [(500, None), (501, ""), (None, "no id"), (7, texts[7][1]), (600, "long " * 300_000)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in texts], "doc_id LONG, text STRING, slot INT, tokens STRING").repartition(4)
    out = str(tmp_path / "order")
    rows = to.materialize_order(docs, out, length=64, per_shard=50).toPandas().sort_values("slot")
    n = len(rows)
    assert rows["slot"].tolist() == list(range(n)) and sorted(rows["seq"]) == list(range(n))
    assert (rows["shard"] == rows["slot"] // 50).all() and (rows["offset"] == rows["slot"] % 50 * 128).all()
    assert (rows["slot"].to_numpy() == to.feistel(rows["seq"].to_numpy(), n, 20_240_601)).all()
    read = list(to.read_slots(out, 0, n))
    assert [hashlib.sha256(x.tobytes()).hexdigest() for x in read] == rows["sha256"].tolist()
    stream = np.concatenate([read[s] for s in rows.sort_values("seq")["slot"]])[: rows["n_tokens"].sum()]
    enc = to._encoding(to.default_tokenizer())
    found, at = [], 0
    for end in np.flatnonzero(stream == 50_256):
        found.append(enc.decode(stream[at:end].tolist()))
        at = end + 1
    assert at == len(stream)
    assert sorted(found) == sorted(t for _, t in texts if t)
    in_order = list(dict.fromkeys(d for ids in rows.sort_values("seq")["doc_ids"] for d in ids))
    assert set(in_order) == {i if i is not None else -1 for i, t in texts if t}
    assert [x.tolist() for x in to.read_slots(out, n - 3, 10)] == [x.tolist() for x in read[-3:]]


def test_long_text_is_encoded_in_pieces(monkeypatch):
    text = "some words here " * 500 + "x" * 900
    monkeypatch.setattr(to, "PIECE", 100)
    enc = to._encoding(to.default_tokenizer())
    assert enc.decode(to.encode(text, to.default_tokenizer()).tolist()) == text


def test_nothing_to_write(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id LONG, text STRING")
    assert to.materialize_order(docs, str(tmp_path / "none")).count() == 0
    assert list(to.read_slots(str(tmp_path / "none"), 0, 5)) == []
    assert to.materialize_order(docs.where("false")).count() == 0
