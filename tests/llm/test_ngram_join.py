import random

import numpy as np
import pytest
from framewright.llm import ngram_join as nj


def sets_of(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)} if w else set()


def brute(rows, size, percent):
    sets = [sets_of(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted(((i, len(sets[k]), low.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def make(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)] + ["É", "été"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    while len(rows) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 4, 8, 11, 12, 20, 45, 90, 200, 600]))]
        if rng.random() < 0.3:
            words += passage
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(words)
            for _ in range(rng.randrange(max(len(words) // 12, 1) + 1)):
                at = rng.randrange(len(copy) + 1)
                change = rng.random()
                if change < 0.4:
                    copy.insert(at, rng.choice(vocabulary))
                elif copy and change < 0.7:
                    del copy[at - 1]
                elif copy:
                    copy[at - 1] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.02 and w.isascii() else w for w in copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[5][1]), (903, rows[9][1]), (9, rows[9][1]), (905, "x y z " * 20_000), (906, "x y z " * 20_001), (907, "a\u00a0b"), (5, "other text of this id")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id LONG, text STRING, row STRING, n INT, component_id STRING")


@pytest.mark.parametrize("seed, size, percent", [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_brute_force(spark, seed, size, percent):
    rows = make(seed)
    got = nj.near_copies(frame(spark, rows), size, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, size, percent)


def cloud(seed, n=240):
    """Texts of one base with changes that are too many for most pairs to link, some of them with a passage all others have too."""
    rng = random.Random(seed)
    base, passage = [f"b{i}" for i in range(120)], [f"p{i}" for i in range(40)]
    rows = []
    for k in range(n):
        words = list(base) if k % 3 else [f"o{k}_{i}" for i in range(80)]
        for _ in range(rng.choice([3, 4, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(words + passage)))
        if k % 20 == 1:
            rows.append((1000 + k, " ".join(words + passage[:-1])))
    return rows


def test_pairs_of_a_cloud(spark, monkeypatch):
    rng, rows, found, stored = random.Random(4), [], {}, nj.stored
    for k in range(240):  # each one links with the base, which is not there, and hardly any two with each other
        words = [f"b{i}" for i in range(150)]
        for _ in range(2):
            words[rng.randrange(150)] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))

    def counted(df, label):
        out = stored(df, label)
        found[label] = found.get(label, 0) + (out.count() if label in ("join-near", "join-rest") else 0)
        return out

    monkeypatch.setattr(nj, "stored", counted)
    got = nj.near_copies(frame(spark, rows), 5, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 5, 80)
    assert found["join-near"] + found["join-rest"] <= 4 * len(rows)  # 7763 with the joins by key and by leader


@pytest.mark.parametrize("size, percent", [(5, 80), (1, 60)])
def test_groups_of_many_rounds(spark, monkeypatch, size, percent):
    monkeypatch.setattr(nj, "FEW", 2)
    rows = make(7, 90) + [(2000 + i, t) for i, t in cloud(8, 60)]
    got = nj.near_copies(frame(spark, rows), size, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, size, percent)


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    with np.errstate(over="ignore"):
        for _ in range(1500):
            n = int(rng.choice([1, 2, 5, 8, 9, 10, 17, 18, 30, 60, 150, 500]))
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            most = int(len(x) * (100 - percent) / percent) + 1
            drop, add = rng.integers(0, most + 1, 2)
            y = np.unique(np.concatenate([rng.permutation(x)[min(drop, len(x) - 1) :], rng.integers(0, 2**64, add, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                (a, need_a), (b, need_b) = nj.signatures(x, percent), nj.signatures(y, percent)
                same, at_a, at_b = np.intersect1d(a, b, return_indices=True)
                assert len(same) >= np.maximum(need_a[at_a], need_b[at_b]).min(initial=10**9 if not len(same) else 10**6)


def test_allocation_covers_every_band():
    for percent in (50, 80, 90):
        for index in range(60):
            m, k, skip = nj.allocation(index, percent)
            most = nj.band_of(index)[1] * (100 - percent) // percent
            cheapest = m - skip if k <= skip else m + k - 2 * skip  # differences that fail all but `skip` segments
            assert k <= m and cheapest >= most + 1


def test_chain_and_one_of_each(spark):
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[i * 3 : i * 3 + 120]) for i in range(40)]  # neighbours link, ends do not
    rows = [(i + 10, t) for i, t in enumerate(chain)] + [(1, None), (2, ""), (2, ""), (3, "alone here"), (10, chain[0]), (10, chain[0])]
    docs = frame(spark, rows)
    judged = nj.near_copies(docs, 3, 90)
    got = {r["component_id"] for r in judged.where("doc_id >= 10").collect()}
    assert got == {10}
    left = nj.one_of_each(docs, judged)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in left.collect()) == [(1, ""), (2, ""), (2, ""), (3, "alone here"), (10, chain[0])]


def test_empty(spark):
    docs = frame(spark, [])
    assert nj.near_copies(docs).count() == 0
    assert nj.one_of_each(docs, nj.near_copies(docs)).count() == 0
