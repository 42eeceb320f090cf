import numpy as np
import pytest
from framewright.llm import embedding_dedup as ed
from pyspark.sql import functions as F

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, component STRING, same INT"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 0) for i, v in rows], SCHEMA)


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    place = [k for k, (i, v) in enumerate(rows) if any(i == g and v is not None and len(v) == len(x) and np.array_equal(np.array(v, np.float32), x) for g, x in good)]
    xs = [np.array(rows[k][1], np.float32).astype(float) for k in place]
    for a in range(len(place)):
        for b in range(a):
            if len(xs[a]) == len(xs[b]) and xs[a] @ xs[b] / np.linalg.norm(xs[a]) / np.linalg.norm(xs[b]) >= threshold:
                links[place[a]].append(place[b]), links[place[b]].append(place[a])
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for y in links[todo.pop()]:
                if y not in seen:
                    seen.add(y), todo.append(y)
        low = min((rows[y][0] for y in seen if rows[y][0] is not None), default=None)
        out.append((i, len(links[k]), low, i is None or i == low))
    return sorted(out, key=str)


def groups(seed, sizes, dim=32, spread=0.12):
    rng = np.random.default_rng(seed)
    rows = []
    for n in sizes:
        c = rng.standard_normal(dim)
        rows += [(c + spread * rng.standard_normal(dim) * (k > 0)).astype(np.float32).tolist() for k in range(n)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("sizes, spread, more", [
    ([1] * 60 + [2] * 20 + [9, 30], 0.12, {}), ([150] + [1] * 40, 0.2, {"rounds": 1}), ([1] * 60 + [2] * 20 + [9, 30], 0.12, {"rounds": 0}),
])
def test_brute_force(spark, sizes, spread, more):
    rows = groups(3, sizes, spread=spread)
    got = sorted((tuple(r) for r in ed.near_duplicates(frame(spark, rows), window=8, block=32, **more).collect()), key=str)
    assert got == brute(rows)


def test_edges(spark):
    rows = groups(5, [3, 1], dim=4, spread=0.01)
    rows += [(90, None), (91, [0.0] * 4), (92, [1.0, None, 0.0, 0.0]), (93, [float("nan"), 1.0, 0.0, 0.0]), (94, [float("inf"), 1.0, 0.0, 0.0]), (95, []), (None, rows[0][1]),
             (96, [1.0, 0.0]), (97, [1e-30, 0.0]), (98, [0.0, 1.0]), (99, rows[0][1]), (100, rows[0][1]), (101, [-0.0, 1.0])]
    got = sorted((tuple(r) for r in ed.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert ed.near_duplicates(frame(spark, [])).count() == 0
    assert ed.near_duplicates(frame(spark, [(1, None)])).collect()[0]["kept"]


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold among many strangers."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a, b = rng.standard_normal(64), rng.standard_normal(64)
        b -= a * (a @ b) / (a @ a)
        b *= np.linalg.norm(a) / np.linalg.norm(b)
        c = rng.uniform(0.951, 0.99)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + (1 - c * c) ** 0.5 * b).tolist())]
    rows += [(1000 + i, rng.standard_normal(64).tolist()) for i in range(1500)]
    got = ed.near_duplicates(frame(spark, rows)).agg(F.sum("n_links")).first()[0]
    assert got >= 0.99 * 800


def test_passes_find_the_links_themselves(spark):
    """No exact blocks: what the windows alone find, and that the compared pairs do not grow with the square."""
    rng = np.random.default_rng(2)
    a = rng.standard_normal((3000, 64))
    b = a[:600] + 0.3 * rng.standard_normal((600, 64))
    x = np.concatenate([a, b]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(i, i + 3000) for i in range(600) if u[i] @ u[i + 3000] >= 0.95}
    classes = spark.createDataFrame([(i, 64, v.tolist()) for i, v in enumerate(x)], "vec_id LONG, dim INT, embedding ARRAY<FLOAT>")
    links, left = ed.window_links(classes, 0.95, 32, 10, 8, 0.001, 11)
    found = {(r["a"], r["b"]) for r in links.collect()}
    assert len(want) > 300 and len(want & found) >= 0.99 * len(want)
    assert left.count() < 60


def test_chance_of_agreement():
    rng = np.random.default_rng(1)
    line, offset = rng.standard_normal(200_000), rng.uniform(0, 1.2, 200_000)
    same = np.floor(offset / 1.2) == np.floor((0.3 * line + offset) / 1.2)
    assert abs(same.mean() - ed.agreement(0.3, 1.2)) < 0.005


def test_no_pair_is_lost_in_a_dense_group(spark):
    """Pairs just above the threshold among strangers that share a direction, so that no sign of a projection splits them."""
    rng = np.random.default_rng(4)
    near, strangers, dim = 200, 5600, 64
    common = rng.standard_normal(dim)
    common /= np.linalg.norm(common)

    def away(n):
        v = rng.standard_normal((n, dim))
        v -= (v @ common)[:, None] * common
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def turned(v):  # mutual cosine about 0.8
        return (0.8**0.5 * common + 0.2**0.5 * v).astype(np.float32)

    one, other = away(near), away(near)
    other -= (one * other).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.76, 0.8, (near, 1))  # cosine 0.952 to 0.96
    x = np.concatenate([turned(one), turned(c * one + (1 - c * c) ** 0.5 * other), turned(away(strangers))])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert links[: 2 * near].min() >= 1
    order = rng.permutation(len(x))
    got = ed.near_duplicates(frame(spark, [(int(k), x[i].tolist()) for k, i in enumerate(order)])).toPandas().set_index("vec_id")
    assert (got.loc[np.arange(len(x)), "n_links"].to_numpy() == links[order]).all()
