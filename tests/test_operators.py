"""Small cases with known answers, and skewed cases against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import boxes as B
from framewright.functions import geometry3d as G
from framewright.functions.hashes import image_hashes
from framewright.functions.joins import self_iou_counts, self_iou_join
from framewright.model import Dataset, checked_labels
from framewright.operators import cloud, dedupe, fusion, neighbors, octree, qa, split, sync
from framewright.operators.ranking import chunked, dense_ids, exact_quantile, with_rank
from framewright.sinks import labels as S
from framewright.sources import labels as R
from framewright.sources import points as P
from framewright.sources import registry, yolo
from framewright.sources.files import detect_formats, numbered_lines
from framewright.sources.records import xml_records

LABEL = "sample_id INT, label_index INT, class_name STRING, class_id INT, cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE, confidence DOUBLE"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def qa_dataset(spark):
    car, person = ("car", 0), ("person", 1)
    boxes = [
        (1, 0, *car, .5, .5, .2, .2), (3, 0, *car, .5, .5, .2, .2), (3, 1, *person, .52, .52, .2, .2),
        (3, 2, *car, .5, .5, .2, .2), (4, 0, *car, .95, .5, .2, .2), (5, 0, *car, .5, .5, .01, .01),
        (6, 0, *car, .5, .5, .96, .96), (7, 0, *car, .5, .5, .2, .2),
    ]
    labels = spark.createDataFrame([(*b, 1.0) for b in boxes], LABEL)
    samples = spark.createDataFrame(
        [(i, i, f"/d/img{i}.jpg") for i in range(1, 8)], "sample_id INT, ordinal INT, image_path STRING"
    )
    classes = spark.createDataFrame([(0, "car"), (1, "person")], "class_id INT, class_name STRING")
    return Dataset(samples, labels, classes)


def test_qa_counts(spark):
    ds = qa_dataset(spark)
    disk = ds.samples.where("sample_id < 7").select(F.col("image_path").alias("path"))
    got = dict(qa.run(ds, disk).groupBy("issue_type").count().collect())
    assert got == {
        "missing_labels": 1, "missing_image": 1, "overlapping_boxes": 1, "duplicate_label": 1,
        "out_of_bounds": 1, "tiny_box": 1, "huge_box": 1,
    }
    assert qa.run(ds, disk, ["nothing"]).count() == 0
    with pytest.raises(ValueError):
        qa.run(ds, disk, iou_threshold=1.5)


def test_qa_imbalance(spark):
    ds = qa_dataset(spark)
    assert qa.class_imbalance(ds, 10.0).count() == 0  # 7 to 1
    assert [r["class_name"] for r in qa.class_imbalance(ds, 6.0).collect()] == ["person"]


def test_model_rules(spark):
    bad = spark.createDataFrame([(1, 0, "a", -1, .5, .5, .1, .1, 1.0)], LABEL)
    with pytest.raises(Exception, match="class_id must be"):
        checked_labels(bad).collect()
    wide = spark.createDataFrame([(1, 0, "a", 0, 1.5, -.5, .1, .1, 7.0)], LABEL)
    r = checked_labels(wide).first()
    assert (r["cx"], r["cy"], r["confidence"]) == (1.0, 0.0, 1.0)


@pytest.mark.parametrize("a,b,want", [
    ((0, 0, 100, 100), (0, 0, 100, 100), 1.0), ((0, 0, 10, 10), (20, 20, 30, 30), 0.0),
    ((0, 0, 100, 100), (50, 50, 150, 150), 2500 / 17500), ((0, 0, 100, 100), (25, 25, 75, 75), .25),
    ((0, 0, 10, 10), (10, 0, 20, 10), 0.0),
])
def test_iou(spark, a, b, want):
    cols = [tuple(F.lit(float(v)) for v in box) for box in (a, b)]
    assert spark.range(1).select(B.iou(*cols)).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.8])
def test_iou_join_hot_group(spark, threshold):
    """One sample holds most boxes; cells must find exactly the pairs of the plain search."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(240):
        sample = 1 if i % 6 else 2 + i
        cx, cy = rng.uniform(0, 1, 2)
        w, h = np.exp(rng.uniform(np.log(.01), np.log(.6), 2))
        if i % 5 == 0 and data:
            _, _, x1, y1, x2, y2 = data[-1]
            data.append((sample, i, x1 + .004, y1, x2, y2 - .003))
        else:
            data.append((sample, i, cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2))
    df = spark.createDataFrame([tuple(float(v) if k > 1 else int(v) for k, v in enumerate(r)) for r in data],
                               "s INT, i INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")

    def iou(a, b):
        ix, iy = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        if ix <= 0 or iy <= 0:
            return 0.0
        u = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - ix * iy
        return ix * iy / u

    want = sorted(
        (a[1], b[1]) for a in data for b in data
        if a[0] == b[0] and a[1] < b[1] and iou(a, b) >= threshold
    )
    got = self_iou_join(df, ["s"], "i", threshold, hot_rows=10).select("l.i", "r.i")
    assert rows(got) == want


def test_split_sizes(spark):
    data = [(i, i, f"/data/img{i:03d}.jpg") for i in range(100)]
    samples = spark.createDataFrame(data, "sample_id INT, ordinal INT, image_path STRING")
    labels = spark.createDataFrame(
        [(i, 0, "car" if i < 70 else "person", int(i >= 70), .5, .5, .2, .2, 1.0) for i in range(100)], LABEL)
    plain = dict(split.split_random(samples, {"train": .8, "val": .2}, 1).groupBy("assigned").count().collect())
    assert plain == {"train": 80, "val": 20}
    got = split.split_stratified(Dataset(samples, labels), {"train": .8, "val": .1, "test": .1}, 1)
    per = {(r[0], r[1]): r[2] for r in got.groupBy("stratum", "assigned").count().collect()}
    assert per == {("car", "train"): 56, ("car", "val"): 7, ("car", "test"): 7,
                   ("person", "train"): 24, ("person", "val"): 3, ("person", "test"): 3}
    folds = dict(split.kfold(samples.where("sample_id < 23"), 5, 1).groupBy("fold").count().collect())
    assert folds == {0: 5, 1: 5, 2: 5, 3: 4, 4: 4}
    assert dict(split.kfold(samples.where("sample_id < 3"), 5, 1).groupBy("fold").count().collect()) == {0: 1, 1: 1, 2: 1}
    with pytest.raises(ValueError):
        split.normalize_ratios({"a": -1.0})


def test_rank_and_chunks_hot_key(spark):
    data = [("hot" if i % 3 else f"k{i}", (i * 37) % 1000) for i in range(1000)]
    df = spark.createDataFrame(data, "k STRING, v INT")
    got = with_rank(df, ["k"], [F.col("v")], F.floor(F.col("v") / 100), "r", "n")
    seen = {}
    for k, v, r, n in sorted(tuple(x) for x in got.select("k", "v", "r", "n").collect()):
        assert r == seen.get(k, 0)
        seen[k] = r + 1
    parts = chunked(got, "r", 50, before=4, after=1)
    assert parts.where("_own").count() == 1000
    assert parts.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 55


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert rows(dense_ids(df, [F.col("v")], "n").select("v", "n")) == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("q", [0.0, 0.12, 0.5, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(5)
    data = [("a" if i % 4 else "b", float(rng.choice([1.5, 2.5, rng.uniform(-5, 50)]))) for i in range(501)]
    got = {r["k"]: r["quantile"] for r in exact_quantile(
        spark.createDataFrame(data, "k STRING, v DOUBLE"), ["k"], "v", q, bins=16).collect()}
    for k in "ab":
        assert got[k] == pytest.approx(np.quantile([v for kk, v in data if kk == k], q))


def pattern(seed):
    y, x = np.mgrid[0:96, 0:96]
    rng = np.random.default_rng(seed)
    a, b, c = rng.uniform(1, 5, 3)
    img = 128 + 60 * np.sin(x / 96 * 6.28 * a + c) + 60 * np.cos(y / 96 * 6.28 * b)
    return np.clip(np.repeat(img[:, :, None], 3, axis=2), 0, 255).astype(np.uint8)


def test_near_duplicate_recall(spark):
    base = pattern(1)
    imgs = [("base", base), ("copy", base), ("other", pattern(9))]
    for i in range(20):
        v = base.astype(int)
        r, c = (i * 13) % 72, (i * 29) % 72
        v[r : r + 24, c : c + 24] += 12
        imgs.append((f"var{i:02d}", np.clip(v, 0, 255).astype(np.uint8)))
    df = spark.createDataFrame([(n, 96, 96, 3, bytes(a.tobytes())) for n, a in imgs],
                               "id STRING, height INT, width INT, nChannels INT, data BINARY")
    hashed = image_hashes(df).select("id", F.col("dhash").alias("hash"))
    edges = dedupe.hash_pairs(hashed, 0.85).select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b"))
    groups = dedupe.duplicate_groups(hashed.select("id", F.col("hash").alias("key")), edges)
    members = {r["member"] for r in groups.where("representative = 'base'").collect()}
    assert "copy" in members and "other" not in members
    assert len([m for m in members if m.startswith("var")]) >= 19


def test_hash_pairs_match_brute_force(spark):
    rng = random.Random(2)
    centers = [rng.getrandbits(64) for _ in range(20)]
    vals = set()
    for c in centers:
        for _ in range(8):
            v = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
            vals.add(v - (1 << 64) if v >= 1 << 63 else v)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(sorted(vals))], "id INT, hash BIGINT")
    want = sorted((a, b) for a in vals for b in vals
                  if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 6)
    for expected in (10, 10**7, 10**12):  # one, two and more bands at once
        assert rows(dedupe.hash_pairs(df, 0.9, expected=expected).select("hash_a", "hash_b")) == want


def test_cosine_pairs_with_pivots_and_tiles(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    vecs = [base[i % 12 if i % 3 else 0] + rng.normal(scale=.12, size=16) for i in range(300)]
    vecs += [vecs[0], vecs[0]]  # equal vectors collapse to the smallest id
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id BIGINT, vector ARRAY<FLOAT>")
    u = np.array([np.float32(v) for v in vecs[:300]], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sim = u @ u.T
    want = sorted((int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(sim >= .95, 1))))
    assert rows(dedupe.cosine_pairs(df, .95, tile=16).select("a", "b")) == want
    full = dedupe.components(dedupe.cosine_pairs(df, .95, tile=16).select("a", "b"))
    thin = dedupe.cosine_pairs(df, .95, tile=16, forest=True)
    assert thin.count() < len(want)
    assert rows(dedupe.components(thin.select("a", "b"))) == rows(full)


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    got = dict(rows(dedupe.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT"))))
    assert set(got.values()) == {0, 100} and len(got) == 101 and got[40] == 0 and got[159] == 100


def test_sync_rules(spark):
    msgs = [("b", "lidar", i, t) for i, t in enumerate((0, 100, 200))]
    msgs += [("b", "cam", i, t) for i, t in enumerate((10, 140, 400))]
    msgs += [("b", "info", 0, 90)]
    df = spark.createDataFrame([(b, n, i, t * 1000) for b, n, i, t in msgs], "bag STRING, topic STRING, idx BIGINT, ts_us BIGINT")
    got = sync.number_frames(sync.sync_frames(df, "lidar", "cam", "info", 50.0, bucket_us=30_000))
    assert rows(got.select("frame_index", "cloud_idx", "image_idx", "info_idx", "sync_error_ms")) == [
        (0, 0, 0, None, 90.0), (1, 1, 1, 0, 40.0)]


def test_nearest_matches_brute_force(spark):
    rng = random.Random(7)
    left = [("b", i, rng.randrange(2000)) for i in range(150)]
    right = [("b", i, t) for i, t in enumerate(sorted(rng.randrange(2000) for _ in range(60)))]
    mk = lambda d: spark.createDataFrame(d, "bag STRING, idx BIGINT, ts_us BIGINT")
    got = {r["idx"]: r["n_idx"] for r in sync.nearest(mk(left), mk(right), ["bag"], 37, "n").collect()}
    for _, i, t in left:
        assert got[i] == min(right, key=lambda r: (abs(r[2] - t), r[1]))[1]


def test_pinhole_and_boxes(spark):
    pts = spark.createDataFrame([(0.0, 0.0, 10.0), (1.0, 1.0, 5.0), (0.0, 0.0, -1.0), (9.0, 0.0, 1.0)], "x DOUBLE, y DOUBLE, z DOUBLE")
    k = (500.0, 0, 320.0, 0, 500.0, 240.0, 0, 0, 1)
    got = [(r["u"], r["v"], r["valid"]) for r in G.project(pts, k, 640, 480).collect()]
    assert got == [(320.0, 240.0, True), (420.0, 340.0, True), (None, None, False), (4820.0, 240.0, False)]
    box = spark.createDataFrame([(0.0, 0.0, 10.0, 4.5, 1.8, 1.5, 0.3), (0.0, 0.0, -9.0, 1.0, 1.0, 1.0, 0.0)],
                                "x DOUBLE, y DOUBLE, z DOUBLE, l DOUBLE, w DOUBLE, h DOUBLE, yaw DOUBLE")
    t = (0.96, -0.28, 0.0, 0.4, 0.28, 0.96, 0.0, -0.2, 0.0, 0.0, 1.0, 0.5, 0, 0, 0, 1)
    r, behind = G.project_boxes(box, k, 640, 480, t).collect()
    assert behind["x1"] is None
    signs = np.array(G.CORNER_SIGNS) * np.array([4.5, 1.8, 1.5]) / 2
    c, s = np.cos(.3), np.sin(.3)
    world = signs @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + [0, 0, 10]
    m = np.array(t).reshape(4, 4)
    cam = world @ m[:3, :3].T + m[:3, 3]
    u = 500 * cam[:, 0] / cam[:, 2] + 320
    assert r["x1"] == pytest.approx(u.min()) and r["x2"] == pytest.approx(u.max())


def test_greedy_match_is_sequential_greedy(spark):
    rng = random.Random(11)
    pairs = [(f, i, j, rng.choice([.3, .5, .5, .7, rng.random()])) for f in range(4) for i in range(12)
             for j in range(12) if rng.random() < .5]
    want = []
    for f in range(4):
        left, right = set(), set()
        for _, i, j, s in sorted((p for p in pairs if p[0] == f), key=lambda p: (-p[3], p[1], p[2])):
            if i not in left and j not in right:
                left.add(i), right.add(j), want.append((f, i, j))
    df = spark.createDataFrame(pairs, "frame_id INT, i INT, j INT, iou DOUBLE")
    assert rows(fusion.greedy_match(df).select("frame_id", "i", "j")) == sorted(want)


def cloud_df(spark, xyz, cid=1):
    return spark.createDataFrame([(cid, i, *map(float, p)) for i, p in enumerate(xyz)],
                                 "cloud_id BIGINT, point_idx BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")


def test_sampling(spark):
    diag = cloud_df(spark, [(i, i, i) for i in range(100)])
    assert cloud.sample_voxel_first(diag, 10.0).count() == 10
    assert cloud.sample_uniform(diag, 2).count() == 50
    assert cloud.sample_random(diag, 0.5).count() == 50
    assert cloud.sample_random(diag, 0.0).count() == 0 and cloud.sample_random(diag, 1.0).count() == 100
    assert cloud.sample_random(diag, target=7).count() == 7 and cloud.sample_random(diag, target=500).count() == 100
    for bad in (lambda: cloud.sample_voxel_first(diag, 0.0), lambda: cloud.sample_uniform(diag, 0),
                lambda: cloud.sample_random(diag, 1.5)):
        with pytest.raises(ValueError):
            bad()


def test_neighbors_hot_cube_against_brute_force(spark):
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(0, .3, (120, 3)), rng.uniform(-20, 20, (60, 3)), np.zeros((20, 3))])
    df = cloud_df(spark, pts)
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = dict(rows(neighbors.radius_counts(df, 1.0, block=16).select("point_idx", "neighbors")))
    assert got == {i: int((d[i] <= 1.0).sum()) for i in range(len(pts))}
    near = {r["point_idx"]: [n["idx"] for n in r["neighbors"]] for r in neighbors.knn(df, 5, block=16).collect()}
    for i in range(len(pts)):
        assert near[i] == sorted(range(len(pts)), key=lambda j: (d[i, j], j))[:5]


def test_neighbors_of_many_equal_points(spark):
    """200,000 equal points, some single ones around, and a far one."""
    n = 200_000
    same = spark.range(n).selectExpr("1L AS cloud_id", "id AS point_idx", "5.0D AS x", "5.0D AS y", "5.0D AS z")
    rng = np.random.default_rng(3)
    single = np.vstack([rng.uniform(0, 10, (3000, 3)), [[1e6, 0.0, 0.0]]])
    rest = spark.createDataFrame([(1, n + i, *map(float, p)) for i, p in enumerate(single)], same.schema)
    df = same.unionByName(rest)
    d = np.sqrt(((single[:, None] - single[None]) ** 2).sum(-1))
    to_same = np.sqrt(((single - 5.0) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = dict(rows(neighbors.radius_counts(df, 1.0, block=512).select("point_idx", "neighbors")))
    assert len(got) == n + len(single)
    assert {got[i] for i in range(n)} == {n - 1 + int((to_same <= 1.0).sum())}
    assert [got[n + i] for i in range(len(single))] == [int((d[i] <= 1.0).sum()) + n * int(to_same[i] <= 1.0) for i in range(len(single))]
    near = neighbors.nearest(df, 3, block=512)
    assert near.count() == 3 * (n + len(single))
    some = {}
    for r in near.where(f"point_idx < 5 OR point_idx >= {n}").orderBy("rank").collect():
        some.setdefault(r["point_idx"], []).append(r["idx"])
    assert some[0] == [1, 2, 3] and some[2] == [0, 1, 3] and some[4] == [0, 1, 2]
    for i in range(len(single)):
        options = [(d[i, j], n + j) for j in np.argsort(d[i])[:4]] + [(to_same[i], j) for j in range(3)]
        assert some[n + i] == [j for _, j in sorted(options)[:3]]


def test_leaf_pairs_stay_few(spark):
    """Dense and sparse regions: the pairs of leaves grow with the leaves, not with their square."""
    rng = np.random.default_rng(4)
    counts = {}
    for n in (4000, 16000):
        pts = np.vstack([rng.normal(0, 1e-4, (n // 2, 3)), rng.uniform(-50, 50, (n // 2, 3))])
        df = cloud_df(spark, pts).selectExpr("cloud_id", "x", "y", "z", "array(point_idx) AS ids", "1L AS weight")
        leaves = octree.packed(octree.leaves(df, 64))
        sizes = [len(r["weights"]) // 8 for r in leaves.collect()]
        assert sum(sizes) == n and max(sizes) <= 64 and min(sizes) >= 32
        counts[n] = octree.leaf_pairs(leaves.withColumn("reach", F.lit(2e-5))).count()
    assert counts[16000] < 8 * counts[4000]


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(-3, 3, (80, 2))
    df = cloud_df(spark, np.column_stack([xy, np.full(80, -2.0)]))
    n = neighbors.normals(df, 5.0, 10).select("nx", "ny", "nz").collect()
    assert all(abs(r["nz"] - 1.0) < 1e-6 for r in n)  # toward the origin


def test_xml_records_in_ranges(spark, tmp_path):
    """Every range size gives the same elements, each once, wherever its borders fall."""
    doc = '<?xml version="1.0"?>\n<annotations><meta><label><name>a &gt; b</name></label><labels/></meta>'
    for i in range(200):
        inner = "" if i % 5 == 0 else f'<box label="x>y" xtl="{i}"><attribute name="n">{"ä" * (i % 7)}</attribute></box>'
        doc += f'<image id="{i}"/>' if i % 5 == 0 else f'\n  <image id="{i}" name="imagery &lt;{i}">{inner}</image >'
    doc += "<track id='3' label='</image>'><box/></track></annotations>"
    (tmp_path / "a.xml").write_text(doc)
    want = None
    for size in (7, 100, 1000, 1 << 20):
        got = rows(xml_records(spark, str(tmp_path / "a.xml"), "image", "track", "label", range_bytes=size))
        want = want or got
        assert got == want
    assert [(t, sum(r[1] == t for r in want)) for t in ("image", "label", "track")] == [("image", 200), ("label", 1), ("track", 1)]
    raw = doc.encode()
    assert all(raw[at:].startswith(x.encode()) for _, _, at, x in want)


def test_coco_masks_round_trip(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}], "categories": [{"id": 1, "name": "car"}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 1, 9, 9], "area": 12.5, "iscrowd": 0, "segmentation": [[10, 10, 20, 10, 20, 20], [1, 2]]},
            {"id": 2, "image_id": 1, "category_id": 1, "bbox": [1, 1, 9, 9], "area": 81, "iscrowd": 1, "segmentation": {"size": [50, 100], "counts": "a1\"b"}},
            {"id": 3, "image_id": 1, "category_id": 1, "bbox": [1, 1, 9, 9], "segmentation": []}],
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(doc))
    first = R.read_coco(spark, str(tmp_path / "in"))
    S.write_coco(first, str(tmp_path / "out"))
    for ds in (first, R.read_coco(spark, str(tmp_path / "out")), R.read_coco(spark, str(tmp_path / "out"), layout="lines")):
        a, b, c = ds.labels.orderBy("label_index").collect()
        assert [list(map(list, a["segments"])), a["rle"], a["area"], a["iscrowd"]] == [[[.1, .2, .2, .2, .2, .4]], None, 12.5, False]
        assert b["segments"] is None and json.loads(b["rle"]) == {"size": [50, 100], "counts": 'a1"b'} and b["iscrowd"]
        assert c["segments"] is None and c["rle"] is None


def test_cvat_fields_round_trip(spark, tmp_path):
    shapes = (
        '<box label="car" occluded="1" source="manual" z_order="4" xtl="10" ytl="5" xbr="20" ybr="10"><attribute name="color">red &amp; blue</attribute>'
        '<attribute name=" color ">green</attribute><attribute name="">x</attribute></box>'
        '<polyline label="lane" points="0,0;50.5,25;100,50" rotation="30"></polyline><points label="eye" points="10,10"/>'
    )
    (tmp_path / "a.xml").write_text(
        "<annotations><meta><task><labels><label><name>car</name></label><label><name>lane</name></label><label><name>eye</name></label></labels></task></meta>"
        f'<image id="0" name="i.jpg" width="100" height="50">{shapes}</image>'
        '<track id="5" label="car"><box frame="0" outside="0" occluded="0" keyframe="1" xtl="1" ytl="1" xbr="2" ybr="2"><attribute name="speed"></attribute></box></track></annotations>')
    first = R.read_cvat(spark, str(tmp_path / "a.xml"))
    S.write_cvat(first, str(tmp_path / "out"))
    for ds in (first, R.read_cvat(spark, str(tmp_path / "out" / "annotations.xml"))):
        got = {(r["class_name"], r["track_id"]): r for r in ds.labels.collect()}
        car, lane, eye, moving = (got[k] for k in (("car", None), ("lane", None), ("eye", None), ("car", 5)))
        assert car["attributes"] == {"color": "green", "source": "manual", "z_order": "4"} and car["occluded"] and car["points"] is None
        assert lane["shape_type"] == "polyline" and lane["points"] == [0, 0, .505, .5, 1, 1] and lane["attributes"] == {"rotation": "30"}
        assert eye["shape_type"] == "points" and eye["points"] == [.1, .2]
        assert moving["attributes"] == {"speed": "", "keyframe": "1"}


def test_coco_document(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "img001.jpg", "width": 640, "height": 480},
                   {"id": 2, "file_name": "img002.jpg", "width": 800, "height": 600}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 7, "bbox": [100, 100, 200, 150], "area": 1, "iscrowd": 0},
            {"id": 2, "image_id": 1, "category_id": 9, "bbox": [300, 200, 100, 80]},
            {"id": 3, "image_id": 2, "category_id": 7, "bbox": [50, 50, 300, 250]},
            {"id": 4, "image_id": 2, "category_id": 99, "bbox": [1, 1, 2, 2]}],
        "categories": [{"id": 9, "name": "car"}, {"id": 7, "name": "person"}],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    ds = R.read_coco(spark, str(tmp_path))
    got = ds.labels.orderBy("label_index").collect()
    assert [(r["class_id"], r["class_name"]) for r in got] == [(0, "person"), (1, "car"), (0, "person")]
    assert (got[0]["cx"], got[0]["cy"]) == pytest.approx((200 / 640, 175 / 480))


def test_coco_shards_are_documents(spark, tmp_path):
    ds = qa_dataset(spark)
    sized = Dataset(ds.samples.withColumns({"image_width": F.lit(640), "image_height": F.lit(480)}), ds.labels, ds.classes)
    S.write_coco(sized, str(tmp_path / "c"), shards=3)
    docs = [json.loads(p.read_text()) for p in sorted((tmp_path / "c" / "annotations").glob("*.json"))]
    assert sorted(i["id"] for d in docs for i in d["images"]) == list(range(1, 8))
    assert sorted(a["id"] for d in docs for a in d["annotations"]) == list(range(1, 9))
    with pytest.raises(FileExistsError):
        S.write_coco(sized, str(tmp_path / "c"))


def test_kitti_line(spark, tmp_path):
    for d in ("image_2", "label_2"):
        (tmp_path / "training" / d).mkdir(parents=True)
    (tmp_path / "training/image_2/000000.png").write_text("x")
    (tmp_path / "training/label_2/000000.txt").write_text(
        "Car 0.00 0 -1.82 517.0 174.0 636.0 224.0 1.47 1.60 3.69 1.04 1.82 9.64 -1.57\n"
        "DontCare -1 -1 -10 1 1 2 2 -1 -1 -1 -1000 -1000 -1000 -10\nshort line\n")
    r = R.read_kitti(spark, str(tmp_path)).labels.collect()
    assert len(r) == 1 and r[0]["class_name"] == "Car" and r[0]["class_id"] == 0
    assert r[0]["cx"] == pytest.approx((517 + 636) / 2 / 1242) and r[0]["loc_z"] == 9.64


def test_voc_person(spark, tmp_path):
    (tmp_path / "Annotations").mkdir()
    (tmp_path / "Annotations/img001.xml").write_text(
        "<annotation><filename>img001.jpg</filename><size><width>640</width><height>480</height></size>"
        "<object><name>person</name><occluded>1</occluded><bndbox><xmin>100</xmin><ymin>100</ymin><xmax>300</xmax><ymax>400</ymax></bndbox></object>"
        "<object><name>forklift</name><difficult>1</difficult><bndbox><xmin>50</xmin><ymin>75</ymin><xmax>200</xmax><ymax>320</ymax></bndbox></object>"
        "</annotation>")
    ds = R.read_voc(spark, str(tmp_path))
    r = qa.with_corners(ds.labels).orderBy("label_index").collect()
    assert r[0]["x1"] == pytest.approx(99 / 640) and r[0]["x2"] == pytest.approx(300 / 640) and r[0]["occluded"]
    assert r[1]["class_id"] == 20
    assert R.read_voc(spark, str(tmp_path), include_difficult=False).labels.count() == 1


def test_cvat_tracks(spark, tmp_path):
    shape = '<box frame="{f}" outside="{o}" occluded="0" xtl="10" ytl="10" xbr="20" ybr="20"></box>'
    (tmp_path / "a.xml").write_text(
        '<annotations><image id="0" name="a.jpg" width="100" height="50"><polygon label="road" points="0,0;50,0;50,25"></polygon></image>'
        '<image id="1" name="b.jpg" width="100" height="50"></image><track id="7" label="car">'
        + "".join(shape.format(f=f, o=int(f == 2)) for f in range(3)) + "</track></annotations>")
    labels = R.read_cvat(spark, str(tmp_path / "a.xml")).labels
    assert labels.where("track_id = 7 AND class_name = 'car'").count() == 2
    poly = labels.where("shape_type = 'polygon'").first()
    assert (poly["cx"], poly["w"]) == (0.25, 0.5)


def test_yolo_lines_and_names(spark, tmp_path):
    (tmp_path / "data.yaml").write_text("names: ['person', car]\nnc: 2\n")
    assert rows(yolo.class_map(spark, str(tmp_path))) == [(0, "person"), (1, "car")]
    (tmp_path / "data.yaml").write_text("names:\n  0: person\n  2: 'bike'\ntrain: x\n")
    assert rows(yolo.class_map(spark, str(tmp_path))) == [(0, "person"), (1, ""), (2, "bike")]
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.3\n# note\n\n9 0.1 0.1 0.5 0.1 0.5 0.9\n1 2\n0 a b c d\n0 1 2 3 4 5\n")
    got = yolo.parse_lines(numbered_lines(spark, str(tmp_path), "*.txt"), yolo.class_map(spark, str(tmp_path)))
    assert rows(got.select("label_index", "class_name", "w")) == [(0, "person", 0.2), (3, "class_9", 0.4)]


def test_points_float32(spark, tmp_path):
    np.array([[1, 2, 3, 10], [4, 5, 6, 20]], "<f4").tofile(tmp_path / "c.bin")
    got = P.read_float32(spark, str(tmp_path)).orderBy("point_idx").collect()
    assert [(r["x"], r["intensity"]) for r in got] == [(1.0, 0.5), (4.0, 1.0)]


def test_counts_of_many_equal_boxes(spark):
    """100,000 equal boxes in one image are counted without being listed, and what else is there is found."""
    n = 100_000
    same = spark.range(n).selectExpr("1 AS sample_id", "id AS i", "0.2D AS x1", "0.2D AS y1", "0.4D AS x2", "0.4D AS y2")
    rest = [(1, n, .2, .2, .4, .39), (1, n + 1, .8, .8, .9, .9), (1, n + 2, .8, .8, .9, .905), (1, n + 3, .6, .6, .6, .6), (2, 0, .1, .1, .2, .2)]
    boxes = same.unionByName(spark.createDataFrame(rest, same.schema))
    got = rows(self_iou_counts(boxes, ["sample_id"], 0.9))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, n * (n - 1) // 2 + n + 1, n + 3)] and got[0][2] == 1.0


def test_iou_join_in_tiles(spark):
    rng = np.random.default_rng(6)
    boxes = [(1, i, .1, .1, .2, .2) for i in range(60)] + [(1, 60 + i, *(a := rng.uniform(0, .8, 2)), *(a + .1)) for i in range(60)]
    df = spark.createDataFrame([tuple(map(float, b)) for b in boxes], "k DOUBLE, i DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    for t in (0.0, 0.3):
        plain = rows(self_iou_join(df, ["k"], "i", t).select("l.i", "r.i"))
        small = rows(self_iou_join(df, ["k"], "i", t, hot_rows=8, tile=16).select("l.i", "r.i"))
        assert plain == small and len(plain) >= 60 * 59 // 2


def test_points_float32_in_ranges(spark, tmp_path):
    """A file of 64 MB is read by several tasks, small files share one, and a rest shorter than a record is left out."""
    n = 4 << 20
    data = np.arange(n, dtype=np.float32)
    np.column_stack([data, data % 7, -data, np.full(n, 2, np.float32)]).astype("<f4").tofile(tmp_path / "large.bin")
    for i in range(20):
        (tmp_path / f"small{i}.bin").write_bytes(np.full((3, 4), i, "<f4").tobytes() + b"rest")
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"0" * 64)
    spark.dataSource.register(P.FloatRecords)
    plain = spark.read.format("float_records").load(str(tmp_path))
    assert 4 <= plain.rdd.getNumPartitions() <= 6
    got = P.read_float32(spark, str(tmp_path))
    large = got.where("path LIKE '%large.bin'").agg(
        F.count("x"), F.countDistinct("point_idx"), F.sum(F.abs(F.col("x") - F.col("point_idx"))), F.sum("y"), F.max("intensity")
    ).first()
    assert tuple(large) == (n, n, 0.0, float((data % 7).sum(dtype=np.float64)), 1.0)
    assert got.where("path NOT LIKE '%large.bin'").count() == 60
    fine = P.read_float32(spark, str(tmp_path / "small7.bin"), range_bytes=16)
    assert [(r["point_idx"], r["x"]) for r in fine.orderBy("point_idx").collect()] == [(0, 7.0), (1, 7.0), (2, 7.0)]


def test_records_of_a_file_larger_than_a_batch(spark, tmp_path):
    pts = spark.range(30_000).selectExpr("id % 2 AS cloud_id", "id DIV 2 AS point_idx", "double(id) AS x", "1.5D AS y", "-2.0D AS z")
    S.write_float32(pts, str(tmp_path / "out"))
    got = P.read_float32(spark, str(tmp_path / "out")).where("path LIKE '%cloud_1.bin'").orderBy("point_idx").collect()
    assert [r["x"] for r in got] == [float(2 * i + 1) for i in range(15_000)] and {r["intensity"] for r in got} == {0.0}


def test_detect_format_rules(spark):
    files = [("a", "labels.yaml", "train: x\n"), ("b", "x.json", '{"images": [], "annotations": []}'),
             ("c", "x.xml", "<?xml version='1.0'?><annotations>"), ("d", "x.json", '{"openlabel": {}}'), ("e", "x.bin", None)]
    df = spark.createDataFrame(files, "root STRING, rel STRING, head STRING")
    got = dict(rows(detect_formats(df.select("root", "rel"), df)))
    assert got == {"a": "yolo", "b": "coco", "c": "cvat", "d": "openlabel", "e": None}


def test_registry(spark):
    assert {"yolo", "coco", "kitti", "voc", "cvat"} <= set(registry.formats())
    with pytest.raises(ValueError):
        registry.convert(spark, "nope", "a", "yolo", "b")


def test_depth_raster_against_numpy(spark):
    from framewright.operators import redact

    rng = np.random.default_rng(6)
    n = 60
    u, v, d = rng.uniform(0, 12, n), rng.uniform(0, 9, n), rng.uniform(.5, 9, n)
    df = spark.createDataFrame([(1, 0, float(a), float(b), float(c), True, 12, 9) for a, b, c in zip(u, v, d)],
                               "cloud_id INT, view INT, u DOUBLE, v DOUBLE, depth DOUBLE, valid BOOLEAN, width INT, height INT")
    buf = np.zeros((9, 12))
    for a, b, c in zip(u, v, d):
        for i in range(-2, 3):
            for j in range(-2, 3):
                y, x = min(8, max(0, int(b) + j)), min(11, max(0, int(a) + i))
                buf[y, x] = max(buf[y, x], 1 / c)
    got = np.zeros((9, 12), int)
    for r in redact.depth_raster(df).collect():
        got[r["pv"], r["pu"]] = r["gray"]
    assert (got == np.floor(buf / buf.max() * 255)).all()
