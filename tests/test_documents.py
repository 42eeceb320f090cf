"""Several documents with clashing numbers, both folder layouts, and work without limits on rounds or results."""

import json

import pytest

from framewright.model import Dataset
from framewright.operators import cloud, fusion, review
from framewright.sinks import labels as S
from framewright.sources import files as FS
from framewright.sources import labels as R
from framewright.sources import yolo


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_coco_documents_keep_their_categories(spark, tmp_path):
    for name, first, second in (("a", "car", "dog"), ("b", "dog", "cat")):
        (tmp_path / f"{name}.json").write_text(json.dumps({
            "images": [{"id": 1, "file_name": f"{name}.jpg", "width": 100, "height": 100}],
            "annotations": [{"id": k, "image_id": 1, "category_id": k, "bbox": [0, 0, 10, 10]} for k in (1, 2)],
            "categories": [{"id": 1, "name": first}, {"id": 2, "name": second}],
        }))
    ds = R.read_coco(spark, str(tmp_path))
    got = ds.labels.join(ds.samples, "sample_id").select("image_path", "label_index", "class_name")
    assert rows(got) == [("a.jpg", 1, "car"), ("a.jpg", 2, "dog"), ("b.jpg", 1, "dog"), ("b.jpg", 2, "cat")]
    assert rows(ds.classes) == [(0, "car"), (1, "dog"), (2, "cat")]


def test_cvat_documents_keep_their_frames(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.xml").write_text(
            f'<annotations><image id="0" name="{name}.jpg" width="100" height="50"><box label="x" xtl="0" ytl="0" xbr="10" ybr="10"></box></image>'
            f'<track id="1" label="{name}"><box frame="0" outside="0" xtl="10" ytl="10" xbr="20" ybr="20"></box></track></annotations>')
    ds = R.read_cvat(spark, f"{tmp_path}/*.xml")
    got = ds.labels.join(ds.samples, "sample_id").select("image_path", "class_name")
    assert rows(got) == [("a.jpg", "a"), ("a.jpg", "x"), ("b.jpg", "b"), ("b.jpg", "x")]


def test_yolo_layouts_and_nearest_names(spark, tmp_path):
    def put(rel, text="x"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text)

    line = "0 0.5 0.5 0.2 0.2\n"
    put("one/data.yaml", "path: .\ntrain: images/train\nval: 'images/held'\nnames: [cat]\n")
    put("one/images/train/a.jpg"), put("one/labels/train/a.txt", line)
    put("one/images/held/b.jpg"), put("one/labels/held/b.txt", line)
    put("two/data.yaml", "train: ./learn/images\nnames:\n  0: dog\n")
    put("two/learn/images/c.jpg"), put("two/learn/labels/c.txt", line)
    put("two/test/images/d.jpg"), put("two/test/labels/d.txt", line)
    put("images/extra/e.jpg"), put("labels/extra/e.txt", line)
    ds = yolo.read_yolo(spark, str(tmp_path))
    got = ds.labels.join(ds.samples, "sample_id").select("stem", "split", "class_name")
    assert rows(got) == [
        ("a", "train", "cat"), ("b", "val", "cat"), ("c", "train", "dog"), ("d", "test", "dog"), ("e", "extra", "class_0"),
    ]


def test_voc_lists_follow_the_samples(spark, tmp_path):
    samples = spark.createDataFrame(
        [(i, i, f"/d/s{i}.jpg", 100, 100, s) for i, s in enumerate(("train", "val", None, "val"))],
        "sample_id INT, ordinal INT, image_path STRING, image_width INT, image_height INT, split STRING")
    labels = spark.createDataFrame([(0, 0, "a", 0, .5, .5, .2, .2)], "sample_id INT, label_index INT, class_name STRING, class_id INT, cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE")
    classes = spark.createDataFrame([(0, "a")], "class_id INT, class_name STRING")
    S.write_voc(Dataset(samples, labels, classes, "t"), str(tmp_path / "out"))
    lists = {n: rows(R.split_stems(spark, str(tmp_path / "out"), n)) for n in ("train", "val")}
    assert lists == {"train": [("s0",), ("s2",)], "val": [("s1",), ("s3",)]}


@pytest.mark.parametrize("n, gather", [(300, 20_000), (12, 0)])
def test_long_chain_of_picks(spark, n, gather):
    """Each pick frees the next, one at a time, in both ways."""
    pairs = [("f", k, k, 1 - 2 * k / 1000) for k in range(n)] + [("f", k + 1, k, 1 - (2 * k + 1) / 1000) for k in range(n - 1)]
    got = fusion.greedy_match(spark.createDataFrame(pairs, "frame_id STRING, i INT, j INT, iou DOUBLE"), gather)
    assert {(r["i"], r["j"]) for r in got.collect()} == {(k, k) for k in range(n)}


def test_all_clusters_are_found(spark):
    points = [("c", 100.0 * k + (p % 10) * 0.1, (p // 10) * 0.1, 5 + p * 0.01, k * 100 + p) for k in range(25) for p in range(100)]
    ground = [("c", 10.0 * p, -50.0, 0.0, 10_000 + p) for p in range(500)]
    df = spark.createDataFrame(points + ground, "cloud_id STRING, x DOUBLE, y DOUBLE, z DOUBLE, point_idx INT")
    assert cloud.voxel_clusters(df, size=(50.0, 50.0, 50.0)).count() == 25
    assert cloud.voxel_clusters(df, size=(50.0, 50.0, 50.0), most=10).count() == 10


def test_unreadable_images_are_reported(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"not an image")
    assert rows(FS.image_dimensions(spark, str(tmp_path)).select("width")) == [(None,)]
    assert FS.unreadable_images(spark, str(tmp_path)).first()["issue"] == "unreadable_image"


def test_one_item_per_path(spark):
    images = spark.createDataFrame([("/a.jpg",)], "image_path STRING")
    items = spark.createDataFrame([("1", "/a.jpg"), ("2", "/a.jpg")], "item_id STRING, file_path STRING")
    assert [r["item_id"] for r in review.match_items(images, items).collect()] == ["2"]
