"""Work that grew faster than its input, on small rows that show how it is done."""

from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from framewright.operators import hooks, sync


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_nearest_looks_ahead_by_running_frames(spark):
    left = spark.createDataFrame([("b", t, i) for i, t in enumerate((5, 15, 15, 95, 210))], "bag STRING, ts_us BIGINT, idx BIGINT")
    right = spark.createDataFrame([("b", t, i) for i, t in enumerate((12, 18, 18, 90, 100, 300))], "bag STRING, ts_us BIGINT, idx BIGINT")
    got = sync.nearest(left, right, ["bag"], 10, "image")
    assert rows(got.select("idx", "image_idx")) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 5)]
    assert "unboundedfollowing" not in got._jdf.queryExecution().analyzed().toString().lower()


def test_a_sample_is_one_call_whatever_the_batches(spark):
    data = [(k, i if k != 3 or i else None, None if k in (5, None) else k % 2 == 0) for k in (1, 2, 3, 5, None) for i in range(7)]
    df = spark.createDataFrame(data, "sample_id BIGINT, v BIGINT, flag BOOLEAN")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")

    def seen(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = f"{pdf['v'].dtype} {pdf['flag'].dtype} {list(pdf.index) == list(range(len(pdf)))}"
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "n": [len(pdf)], "total": [pdf["v"].sum()], "kinds": [kinds]})

    try:
        schema = "sample_id BIGINT, n BIGINT, total DOUBLE, kinds STRING"
        got, want = hooks.apply_sample(df, seen, schema), df.groupBy("sample_id").applyInPandas(seen, schema)
        assert rows(got) == rows(want)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
        big = df.withColumn("sample_id", F.col("sample_id") + 9007199254740993)
        counted = hooks.apply_sample(big, lambda p: (p["sample_id"].iloc[0], len(p)), "sample_id BIGINT, n BIGINT")
        assert rows(counted) == rows(big.groupBy("sample_id").count())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_voc_scan_takes_the_files_of_all_lists():
    from framewright.plans.catalog import ORACLES

    assert "acctbal" not in ORACLES["voc_split_scan"]


def test_hash_tiles_match_bands(spark):
    import random

    from framewright.operators import dedupe

    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(400)]
    near = [h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 21))) for h in base]
    signed = [h - (1 << 64) if h >= 1 << 63 else h for h in {*base, *near}]
    uniq = spark.createDataFrame([(h,) for h in signed], "hash BIGINT")
    want = sorted((min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 17)
    for got in (dedupe._tiled_hash_pairs(uniq, len(signed), 17, 64, tile=100), dedupe.hash_pairs(uniq, 0.72), dedupe.hash_pairs(uniq, 0.72, expected=20000)):
        assert rows(got.select("hash_a", "hash_b")) == sorted(want, key=repr)
    assert dedupe._band_work(120000, 17, 64, dedupe._combination_size(120000, 17, 64)) > 120000 / 16
    assert "FlatMapGroupsInPandas" in dedupe.hash_pairs(uniq, 0.72, expected=120000)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in dedupe.hash_pairs(uniq, 0.95, expected=120000)._jdf.queryExecution().executedPlan().toString()


def test_large_file_is_written_by_many_tasks(spark, tmp_path):
    from framewright.sinks import files as W

    big = spark.range(30000).select(
        F.lit("big.json").alias("rel"), F.col("id").alias("a"), F.when(F.col("id").between(11, 28999), "s").alias("section"),
        F.col("id").cast("string").alias("line"))
    small = spark.range(300).select(
        F.format_string("d/%03d.txt", F.col("id") % 100).alias("rel"), F.col("id").alias("a"), F.lit(None).cast("string").alias("section"),
        F.when(F.col("id") % 100 != 7, F.col("id").cast("string")).alias("line"))
    W.write_lines(big.union(small), str(tmp_path), ["a"])
    assert (tmp_path / "big.json").read_text() == "".join(f"{i}{',' if 11 <= i < 28999 else ''}\n" for i in range(30000))
    texts = {p.name: p.read_text() for p in (tmp_path / "d").iterdir()}
    assert texts == {f"{i:03d}.txt": "" if i == 7 else f"{i}\n{i + 100}\n{i + 200}\n" for i in range(100)}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["big.json", "d"]


def test_coco_documents_grow_in_number(spark):
    from framewright.model import Dataset
    from framewright.sinks import labels as S

    assert [S.coco_shards(Dataset(None, spark.range(n)), 4, 10) for n in (3, 41, 105)] == [4, 5, 11]


def test_raster_copies_are_not_shuffled(spark):
    from framewright.operators import redact

    seen = spark.createDataFrame(
        [(c, v, float(x), float(y), 1.0 + x, 20, 10, True) for c in (1, 2) for v in (0, 1) for x, y in ((0, 0), (5, 5), (19, 9))],
        "cloud_id BIGINT, view INT, u DOUBLE, v DOUBLE, depth DOUBLE, width INT, height INT, valid BOOLEAN")
    got = redact.depth_raster(seen, 2)
    per = rows(got.groupBy("cloud_id", "view").agg(F.count(F.lit(1)), F.max("gray")))
    assert per == [(c, v, 9 + 25 + 9, 255) for c in (1, 2) for v in (0, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not any("Exchange" in line and "_pix" in line for line in plan.splitlines())


def test_cvat_elements_are_parsed_once(spark, tmp_path):
    from framewright.sources import labels as R

    (tmp_path / "a.xml").write_text(
        '<annotations><image id="0" name="a.jpg" width="100" height="50"><box label="x" xtl="0" ytl="0" xbr="10" ybr="10"></box>'
        '<polygon label="y" points="0,0;10,0;10,10"></polygon></image><image id="1" name="b.jpg" width="100" height="50"></image></annotations>')
    ds = R.read_cvat(spark, str(tmp_path / "a.xml"))
    assert rows(ds.samples.select("ordinal", "image_path")) == [(0, "a.jpg"), (1, "b.jpg")]
    assert rows(ds.labels.select("class_name", "shape_type")) == [("x", "box"), ("y", "polygon")]
    assert "from_xml" not in ds.samples._jdf.queryExecution().optimizedPlan().toString()


def test_pair_counts_of_small_samples_need_no_cells(spark):
    import random

    from framewright.model import Dataset
    from framewright.operators import qa

    rnd = random.Random(5)
    data = [(k, i, rnd.randrange(3) if k != 4 or i else None, rnd.randrange(4) / 40, rnd.randrange(4) / 40, rnd.choice((0.2, 0.22)), 0.2)
            for k in (1, 2, 3, 4, None) for i in range(40)]
    data += [(6, 0, 1, 0.0, 0.0, 0.0, 1.0), (7, 0, 1, 0.5, 0.5, 0.1, 0.1), (7, 1, 2, 0.5, 0.5, 0.1, 0.1)]
    labels = spark.createDataFrame(data, "sample_id BIGINT, label_index BIGINT, class_id INT, cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE")
    ds = Dataset(None, labels)
    got = qa.pair_counts(ds, 0.6)
    assert rows(got) == rows(qa.pair_counts(ds, 0.6, most=0))  # every sample cut into cells
    assert rows(got.where("sample_id = 7")) == [(7, "overlapping_boxes", 1, 2, 1.0)]
    plan = qa.pair_counts(Dataset(None, labels.where("sample_id < 4")), 0.6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


def test_arrivals_are_cut_into_files_of_bounded_size(spark, tmp_path):
    from framewright.plans import streams

    items = spark.range(3000).select(F.col("id").alias("l_orderkey"), (F.col("id") % 1500).cast("double").alias("l_extendedprice"))
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    folder, files = streams._in_parts(spark, str(tmp_path), n=6, rows=100)
    got = spark.read.parquet(folder)
    assert files == 5 and len(got.inputFiles()) == 30 and rows(got) == rows(items)
    assert max(r["count"] for r in got.groupBy(F.input_file_name()).count().collect()) < 250
    assert streams._in_parts(spark, str(tmp_path))[1] == 1


def test_openlabel_lines_match_documents(spark, tmp_path):
    from framewright.model import Dataset
    from framewright.sinks import scenes as S
    from framewright.sources import scenes as R

    samples = spark.createDataFrame(
        [(i, f"s{i % 2}", "CAM", i * 10, i, f'/d/"{i}".jpg', 100, 50) for i in range(7)],
        "sample_id BIGINT, scene STRING, camera STRING, timestamp BIGINT, ordinal BIGINT, image_path STRING, image_width INT, image_height INT")
    labels = spark.createDataFrame(
        [(i, j, 'a"b' if j else "c", f'{{"objects": {{{j}' if j % 2 else None, 0.5, 0.5, 0.1 * (j + 1), 0.2, 0.9) for i in range(6) for j in range(5)],
        "sample_id BIGINT, label_index BIGINT, class_name STRING, track_id STRING, cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE, confidence DOUBLE")
    root = str(tmp_path / "out")
    S.write_openlabel(Dataset(samples, labels, None, "t"), root)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # most splits begin inside a frame
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got, want = R.read_openlabel(spark, root, layout="lines"), R.read_openlabel(spark, root)
        assert rows(got.samples) == rows(want.samples)
        again = str(tmp_path / "again")
        S.write_openlabel(Dataset(samples.union(samples.where("sample_id = 2")), labels, None, "t"), again)  # a frame of s0 is opened twice
        whole = R.openlabel_documents(spark, again).select("path", F.explode("openlabel.frames"))
        _, frames, _ = R.openlabel_lines(spark, again)
        assert rows(frames.select("path").distinct()) == rows(whole.select("path").distinct()) and frames.select("path").distinct().count() == 1
        assert got.labels.count() == 30 and rows(got.labels.drop("num", "text", "flags")) == rows(want.labels.drop("num", "text", "flags"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_active_entities_are_told_apart_in_their_slot(spark):
    from framewright.sources import scenes as R

    entities = spark.createDataFrame(
        [(1, "a", 0, 20), (1, "a", 15, 40), (1, "b", None, None), (1, "b", None, None), (2, "c", 5, 3), (2, "d", 1, None), (None, "e", 0, 9)],
        "doc BIGINT, uid STRING, start BIGINT, end BIGINT")
    frames = spark.createDataFrame([(1, 3), (1, 18), (1, 18), (1, 41), (1, None), (2, 4), (None, 4)], "doc BIGINT, frame BIGINT")
    got = R.active_entities(entities, frames, slot=16)
    assert rows(got) == sorted([(1, 3, "a"), (1, 18, "a"), (1, 3, "b"), (1, 18, "b"), (1, 41, "b"), (1, None, "b")], key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc" in plan and "uid" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line).split("hashpartitioning", 1)[1]


def test_groups_of_key_frames_are_bounded(spark):
    from framewright.session import finely

    assert finely(spark.range(1000), "id", rows=20).rdd.getNumPartitions() == 50
    assert finely(spark.range(10), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lines_are_written_as_runs_of_bytes(spark, tmp_path):
    from framewright.sinks import files as W

    lines = [("ä", "s", 0, "é,"), ("ä", "s", 1, ""), ("ä", None, 2, None), ("ä", None, 3, ""), ("ä", None, 4, "\n"), ("ä", "t", 5, "x"), ("ä", "s", 6, None),
             ("ä", "u", 7, "y"), ("b", None, 0, None), ("b", None, 1, None), ("c", None, 0, ""), ("d", "s", 0, "z"), ("d", "s", 1, None), ("d", "s", 2, "z")]
    df = spark.createDataFrame([(r, s, a, t) for r, s, a, t in lines], "rel STRING, section STRING, a INT, line STRING")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        W.write_lines(df, str(tmp_path), ["a"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {p.name: p.read_text() for p in tmp_path.iterdir()}
    assert got == {"ä": "é,,\n\n\n\n\nx\ny\n", "b": "", "c": "\n", "d": "z,\nz\n"}


def test_changes_take_no_object_per_line():
    import pyarrow as pa

    from framewright.sinks import files as W

    assert W._changes(pa.array([None, None, "a", "a", None, "b"])).tolist() == [2, 4, 5, 6]
    offsets, data = W._bytes_of(pa.array(["x", None, "äy", ""]).slice(1))
    assert bytes(data[offsets[0] : offsets[3]]).decode() == "äy"


def test_draws_are_made_once(spark):
    from framewright.model import Dataset
    from framewright.operators import dataset as D

    labels = spark.createDataFrame([(1, 0.5, 0.5, 0.1, 0.1), (2, 0.99, 0.5, 0.02, 0.1)], "sample_id BIGINT, cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE")
    samples = spark.createDataFrame([(1, "/a.jpg"), (2, "/b.jpg")], "sample_id BIGINT, image_path STRING")
    got = D.augment_boxes(Dataset(samples, labels, None, "t"), copies=2, seed=7).labels
    assert got.columns == ["sample_id", "cx", "cy", "w", "h", "copy"] and got.where("copy = 0").count() == 2
    assert got._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 3


def test_words_match_the_pattern(spark):
    from framewright.sources import files as FS

    texts = ["", "a", "a b", "a  b", "a\tb", "\ta b ", " a b", "a \x0bb", "a b c", "a\r b", "a b ", "a\fb"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = df.select("t", FS.words(F.col("t")).alias("a"), F.split("t", r"\s+").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_yolo_lines_are_read_once_for_names(spark, tmp_path):
    from framewright.sources import files as FS
    from framewright.sources import yolo

    for folder, name in (("a", "cat"), ("b c", "dog")):
        (tmp_path / folder / "labels").mkdir(parents=True)
        (tmp_path / folder / "data.yaml").write_text(f"names:\n  0: {name}\n")
        (tmp_path / folder / "labels" / "x.txt").write_text("0 0.5 0.5 0.1 0.1\n# no\n0 0.5 0.5\n0 0.5 x 0.1 0.1\n7\t0.5 0.5 0.2 0.2 0.9\n0 0.1 0.1 0.3 0.1 0.3 0.3\n")
    root = str(tmp_path)
    lines, maps = FS.numbered_lines(spark, root, "*.txt"), yolo.class_maps(spark, root)
    maps = spark.createDataFrame(maps.collect(), maps.schema)
    for parse in (yolo.parse_lines, yolo.parse_scored):
        got = parse(lines, maps, FS.line_files(spark, root, "*.txt"))
        assert rows(got) == rows(parse(lines, maps)) and {r["class_name"] for r in got.collect()} >= {"cat", "dog"}
        assert got._jdf.queryExecution().optimizedPlan().toString().count("split(value") == 1


def test_files_are_parsed_once_and_listed_at_once(spark, tmp_path):
    from framewright.sources import labels as R

    folder = tmp_path / "Annotations"
    (folder / "more").mkdir(parents=True)
    body = "<annotation><filename>{}</filename><size><width>10</width><height>10</height></size>{}</annotation>"
    box = "<object><name>{}</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>{}</xmax><ymax>5</ymax></bndbox></object>"
    (folder / "a.xml").write_text(body.format("a.jpg", box.format("dog", 4) + box.format("yak", 5)))
    (folder / "b.xml").write_text(body.format("b.jpg", ""))
    (folder / "c.txt").write_text(body.format("c.jpg", box.format("cat", 4)))
    (folder / "more" / "d.xml").write_text(body.format("d.jpg", box.format("cat", 4)))
    kept, plain = R.read_voc(spark, str(tmp_path), kept=True), R.read_voc(spark, str(tmp_path))
    assert rows(plain.samples) == [("a", "a.jpg", 10, 10), ("b", "b.jpg", 10, 10)]
    for name in ("samples", "labels", "classes"):
        assert rows(getattr(kept, name)) == rows(getattr(plain, name))
    assert [r[0] for r in plain.labels.orderBy("label_index").select("class_name").collect()] == ["dog", "yak"]
    assert "xml" not in kept.labels._jdf.queryExecution().executedPlan().toString()


def test_octree_counts_roll_up_level_by_level(spark):
    import random

    from framewright.operators import cloud

    rnd = random.Random(1)
    data = [(c, i, rnd.choice((0.0, 1.0, rnd.random())), rnd.random(), rnd.random()) for c in (1, 2) for i in range(300)] + [(3, 0, 1.0, 1.0, 1.0)]
    points = spark.createDataFrame(data, "cloud_id BIGINT, point_idx BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")
    limit, depth, target = 20, 3, 7
    at = {(r["cloud_id"], r["point_idx"]): (r["cx"], r["cy"], r["cz"]) for r in cloud.octree_codes(points, depth).collect()}
    count = {}
    for (c, i), cell in at.items():
        for level in range(depth + 1):
            count.setdefault((c, level, *(v >> depth - level for v in cell)), []).append(i)
    tree = {k for k in count if k[1] == 0 or len(count[k[0], k[1] - 1, k[2] >> 1, k[3] >> 1, k[4] >> 1]) > limit}
    leaf = {k: len(count[k]) <= limit or k[1] >= depth for k in tree}
    step = {k: 1 if leaf[k] else -(-len(count[k]) // target) for k in tree}
    nodes = cloud.octree_nodes(points, limit, depth, target)
    assert rows(nodes) == sorted([(*k, len(count[k]), leaf[k], step[k], -(-len(count[k]) // step[k])) for k in tree], key=repr)
    shown = cloud.octree_points(points, limit, depth, target).select("cloud_id", "level", "nx", "ny", "nz", "point_idx", "is_leaf")
    assert rows(shown) == sorted([(*k, i, leaf[k]) for k in tree for r, i in enumerate(sorted(count[k])) if r % step[k] == 0], key=repr)
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan.split("RepartitionByExpression")[0]


def test_nodes_of_an_octree_are_not_sent_to_every_task(spark, monkeypatch):
    from framewright.operators import cloud

    points = spark.createDataFrame([(1, i, i / 9.0, i / 7.0, 0.0) for i in range(90)], "cloud_id BIGINT, point_idx BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")
    plans, kept = [], cloud.stored

    def noted(df, label):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df, label)

    monkeypatch.setattr(cloud, "stored", noted)
    plans.append(cloud.octree_points(points, 20, 3, 7)._jdf.queryExecution().sparkPlan().toString())
    joins = [line.split("Join ")[1].split("]")[0] for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert not [j for j in joins if "px#" in j or "nx#" in j and "_bucket" not in j or "cx#" in j]
    assert sum(p.count("SortMergeJoin") for p in plans) >= 3


def test_stored_rows_leave_no_shuffle_files(spark):
    from framewright.session import stored

    sc = spark.sparkContext._jsc.sc()
    blocks = lambda: sc.env().shuffleManager().shuffleBlockResolver().getStoredShuffles().size()
    before, key = blocks(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    df = stored(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert spark.conf.get(key, None) == was and blocks() <= before
    assert df.count() == 7 and df.agg(F.sum("count")).first()[0] == 1000


def test_neighbors_leave_the_task_as_one_row_a_point(spark):
    import random

    from framewright.operators import neighbors

    rnd = random.Random(2)
    data = [(c, i, rnd.random(), rnd.random(), rnd.choice((0.0, rnd.random()))) for c in (1, 2) for i in range(90)] + [(3, 0, 1.0, 1.0, 1.0), (4, 0, 1.0, 1.0, 1.0), (4, 1, 1.0, 1.0, 2.0)]
    points = spark.createDataFrame(data, "cloud_id BIGINT, point_idx BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")

    def near(f):
        small, large = ({tuple(r)[:2]: tuple(r)[2:] for r in f(block).collect()} for block in (2048, 16))
        assert small.keys() == large.keys() and len(small) > 90
        assert all(abs(a - b) < 1e-6 for k in small for a, b in zip(small[k], large[k]))

    near(lambda block: neighbors.statistical_outliers(points, 5, 1.5, block).select("cloud_id", "point_idx", "mean_dist"))
    near(lambda block: neighbors.normals(points, 0.4, 6, block).select("cloud_id", "point_idx", "used", "residual", "x", "nz"))
    plan = neighbors.normals(points, 0.4, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan


def test_pieces_of_a_large_file_are_packed(spark, tmp_path, monkeypatch):
    from framewright.sinks.files import write_lines

    text = '{"token": "%05d", "rotation": [1.0, 0.0, 0.0, 0.0], "translation": [0.0, 0.0, 0.0]}'
    large = spark.range(20000).select(
        F.lit("a/large.json").alias("rel"), F.col("id").alias("n"), F.format_string(text, "id").alias("line"), F.lit("list").alias("section"))
    more = spark.createDataFrame(
        [("a/large.json", -1, "[", None), ("a/large.json", 99999, "]", None), ("b/none.txt", 0, None, None), ("c/few.txt", 1, "x", None), ("c/few.txt", 2, "y", None)],
        "rel STRING, n BIGINT, line STRING, section STRING")
    made, sizes = spark.createDataFrame, []

    def noted(*args, **kw):
        sizes.extend(p.stat().st_size for p in tmp_path.rglob(".large.json.*"))
        return made(*args, **kw)

    rows_of = large.unionByName(more)
    monkeypatch.setattr(rows_of.sparkSession, "createDataFrame", noted)
    write_lines(rows_of, str(tmp_path), ["n"])
    want = "[\n" + ",\n".join(text % i for i in range(20000)) + "\n]\n"
    assert (tmp_path / "a/large.json").read_text() == want
    assert (tmp_path / "b/none.txt").read_bytes() == b"" and (tmp_path / "c/few.txt").read_text() == "x\ny\n"
    assert len(sizes) > 3 and sum(sizes) < len(want) / 3
    assert not [p for p in tmp_path.rglob(".*") if not p.name.endswith(".crc")]


def test_numbered_rows_are_pinned_as_parquet(spark):
    from framewright.operators.ranking import dense_ids, range_rank

    df = spark.createDataFrame([(i % 3, -i, None) for i in range(50)], "k BIGINT, v BIGINT, w STRING")
    got = dense_ids(df, [F.col("v")], "n")
    assert "Scan ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString().split("Broadcast")[0]
    assert [r["n"] for r in got.orderBy("v").collect()] == list(range(50))
    ranked = range_rank(df, ["k"], [F.col("v")], "r", "n")
    assert rows(ranked.select("k", "v", "r", "n")) == rows(df.selectExpr("k", "v", "int(-v / 3) r", "count(*) OVER (PARTITION BY k) n").selectExpr("k", "v", "n - 1 - r r", "n"))
    bare = df.select("v", F.lit(None).alias("nothing"))
    assert dense_ids(bare, [F.col("v")], "n").where("n = 0 AND nothing IS NULL").count() == 1


def _boxes(spark):
    from framewright.model import Dataset

    samples = spark.createDataFrame(
        [(i, i, f"/d/im{i}.jpg", 100, 50, "s1" if i < 3 else "s2", "cam", i * 10) for i in range(5)],
        "sample_id BIGINT, ordinal BIGINT, image_path STRING, image_width INT, image_height INT, scene STRING, camera STRING, timestamp BIGINT")
    labels = spark.createDataFrame(
        [(i % 5, i, "car" if i % 2 else "van", i % 2, 0.5, 0.5, 0.2, 0.2, 1.0, None if i % 7 == 0 else i % 4) for i in range(60)],
        "sample_id BIGINT, label_index BIGINT, class_name STRING, class_id INT, cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE, confidence DOUBLE, track_id BIGINT")
    classes = spark.createDataFrame([(0, "van"), (1, "car")], "class_id INT, class_name STRING")
    return Dataset(samples, labels, classes, "boxes")


def test_openlabel_rows_are_worked_out_once_and_scratch_goes(spark, tmp_path, monkeypatch):
    from framewright import session
    from framewright.sinks import scenes as S
    from framewright.sources import scenes as R

    made, path_of = [], session.scratch_path

    def noted(*args):
        made.append(path_of(*args))
        return made[-1]

    monkeypatch.setattr(session, "scratch_path", noted)
    S.write_openlabel(_boxes(spark), str(tmp_path / "ol"))
    assert made and not [p for p in made if Path(p.removeprefix("file:")).exists()]
    labels = R.read_openlabel(spark, str(tmp_path / "ol"), layout="lines").labels
    assert labels.count() == 60 and labels.select("sample_id", "uid").distinct().count() == 60
    plain = [r["uid"] for r in labels.collect() if r["uid"].count("-") == 1]
    assert len(plain) == len({(i % 5, i % 4) for i in range(60) if i % 7})  # the first of a track in a frame keeps its name
    assert "Scan text" not in labels._jdf.queryExecution().executedPlan().toString()  # lines were parsed before, once


def test_cvat_text_and_tables_of_a_writer_do_not_stay(spark, tmp_path, monkeypatch):
    from framewright import session
    from framewright.sinks import labels as S
    from framewright.sources import labels as R
    from framewright.sources import registry

    made, path_of = [], session.scratch_path

    def noted(*args):
        made.append(path_of(*args))
        return made[-1]

    monkeypatch.setattr(session, "scratch_path", noted)
    left = lambda: {p.rpartition("/")[2].rpartition("-")[0] for p in made if Path(p.removeprefix("file:")).exists()}
    S.write_cvat(_boxes(spark), str(tmp_path / "a"))
    assert made and not left()
    assert R.read_cvat(spark, str(tmp_path / "a/annotations.xml")).labels.count() == 60
    assert left() == {"cvat-elements", "cvat-classes"}
    made.clear()
    registry.convert(spark, "cvat", str(tmp_path / "a/annotations.xml"), "coco", str(tmp_path / "b"))
    assert made and not left()
    assert R.read_coco(spark, str(tmp_path / "b"), layout="lines").labels.count() == 60


def test_a_tile_of_equal_vectors_does_not_list_its_pairs(spark):
    import numpy as np

    from framewright.operators import dedupe

    near = np.ones((300, 400), bool)
    i, j = dedupe._branches(near)
    assert len(i) == 699 and near[i, j].all()
    rnd = np.random.default_rng(3)
    for share in (0.0, 0.002, 0.01, 0.2):
        near = rnd.random((60, 80)) < share
        edges = lambda i, j: dedupe._spanning(pd.DataFrame({"a": i, "b": np.asarray(j) + 1000}))
        thin, full = edges(*dedupe._branches(near)), edges(*np.nonzero(near))
        assert len(thin) == len(full) == len(dedupe._branches(near)[0])


def test_copies_of_vectors_leave_in_bounded_batches(spark, monkeypatch):
    import math

    from framewright.operators import dedupe

    data = [(i, [math.cos(i / 50), math.sin(i / 50), 1.0]) for i in range(300)]
    df = spark.createDataFrame(data, "id BIGINT, vector ARRAY<DOUBLE>")
    want = {(a, b) for a, va in data for b, vb in data if a < b and sum(x * y for x, y in zip(va, vb)) / 2 >= 0.99}
    got = dedupe.cosine_pairs(df, 0.99, tile=16)
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    plain = dedupe.components(dedupe.cosine_pairs(df, 0.99, tile=16, forest=True))
    assert rows(plain) == rows(dedupe.components(got.select("a", "b")))
    assert dedupe._COPIES * 64 * 8 < 16 << 20


def test_yolo_listings_are_taken_once(spark, tmp_path):
    from framewright.sources import yolo

    (tmp_path / "train/images").mkdir(parents=True)
    (tmp_path / "train/labels").mkdir()
    (tmp_path / "data.yaml").write_text("train: train/images\nval: val/images\nnames:\n  0: 'car'\n")
    for i in range(3):
        (tmp_path / f"train/images/a b{i}.jpg").write_text("image")
        (tmp_path / f"train/labels/a b{i}.txt").write_text("0 0.5 0.5 0.2 0.2\n" * i + "#\n")
    ds = yolo.read_yolo(spark, str(tmp_path))
    labels = ds.labels.join(ds.samples.select("sample_id", "split"), "sample_id")
    plan = labels._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and plan.count(" text") <= 1  # one listing is left, that of the label files
    assert ds.samples.where("split = 'train' AND label_path IS NOT NULL").count() == 3


def test_coco_documents_are_read_twice_at_most(spark, tmp_path):
    from framewright.sinks import labels as S
    from framewright.sources import labels as R

    S.write_coco(_boxes(spark), str(tmp_path), shards=2)
    ds = R.read_coco(spark, str(tmp_path))
    assert ds.labels.count() == 60 and ds.samples.count() == 5
    assert ds.labels._jdf.queryExecution().optimizedPlan().toString().count(" json") == 1


def test_coco_documents_are_one_record_each(spark, tmp_path):
    from framewright.sources import labels as R

    text = """{"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 10}],
      "annotations": [
        {"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 1, 2, 2], "segmentation": { "size": [10, 10],\n "counts": [1.50, 2] }},
        {"id": 2, "image_id": 1, "category_id": 1, "bbox": [1, 1, 2, 2], "segmentation": []}],
      "categories": [{"id": 1, "name": "\u0101 car"}]}"""
    for i in range(3):
        (tmp_path / f"{i}.json").write_text("\n" * i + text, encoding="utf-16" if i == 2 else "utf-8")
    (tmp_path / "bad.json").write_text('{"images": [')
    (tmp_path / "none.json").write_text("")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        _, anns, cats = R.coco_tables(spark, str(tmp_path))
        got = rows(anns.select(F.regexp_extract("path", "([^/]+)$", 1), "id", "segmentation"))
        names = rows(cats.select("name"))
        plan = anns._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    mask = '{ "size": [10, 10],\n "counts": [1.50, 2] }'
    assert [g for g in got if not g[0].startswith("2")] == [(f"{i}.json", n, s) for i in range(2) for n, s in ((1, mask), (2, "[]"))]
    assert names == [("\u0101 car",)] * 3 and len(got) == 6 and " json" in plan
