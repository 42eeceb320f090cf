"""Stores that stream jobs keep between triggers."""

from pyspark.sql import functions as F

from framewright.model import Dataset
from framewright.operators import qa
from framewright.streaming import jobs


def test_merge_log_stays_logarithmic(spark, tmp_path):
    log = jobs.MergeLog(spark, str(tmp_path / "log"), lambda d: d.groupBy("k").agg(F.max("v").alias("v")), fan=3)
    want = {}
    for number in range(20):
        rows = [(number % 7, number), (100 + number, number)]
        want.update(rows)
        log.add(spark.createDataFrame(rows, "k INT, v INT").coalesce(1), number)
        parts = log.manifest()["parts"]
        levels = [level for level, _ in parts]
        assert max(levels.count(x) for x in levels) <= 2 and max(levels) <= 3
    log.add(spark.createDataFrame([(0, 999)], "k INT, v INT"), 19)  # a repeated trigger
    assert {r["k"]: r["v"] for r in log.read().collect()} == want
    folders = [p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("part-")]
    assert sorted(folders) == sorted(name for _, name in log.manifest()["parts"])


def test_label_pairs_over_triggers(spark, tmp_path):
    kind = "sample_id BIGINT, label_index BIGINT, class_name STRING, class_id INT, cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE"
    boxes = [(i % 3, i, "car" if i % 2 else "van", i % 2, .5 + (i % 5) * .002, .5, .2, .2) for i in range(24)]
    for n in range(4):
        spark.createDataFrame(boxes[n::4], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", 1)
    got = jobs.new_label_pairs(stream, str(tmp_path / "out"), buckets=2)
    want = qa.pair_checks(Dataset(None, spark.createDataFrame(boxes, kind)))
    key = lambda d: sorted((r["issue_type"], r["sample_id"], r["label_index"], r["other_index"]) for r in d.collect())
    assert key(got) == key(want) and len(key(want)) > 30
    assert len(list((tmp_path / "out" / "data").glob("batch=*"))) == 4
