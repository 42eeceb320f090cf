"""Corpus integrity: what refers to what is not there. All findings come back, not the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.review import file_stem


def orphans(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key is not among the others."""
    return rows.join(others.select(F.col(other_key).alias(key)), key, "left_anti")


def stem_pairing(images: DataFrame, labels: DataFrame) -> DataFrame:
    """``stem, finding`` of images without a label file and label files without an image."""
    a = images.select(file_stem(F.col("path")).alias("stem")).distinct()
    b = labels.select(file_stem(F.col("path")).alias("stem")).distinct()
    return a.join(b, "stem", "left_anti").withColumn("finding", F.lit("missing_label")).unionByName(
        b.join(a, "stem", "left_anti").withColumn("finding", F.lit("missing_image"))
    )


def yolo_lines(lines: DataFrame) -> DataFrame:
    """Lines that are malformed: too few fields, bad numbers, an odd or short polygon, or a value
    outside [0, 1]."""
    text = F.trim("line")
    rows = lines.where((text != "") & ~text.startswith("#")).withColumn("_p", F.split(text, r"\s+"))
    vals = F.transform(F.slice("_p", 2, F.size("_p")), lambda v: v.try_cast("double"))
    rows = rows.withColumn("_v", vals)
    n = F.size("_v")
    bad_number = F.get("_p", F.lit(0)).try_cast("int").isNull() | F.exists("_v", lambda v: v.isNull())
    finding = (
        F.when(F.size("_p") < 5, "too_few_fields")
        .when(bad_number, "bad_number")
        .when((n != 4) & ((n < 6) | (n % 2 == 1)), "bad_count")
        .when(F.exists("_v", lambda v: (v < 0) | (v > 1)), "out_of_range")
    )
    return rows.withColumn("finding", finding).where("finding IS NOT NULL").drop("_p", "_v")


def coco_integrity(images: DataFrame, anns: DataFrame, cats: DataFrame) -> DataFrame:
    """``finding, id, n``: repeated ids, unknown references, boxes of other than four numbers."""

    def repeated(df: DataFrame, name: str) -> DataFrame:
        per = df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return per.select(F.lit(f"duplicate_{name}").alias("finding"), "id", "n")

    def unknown(key: str, others: DataFrame, name: str) -> DataFrame:
        lost = orphans(anns, key, others, "id")
        per = lost.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        return per.select(F.lit(f"unknown_{name}").alias("finding"), "id", "n")

    arity = anns.where(F.size("bbox") != 4).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return reduce(
        DataFrame.unionByName,
        [
            repeated(images, "image"), repeated(anns, "annotation"), repeated(cats, "category"),
            unknown("image_id", images, "image"), unknown("category_id", cats, "category"),
            arity.select(F.lit("bbox_arity").alias("finding"), "id", "n"),
        ],
    )
