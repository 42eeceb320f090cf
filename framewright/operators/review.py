"""Review queue: items, edits, paging and annotation import. Annotations stay rows of their own
table keyed by item, so an item with very many of them is not one huge row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.boxes import clean_stem


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def page(
    items: DataFrame,
    execution_id=None,
    project_id=None,
    status: str | None = None,
    skip: int = 0,
    limit: int = 50,
) -> DataFrame:
    """One page of the filtered items in id order."""
    if skip < 0 or not 1 <= limit <= 200:
        raise ValueError("skip must be >= 0 and limit in 1..200")
    for name, value in (("execution_id", execution_id), ("project_id", project_id), ("status", status)):
        if value is not None:
            items = items.where(F.col(name) == value)
    return items.orderBy("item_id").offset(skip).limit(limit)


def filter_items(
    items: DataFrame,
    annotations: DataFrame,
    status: str | None = None,
    label: str | None = None,
    search: str | None = None,
    min_confidence: float = 0.0,
    max_confidence: float = 1.0,
) -> DataFrame:
    """Items by status, label present, name part (any case) and highest confidence; items without
    annotations pass the confidence test."""
    if status:
        items = items.where(F.col("status") == status)
    if search:
        items = items.where(F.contains(F.lower(file_name(F.col("file_path"))), F.lit(search.lower())))
    if label:
        hit = annotations.where(F.col("class_name") == label).select("item_id")
        items = items.join(hit, "item_id", "left_semi")
    top = annotations.groupBy("item_id").agg(F.max("confidence").alias("_top"))
    fits = F.col("_top").isNull() | F.col("_top").between(min_confidence, max_confidence)
    return items.join(top, "item_id", "left").where(fits).drop("_top")


def apply_edits(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Latest edit of each item wins: a status edit sets status and ``reviewed_at``, an annotation
    edit makes the item ``modified``. ``reviewed_at`` is that of the latest status edit."""
    at = F.struct("ts", "edit_id")
    new = F.when(F.col("annotations_edited"), "modified").otherwise(F.col("status"))
    counts = F.col("annotations_edited") | F.col("status").isNotNull()
    latest = edits.where(counts).groupBy("item_id").agg(
        F.max_by(new, at).alias("_status"),
        F.max(F.when(F.col("status").isNotNull(), F.col("ts"))).alias("reviewed_at"),
        F.count(F.lit(1)).alias("edit_count"),
    )
    return items.join(latest, "item_id", "left").select(
        *[c for c in items.columns if c != "status"],
        F.coalesce("_status", "status").alias("status"),
        "reviewed_at",
        F.coalesce("edit_count", F.lit(0)).alias("edit_count"),
    )


def batch_status(items: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Requested ids with the status set, or ``not_found``."""
    wanted = ids.select("item_id").distinct()
    known = items.select("item_id", F.lit(True).alias("_known"))
    return wanted.join(known, "item_id", "left").select(
        "item_id",
        F.when(F.col("_known"), status).otherwise("not_found").alias("result"),
    )


def review_counts(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(
        *[
            F.count_if(F.col("status") == s).alias(s)
            for s in ("pending", "approved", "rejected")
        ]
    )


def match_annotation_files(images: DataFrame, files: DataFrame) -> DataFrame:
    """Annotation file of each image: same stem, else the first (by path) whose stem without a
    number prefix is the image's stem. Images without one keep null."""
    f = files.select(F.col("path").alias("annotation_path"), file_stem(F.col("path")).alias("_stem"))
    exact = f.groupBy(F.col("_stem")).agg(F.min("annotation_path").alias("_exact"))
    loose = f.groupBy(clean_stem(F.col("_stem")).alias("_stem")).agg(
        F.min("annotation_path").alias("_loose")
    )
    return (
        images.withColumn("_stem", file_stem(F.col("image_path")))
        .join(exact, "_stem", "left")
        .join(loose, "_stem", "left")
        .withColumn("annotation_path", F.coalesce("_exact", "_loose"))
        .drop("_stem", "_exact", "_loose")
    )


def match_items(images: DataFrame, items: DataFrame) -> DataFrame:
    """Review item of each image: by path (the last item of a path reviewed more than once), else by
    file name when only one item has it."""
    by_path = items.groupBy(F.col("file_path").alias("image_path")).agg(F.max("item_id").alias("_p"))
    by_name = (
        items.groupBy(file_name(F.col("file_path")).alias("_name"))
        .agg(F.min("item_id").alias("_n"), F.count(F.lit(1)).alias("_c"))
        .where("_c = 1")
        .drop("_c")
    )
    return (
        images.withColumn("_name", file_name(F.col("image_path")))
        .join(by_path, "image_path", "left")
        .join(by_name, "_name", "left")
        .withColumn("item_id", F.coalesce("_p", "_n"))
        .drop("_name", "_p", "_n")
    )


def build_queue(images: DataFrame, files: DataFrame, annotations: DataFrame, execution_id, project_id):
    """Pending items, one per image, and their annotation rows (``annotation_path`` keyed)."""
    items = match_annotation_files(images, files).select(
        F.col("sample_id").alias("item_id"),
        F.lit(execution_id).alias("execution_id"),
        F.lit(project_id).alias("project_id"),
        F.col("image_path").alias("file_path"),
        "annotation_path",
        F.lit("pending").alias("status"),
    )
    return items, annotations.join(items.select("item_id", "annotation_path"), "annotation_path")


def detection_summary(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Per class: detections, files with one, mean confidence rounded to 3."""
    return (
        detections.join(images.select("sample_id"), "sample_id", "left_semi")
        .groupBy("class_name", "sample_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("s"))
        .groupBy("class_name")
        .agg(
            F.sum("n").alias("count"),
            F.count(F.lit(1)).alias("files"),
            F.round(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)), 3).alias("average_confidence"),
        )
    )


def per_image_counts(detections: DataFrame, images: DataFrame, name: str = "count") -> DataFrame:
    """Detections per image, zero included."""
    n = detections.groupBy("sample_id").agg(F.count(F.lit(1)).alias(name))
    return images.select("sample_id").join(n, "sample_id", "left").na.fill(0, [name])
