"""Filters, merges, subsets and statistics of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.model import Dataset


def normalize_names(names: Sequence[str]) -> list[str]:
    """Trimmed class names without blanks and repeats, in order."""
    return list(dict.fromkeys(n.strip() for n in names if n and n.strip()))


def filter_by_class(ds: Dataset, names: Sequence[str]) -> Dataset:
    """Labels of the named classes; samples left without labels go away."""
    labels = ds.labels.where(F.col("class_name").isin(list(names)))
    samples = ds.samples.join(labels.select("sample_id"), "sample_id", "left_semi")
    spark = ds.labels.sparkSession
    classes = spark.createDataFrame(list(enumerate(names)), "class_id INT, class_name STRING")
    return Dataset(samples, labels, classes, ds.name)


def filter_by_confidence(ds: Dataset, minimum: float) -> Dataset:
    """Labels at or above a confidence; samples stay."""
    labels = ds.labels.where(F.col("confidence") >= minimum)
    return Dataset(ds.samples, labels, ds.classes, ds.name)


def subset(ds: Dataset, ordinals: DataFrame) -> Dataset:
    """Samples whose ``ordinal`` is in the table, with their labels."""
    samples = ds.samples.join(ordinals.select("ordinal").distinct(), "ordinal", "left_semi")
    labels = ds.labels.join(samples.select("sample_id"), "sample_id", "left_semi")
    return Dataset(samples, labels, ds.classes, ds.name)


def unlabeled_samples(ds: Dataset) -> DataFrame:
    return ds.samples.join(ds.labels.select("sample_id"), "sample_id", "left_anti")


def missing_images(ds: Dataset, inventory: DataFrame) -> DataFrame:
    """Samples whose path is not in the file inventory (column ``path``)."""
    return ds.samples.join(
        inventory.select(F.col("path").alias("image_path")), "image_path", "left_anti"
    )


def class_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("class_name").agg(F.count(F.lit(1)).alias("label_count"))


def samples_per_class(labels: DataFrame) -> DataFrame:
    return labels.groupBy("class_name").agg(F.countDistinct("sample_id").alias("sample_count"))


def class_details(labels: DataFrame) -> DataFrame:
    """Labels, samples and labels per sample of each class, in one pass over the labels."""
    per_sample = labels.groupBy("class_name", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    return per_sample.groupBy("class_name").agg(
        F.sum("n").alias("label_count"),
        F.count(F.lit(1)).alias("sample_count"),
        (F.sum("n") / F.count(F.lit(1))).alias("avg_per_sample"),
    )


def infer_classes(ds: Dataset) -> DataFrame:
    """First name seen for each class id, in sample and label order."""
    first = F.min_by("class_name", F.struct("ordinal", "label_index"))
    return (
        ds.labels.join(ds.samples.select("sample_id", "ordinal"), "sample_id")
        .groupBy("class_id")
        .agg(first.alias("class_name"))
    )


def resolve_classes(ds: Dataset, keep: str = "last") -> DataFrame:
    """Names for every id from 0 to the largest: gaps become ``class_<id>``, and a placeholder
    gives way to a real name (the last one seen, or the first with ``keep='first'``)."""
    pick = F.max_by if keep == "last" else F.min_by
    seen = (
        ds.labels.where(F.trim("class_name") != "")
        .join(ds.samples.select("sample_id", "ordinal"), "sample_id")
        .groupBy("class_id")
        .agg(pick("class_name", F.struct("ordinal", "label_index")).alias("_seen"))
    )
    declared = ds.classes if ds.classes is not None else infer_classes(ds)
    declared = declared.select("class_id", F.col("class_name").alias("_declared"))
    top = declared.select("class_id").unionByName(seen.select("class_id"))
    ids = top.agg(F.max("class_id").alias("m")).select(
        F.explode(F.sequence(F.lit(0), "m")).alias("class_id")
    )
    default = F.concat(F.lit("class_"), F.col("class_id"))
    stated = F.nullif(F.nullif(F.trim("_declared"), F.lit("")), default)
    return (
        ids.join(declared, "class_id", "left")
        .join(seen, "class_id", "left")
        .select("class_id", F.coalesce(stated, F.col("_seen"), default).alias("class_name"))
    )


def dataset_stats(ds: Dataset) -> DataFrame:
    """One row: samples, labels, classes, unlabeled samples, labels per sample."""
    per_sample = ds.labels.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    classes = ds.classes if ds.classes is not None else ds.labels.select("class_id").distinct()
    totals = ds.samples.join(per_sample, "sample_id", "left").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_labels"),
        F.count_if(F.col("n").isNull()).alias("unlabeled_count"),
    )
    n_classes = classes.agg(F.count(F.lit(1)).alias("num_classes"))
    one = F.lit(1).alias("_one")
    return (
        totals.select("*", one)
        .join(n_classes.select("*", one), "_one")
        .select(
            "num_samples",
            "num_labels",
            "num_classes",
            "unlabeled_count",
            (F.col("num_labels") / F.greatest(F.col("num_samples"), F.lit(1))).alias(
                "avg_labels_per_sample"
            ),
        )
    )


def merge(a: Dataset, b: Dataset, remap: bool = False) -> Dataset:
    """Samples of ``a`` then of ``b``; class names unite in order.

    Class ids of labels stay as they are; with ``remap`` they follow the united list.
    """
    ca = a.classes if a.classes is not None else infer_classes(a)
    cb = b.classes if b.classes is not None else infer_classes(b)
    order = F.struct("_side", "class_id")
    both = ca.withColumn("_side", F.lit(0)).unionByName(cb.withColumn("_side", F.lit(1)))
    names = both.groupBy("class_name").agg(F.min(order).alias("_at"))
    # One row per distinct class name, so the global window sees the class list only.
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_at")) - 1
    classes = names.select(rank.cast("int").alias("class_id"), "class_name")
    src = F.lit(0).alias("source"), F.lit(1).alias("source")
    samples = a.samples.select("*", src[0]).unionByName(
        b.samples.select("*", src[1]), allowMissingColumns=True
    )
    labels = a.labels.select("*", src[0]).unionByName(
        b.labels.select("*", src[1]), allowMissingColumns=True
    )
    if remap:
        labels = labels.drop("class_id").join(classes, "class_name")
    return Dataset(samples, labels, classes, f"{a.name}+{b.name}")


def missing_classes(classes: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Requested class names the dataset does not declare."""
    spark = classes.sparkSession
    want = spark.createDataFrame([(n,) for n in wanted], "class_name STRING")
    return want.join(classes.select("class_name"), "class_name", "left_anti").distinct()


def augment_boxes(
    ds: Dataset,
    copies: int,
    seed: int = 0,
    max_shift: float = 0.1,
    min_visibility: float = 0.01,
    include_original: bool = True,
) -> Dataset:
    """Copies of every sample with seeded mirrored and shifted boxes (pixels are not touched).

    A box is cut to the image and dropped when less than ``min_visibility`` of it remains.
    """

    def draw(tag: str):
        digest = F.md5(F.concat_ws(":", F.col("sample_id"), F.col("copy"), F.lit(f"{seed}{tag}")))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)

    every = F.explode(F.sequence(F.lit(0 if include_original else 1), F.lit(copies)))
    samples = ds.samples.withColumn("copy", every)
    name = F.regexp_replace("image_path", r"(\.[^./]*)$", "")
    ext = F.regexp_extract("image_path", r"(\.[^./]*)$", 1)
    renamed = F.concat(name, F.lit("_aug_"), F.lpad(F.col("copy").cast("string"), 3, "0"), ext)
    samples = samples.withColumn(
        "image_path", F.when(F.col("copy") == 0, F.col("image_path")).otherwise(renamed)
    ).withColumn("augmented", F.col("copy") > 0)
    copied = F.col("copy") > 0
    drawn = F.struct(
        F.when(copied, draw("flip") < 0.5).otherwise(F.lit(False)).alias("_flip"),
        F.when(copied, (draw("dx") * 2 - 1) * max_shift).otherwise(0.0).alias("_dx"),
        F.when(copied, (draw("dy") * 2 - 1) * max_shift).otherwise(0.0).alias("_dy"),
    )
    # The generator of one row keeps Spark from drawing again in the filter and in every corner.
    labels = ds.labels.withColumn("copy", every).select("*", F.inline(F.array(drawn)))
    cx = F.when(F.col("_flip"), 1 - F.col("cx")).otherwise(F.col("cx")) + F.col("_dx")
    cy = F.col("cy") + F.col("_dy")
    one, zero = F.lit(1.0), F.lit(0.0)
    x1, x2 = F.greatest(zero, cx - F.col("w") / 2), F.least(one, cx + F.col("w") / 2)
    y1, y2 = F.greatest(zero, cy - F.col("h") / 2), F.least(one, cy + F.col("h") / 2)
    labels = labels.withColumns({"_x1": x1, "_x2": x2, "_y1": y1, "_y2": y2})
    seen = (F.col("_x2") - F.col("_x1")) * (F.col("_y2") - F.col("_y1"))
    visible = (
        (F.col("_x2") > F.col("_x1"))
        & (F.col("_y2") > F.col("_y1"))
        & (seen >= min_visibility * F.col("w") * F.col("h"))
    )
    moved = {
        "cx": (F.col("_x1") + F.col("_x2")) / 2,
        "cy": (F.col("_y1") + F.col("_y2")) / 2,
        "w": F.col("_x2") - F.col("_x1"),
        "h": F.col("_y2") - F.col("_y1"),
    }
    labels = labels.where((F.col("copy") == 0) | visible).withColumns(
        {c: F.when(F.col("copy") == 0, F.col(c)).otherwise(e) for c, e in moved.items()}
    )
    return Dataset(samples, labels.drop("_flip", "_dx", "_dy", "_x1", "_x2", "_y1", "_y2"), ds.classes, ds.name)
