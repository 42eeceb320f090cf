"""Label quality checks: tables in, one issue table out."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.boxes import center_to_corners
from framewright.functions.joins import CORNERS, crowd_counts, self_iou_counts, self_iou_join
from framewright.model import Dataset
from framewright.operators import dataset as D
from framewright.operators import hooks
from framewright.session import materialize

log = logging.getLogger(__name__)

# Default thresholds, the duplicate rule and the severity order.
IOU, TINY, HUGE, IMBALANCE = 0.8, 0.001, 0.9, 10.0
DUPLICATE_IOU = 0.95
SEVERITIES = ("error", "warning", "info")

_COLS = ("issue_type", "severity", "sample_id", "label_index", "other_index", "class_name", "measure")


def severity_rank(col: Column | str = "severity") -> Column:
    col = F.col(col) if isinstance(col, str) else col
    rank = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        rank = F.when(col == s, i).otherwise(rank)
    return rank


def _issues(df: DataFrame, kind: str, severity: str, **cols: Column | str) -> DataFrame:
    types = dict(
        sample_id="bigint", label_index="bigint", other_index="bigint", class_name="string",
        measure="double",
    )
    picked = {
        c: (F.col(cols[c]) if isinstance(cols.get(c), str) else cols.get(c, F.lit(None))).cast(t)
        for c, t in types.items()
    }
    named = F.col(cols["kind_col"]) if "kind_col" in cols else F.lit(kind)
    return df.select(
        named.alias("issue_type"),
        F.lit(severity).alias("severity"),
        *[e.alias(c) for c, e in picked.items()],
    )


def with_corners(labels: DataFrame) -> DataFrame:
    x1, y1, x2, y2 = center_to_corners(*(F.col(c) for c in ("cx", "cy", "w", "h")))
    return labels.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})


def missing_labels(ds: Dataset) -> DataFrame:
    return _issues(D.unlabeled_samples(ds), "missing_labels", "warning", sample_id="sample_id")


def missing_images(ds: Dataset, inventory: DataFrame) -> DataFrame:
    return _issues(
        D.missing_images(ds, inventory), "missing_image", "error", sample_id="sample_id"
    )


def _pairs(labels: DataFrame, threshold: float, same_class: bool) -> DataFrame:
    slim = with_corners(labels).select(
        "sample_id", "label_index", "class_id", "class_name", "x1", "y1", "x2", "y2"
    )
    keys = ["sample_id", "class_id"] if same_class else ["sample_id"]
    return self_iou_join(slim, keys, "label_index", threshold).where(F.col("iou") > threshold)


def overlapping(ds: Dataset, threshold: float = IOU) -> DataFrame:
    pairs = _pairs(ds.labels, threshold, same_class=False)
    return _issues(
        pairs, "overlapping_boxes", "warning", sample_id="sample_id",
        label_index=F.col("l.label_index"), other_index=F.col("r.label_index"),
        class_name=F.col("l.class_name"), measure="iou",
    )


def duplicate_labels(ds: Dataset) -> DataFrame:
    pairs = _pairs(ds.labels, DUPLICATE_IOU, same_class=True)
    return _issues(
        pairs, "duplicate_label", "warning", sample_id="sample_id",
        label_index=F.col("l.label_index"), other_index=F.col("r.label_index"),
        class_name=F.col("l.class_name"), measure="iou",
    )


def pair_counts(ds: Dataset, threshold: float = IOU, most: int = 4096) -> DataFrame:
    """``sample_id, issue_type, pairs, boxes, max_iou``: how often both pair checks hit in a sample, without listing the pairs.

    For corpora with crowds of equal boxes, whose pairs grow with the square. The boxes of a sample of up to ``most`` are shuffled once and
    counted together; larger samples, and those with a missing class or boxes without end, are cut into cells by ``self_iou_counts``.
    """
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    slim = with_corners(ds.labels).where(solid).select("sample_id", "class_id", *[(F.col(c) + 0.0).alias(c) for c in CORNERS])
    above = lambda t: math.nextafter(t, 2.0)  # noqa: E731  the checks ask for more than the threshold
    kinds = (("overlapping_boxes", above(threshold), False), ("duplicate_label", above(DUPLICATE_IOU), True))
    odd = F.col("class_id").isNull()
    for c in CORNERS:
        odd = odd | F.col(c).isNaN() | (F.abs(F.col(c)) == float("inf"))
    sizes = slim.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"), F.max(odd).alias("_odd"))
    large = materialize(sizes.where((F.col("_n") > most) | F.col("_odd") | F.col("sample_id").isNull()).select(F.col("sample_id").alias("_large")))
    parts, small = [], slim
    if not large.isEmpty():
        same = F.col("sample_id").eqNullSafe(F.col("_large"))
        crowds, small = slim.join(large, same, "left_semi"), slim.join(large, same, "left_anti")
        parts = [
            self_iou_counts(crowds, ["sample_id"], t, ["class_id"] if by else []).select(
                "sample_id", F.lit(kind).alias("issue_type"), "pairs", "boxes", "max_iou")
            for kind, t, by in kinds
        ]

    def counted(rows: pd.DataFrame) -> tuple:
        xy, classes = rows[list(CORNERS)].to_numpy(), rows["class_id"].to_numpy()
        return (rows["sample_id"].iloc[0], *[v for _, t, by in kinds for v in crowd_counts(xy, t, classes if by else None)])

    fields = ", ".join(f"pairs_{i} BIGINT, boxes_{i} BIGINT, max_{i} DOUBLE" for i in range(len(kinds)))
    wide = hooks.apply_sample(small, counted, f"sample_id {slim.schema['sample_id'].dataType.simpleString()}, {fields}")
    each = [
        F.struct(F.lit(kind).alias("issue_type"), F.col(f"pairs_{i}").alias("pairs"), F.col(f"boxes_{i}").alias("boxes"), F.col(f"max_{i}").alias("max_iou"))
        for i, (kind, _, _) in enumerate(kinds)
    ]
    found = wide.select("sample_id", F.explode(F.array(*each)).alias("k")).select("sample_id", "k.*").where("pairs > 0")
    return reduce(DataFrame.unionByName, [found, *parts])


def pair_checks(ds: Dataset, threshold: float = IOU) -> DataFrame:
    """Overlapping boxes and duplicate labels from one pair join."""
    return pair_issues(_pairs(ds.labels, min(threshold, DUPLICATE_IOU), same_class=False), threshold)


def pair_issues(pairs: DataFrame, threshold: float = IOU) -> DataFrame:
    """Issues of joined pairs ``sample_id, l, r, iou``, the lower label on the left."""
    twin = (F.col("iou") > DUPLICATE_IOU) & (F.col("l.class_id") == F.col("r.class_id"))
    kinds = F.filter(
        F.array(
            F.when(F.col("iou") > threshold, "overlapping_boxes"), F.when(twin, "duplicate_label")
        ),
        lambda k: k.isNotNull(),
    )
    found = pairs.select(
        "sample_id", F.col("l.label_index").alias("i"), F.col("r.label_index").alias("j"),
        F.col("l.class_name").alias("class_name"), "iou", F.explode(kinds).alias("kind"),
    )
    return _issues(
        found, "", "warning", sample_id="sample_id", label_index="i", other_index="j",
        class_name="class_name", measure="iou", kind_col="kind",
    )


def out_of_bounds(labels: DataFrame) -> DataFrame:
    inside = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= 1) & (F.col("y2") <= 1)
    return _issues(
        with_corners(labels).where(~inside), "out_of_bounds", "warning", sample_id="sample_id",
        label_index="label_index", class_name="class_name",
    )


def tiny_boxes(labels: DataFrame, threshold: float = TINY) -> DataFrame:
    area = F.col("w") * F.col("h")
    return _issues(
        labels.where(area < threshold), "tiny_box", "warning", sample_id="sample_id",
        label_index="label_index", class_name="class_name", measure=area,
    )


def huge_boxes(labels: DataFrame, threshold: float = HUGE) -> DataFrame:
    area = F.col("w") * F.col("h")
    return _issues(
        labels.where(area > threshold), "huge_box", "info", sample_id="sample_id",
        label_index="label_index", class_name="class_name", measure=area,
    )


def class_imbalance(ds: Dataset, ratio: float = IMBALANCE) -> DataFrame:
    counts = ds.labels.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    if ds.classes is not None:
        declared = ds.classes.select("class_name", F.lit(0).cast("bigint").alias("n"))
        counts = counts.unionByName(declared).groupBy("class_name").agg(F.sum("n").alias("n"))
    # One row per class.
    top = F.max("n").over(Window.partitionBy(F.lit(0)))
    gap = F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("top"), F.col("n")))
    rows = counts.withColumn("top", top).where(F.col("top") > 0).withColumn("gap", gap)
    return _issues(
        rows.where(F.col("gap") > ratio), "class_imbalance", "warning",
        class_name="class_name", measure="gap",
    )


def row_checks(labels: DataFrame, tiny: float = TINY, huge: float = HUGE) -> DataFrame:
    """Box checks that need one row only, in a single scan; also used on streams."""
    area = F.col("w") * F.col("h")
    inside = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= 1) & (F.col("y2") <= 1)

    def found(cond: Column, kind: str, severity: str, measure: Column) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"),
                measure.cast("double").alias("measure"),
            ),
        )

    hits = F.filter(
        F.array(
            found(~inside, "out_of_bounds", "warning", F.lit(None)),
            found(area < tiny, "tiny_box", "warning", area),
            found(area > huge, "huge_box", "info", area),
        ),
        lambda h: h.isNotNull(),
    )
    return (
        with_corners(labels)
        .withColumn("_hit", F.explode(hits))
        .select(
            "_hit.issue_type", "_hit.severity", "sample_id", "label_index",
            F.lit(None).cast("bigint").alias("other_index"), "class_name", "_hit.measure",
        )
    )


def run(
    ds: Dataset,
    inventory: DataFrame | None = None,
    checks: Sequence[str] | None = None,
    iou_threshold: float = IOU,
    tiny: float = TINY,
    huge: float = HUGE,
    imbalance_ratio: float = IMBALANCE,
) -> DataFrame:
    """Union of the selected checks; unknown names are skipped with a warning."""
    for label, v in (("iou_threshold", iou_threshold), ("tiny", tiny), ("huge", huge)):
        if not 0.0 <= v <= 1.0:
            raise ValueError(f"{label} must be between 0 and 1, got {v}")
    if imbalance_ratio <= 0:
        raise ValueError(f"imbalance_ratio must be > 0, got {imbalance_ratio}")

    def one_row(kinds: Sequence[str]) -> DataFrame:
        return row_checks(ds.labels, tiny, huge).where(F.col("issue_type").isin(list(kinds)))

    table = {
        "missing_labels": lambda: missing_labels(ds),
        "missing_images": lambda: missing_images(ds, inventory),
        "overlapping_boxes": lambda: overlapping(ds, iou_threshold),
        "out_of_bounds": lambda: one_row(["out_of_bounds"]),
        "box_sizes": lambda: one_row(["tiny_box", "huge_box"]),
        "class_imbalance": lambda: class_imbalance(ds, imbalance_ratio),
        "duplicate_labels": lambda: duplicate_labels(ds),
    }
    wanted = list(checks) if checks else [c for c in table if c != "missing_images" or inventory]
    parts = []
    if {"out_of_bounds", "box_sizes"} <= set(wanted):  # both share one scan
        wanted = [c for c in wanted if c not in ("out_of_bounds", "box_sizes")]
        parts.append(row_checks(ds.labels, tiny, huge))
    if {"overlapping_boxes", "duplicate_labels"} <= set(wanted):  # both share one pair join
        wanted = [c for c in wanted if c not in ("overlapping_boxes", "duplicate_labels")]
        parts.append(pair_checks(ds, iou_threshold))
    for name in wanted:
        if name not in table:
            log.warning("skipping unknown check %s", name)
            continue
        parts.append(table[name]())
    if not parts:
        return ds.labels.sparkSession.createDataFrame(
            [], "issue_type STRING, severity STRING, sample_id BIGINT, label_index BIGINT, "
            "other_index BIGINT, class_name STRING, measure DOUBLE",
        )
    return reduce(DataFrame.unionByName, parts)
