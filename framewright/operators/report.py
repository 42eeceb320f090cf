"""Summary tables over QA issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.qa import SEVERITIES, severity_rank


def _severity_name(rank):
    name = F.lit(SEVERITIES[-1])
    for i, s in enumerate(SEVERITIES):
        name = F.when(rank == i, s).otherwise(name)
    return name


def issue_summary(issues: DataFrame, samples: DataFrame, paths: int = 5) -> DataFrame:
    """Per issue type: count, worst severity and the first distinct paths (smallest sample ids).

    The paths come from a top-k per type that prunes before the shuffle, never from a collected
    group.
    """
    counts = issues.groupBy("issue_type").agg(
        F.count(F.lit(1)).alias("issue_count"),
        _severity_name(F.min(severity_rank())).alias("severity"),
    )
    seen = issues.where(F.col("sample_id").isNotNull()).select("issue_type", "sample_id").distinct()
    w = Window.partitionBy("issue_type").orderBy("sample_id")
    first = seen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= paths)
    named = first.join(samples.select("sample_id", "image_path"), "sample_id")
    picked = named.groupBy("issue_type").agg(  # at most `paths` rows per type
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rn", "image_path"))), lambda s: s["image_path"]),
            "|",
        ).alias("sample_paths")
    )
    return counts.join(picked, "issue_type", "left").withColumn(
        "sample_paths", F.coalesce("sample_paths", F.lit(""))
    )


def severity_totals(issues: DataFrame) -> DataFrame:
    return issues.agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
    )


def issues_capped(issues: DataFrame, limit: int = 25) -> DataFrame:
    """First issues of each type and how many more there are (the report's display rule)."""
    w = Window.partitionBy("issue_type").orderBy(
        F.col("sample_id").asc_nulls_last(), "label_index", "other_index", "class_name"
    )
    shown = issues.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)
    totals = issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("_n"))
    return (
        shown.join(totals, "issue_type")
        .withColumn("hidden_count", F.greatest(F.lit(0), F.col("_n") - limit))
        .drop("_n")
    )


def gallery_rank(
    issues: DataFrame, samples: DataFrame, limit: int = 12, per_sample: int = 5
) -> DataFrame:
    """Worst samples first (severity, issue count, path) with their first issues."""
    per = (
        issues.where(F.col("sample_id").isNotNull())
        .groupBy("sample_id")
        .agg(F.min(severity_rank()).alias("_rank"), F.count(F.lit(1)).alias("issue_count"))
        .join(samples.select("sample_id", "image_path"), "sample_id")
    )
    order = ["_rank", F.desc("issue_count"), "image_path"]
    top = per.orderBy(*order).limit(limit)
    top = top.withColumn(
        "gallery_position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    )  # `limit` rows
    w = Window.partitionBy("sample_id").orderBy("issue_type", "label_index", "other_index")
    detail = (
        issues.join(F.broadcast(top), "sample_id")
        .withColumn("issue_position", F.row_number().over(w))
        .where(F.col("issue_position") <= per_sample)
    )
    return detail.select(
        "gallery_position", "image_path", _severity_name(F.col("_rank")).alias("worst_severity"),
        "issue_count", "issue_position", "issue_type", "label_index",
    )
