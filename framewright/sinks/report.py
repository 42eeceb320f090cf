"""Report tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from framewright.model import Dataset
from framewright.operators import dataset as D
from framewright.operators import report


def write_report_tables(ds: Dataset, issues: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """``classes`` (labels, samples and labels per sample of every class), ``issue_counts``, ``issues`` (the first
    of each type, with the number not shown) and ``gallery`` below ``root``.

    ``issues`` is read three times, so pass a stored table.
    """
    classes = (
        ds.classes.join(D.class_details(ds.labels), "class_name", "left")
        .na.fill(0, ["label_count", "sample_count"]).na.fill(0.0, ["avg_per_sample"])
    )
    tables = {
        "classes": classes,
        "issue_counts": report.issue_summary(issues, ds.samples),
        "issues": report.issues_capped(issues),
        "gallery": report.gallery_rank(issues, ds.samples),
    }
    for name, rows in tables.items():
        rows.write.mode(mode).parquet(f"{root}/{name}")
