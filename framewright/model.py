"""Table schemas and the small holder that keeps a dataset's tables together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = (
    "sample_id BIGINT, ordinal BIGINT, image_path STRING, image_width INT, image_height INT, "
    "split STRING"
)
LABELS = (
    "sample_id BIGINT, label_index BIGINT, class_name STRING, class_id INT, "
    "cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE, confidence DOUBLE, "
    "attributes MAP<STRING,STRING>, track_id BIGINT"
)
CLASSES = "class_id INT, class_name STRING"

BOX = ("cx", "cy", "w", "h")


def unit(col: Column) -> Column:
    """Clamp into [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def checked_labels(labels: DataFrame) -> DataFrame:
    """Bring labels to the model's rules: clamped boxes and confidences, ids >= 0.

    Labels with a negative class id break the model; the job fails when it meets one.
    """
    ok = F.when(F.col("class_id") >= 0, F.col("class_id")).otherwise(
        F.raise_error(F.concat(F.lit("class_id must be >= 0, got "), F.col("class_id"))).cast("int")
    )
    cols = {c: unit(F.col(c)) for c in (*BOX, "confidence")}
    return labels.withColumns({**cols, "class_id": ok})


@dataclass(frozen=True)
class Dataset:
    """``samples`` and ``labels`` share ``sample_id``; ``classes`` may be inferred (None)."""

    samples: DataFrame
    labels: DataFrame
    classes: DataFrame | None = None
    name: str = "dataset"
