"""Masks as pixel runs: encode, area, box, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.boxes import run_area


def mask_box(masks: DataFrame) -> DataFrame:
    """Normalized box of the foreground from column-major runs (``runs, height, width``).

    One pass over the runs, never over pixels. A run that crosses a column touches every row.
    """
    big = F.lit((1 << 31) - 1).cast("bigint")

    def step(s: Column, v: Column) -> Column:
        a, b, h = s["pos"], s["pos"] + v - 1, s["h"]
        hit = s["on"] & (v > 0)
        ca, cb = F.floor(a / h), F.floor(b / h)
        top = F.when(ca != cb, F.lit(0).cast("bigint")).otherwise(a % h)
        low = F.when(ca != cb, h - 1).otherwise(b % h)
        return F.struct(
            (s["pos"] + v).alias("pos"), (~s["on"]).alias("on"), h.alias("h"),
            F.when(hit, F.least(s["c0"], ca)).otherwise(s["c0"]).alias("c0"),
            F.when(hit, F.greatest(s["c1"], cb)).otherwise(s["c1"]).alias("c1"),
            F.when(hit, F.least(s["r0"], top)).otherwise(s["r0"]).alias("r0"),
            F.when(hit, F.greatest(s["r1"], low)).otherwise(s["r1"]).alias("r1"),
        )

    start = F.struct(
        F.lit(0).cast("bigint").alias("pos"), F.lit(False).alias("on"),
        F.col("height").cast("bigint").alias("h"), big.alias("c0"), (-big).alias("c1"),
        big.alias("r0"), (-big).alias("r1"),
    )
    found = masks.select("*", F.inline(F.array(F.aggregate("runs", start, step))))
    some = F.col("c1") >= 0
    ends = {
        "x1": F.col("c0") / F.col("width"), "y1": F.col("r0") / F.col("height"),
        "x2": (F.col("c1") + 1) / F.col("width"), "y2": (F.col("r1") + 1) / F.col("height"),
    }
    return found.withColumns({c: F.when(some, e) for c, e in ends.items()}).drop(
        "pos", "on", "h", "c0", "c1", "r0", "r1"
    )


def mask_summary(masks: DataFrame) -> DataFrame:
    """Per image: masks, their true pixel area and the area of their frames."""
    return masks.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("masks"),
        F.sum(run_area(F.col("runs"))).alias("pixel_area"),
        F.sum(F.col("height").cast("bigint") * F.col("width")).alias("frame_area"),
    )
