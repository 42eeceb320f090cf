"""Nearest-in-time pairing of message topics and topic statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.ranking import dense_ids


def nearest(
    left: DataFrame, right: DataFrame, keys: list[str], bucket_us: int, prefix: str
) -> DataFrame:
    """Add the nearest ``right`` message of the same key to every left row:
    ``<prefix>_idx, <prefix>_ts_us``; ties go to the lower index; null when there is none.

    Both tables carry the keys, ``ts_us`` and ``idx``. Time is cut into buckets. A left row looks at
    its own bucket with a running window, and beyond it at the last message of the closest earlier
    bucket and the first of the closest later one. So the cost is linear, no pairs are formed, and
    no key is handled by one task; the table that links buckets holds one row per bucket.
    """
    b = F.floor(F.col("ts_us") / bucket_us)
    lrow = left.withColumn("_b", b).withColumn("_is_left", F.lit(True))
    mark = F.struct("ts_us", (-F.col("idx")).alias("nidx"))
    head = F.struct("ts_us", "idx")
    r = right.select(*keys, "ts_us", "idx").withColumn("_b", b)

    ends = r.groupBy(*keys, "_b").agg(F.max(mark).alias("_last"), F.min(head).alias("_first"))
    slots = ends.join(left.withColumn("_b", b).select(*keys, "_b").distinct(), [*keys, "_b"], "full_outer")
    # Both ways are running frames: one that ends at the last row is computed anew for every row, in quadratic time.
    back = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(
        *keys, "_b",
        F.last("_last", ignorenulls=True).over(back).alias("_before"),
        F.last("_first", ignorenulls=True).over(ahead).alias("_after"),
    )
    both = lrow.withColumn("_m", F.lit(None).cast("struct<ts_us:bigint,nidx:bigint>")).withColumn(
        "_h", F.lit(None).cast("struct<ts_us:bigint,idx:bigint>")
    ).unionByName(
        r.select(*keys, "ts_us", "idx", "_b", F.lit(False).alias("_is_left"),
                 mark.alias("_m"), head.alias("_h")),
        allowMissingColumns=True,
    )
    inner = Window.partitionBy(*keys, "_b")
    # Range frames include every message of the same instant.
    upto = inner.orderBy("ts_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_ = inner.orderBy(F.desc("ts_us")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_p", F.max("_m").over(upto)).withColumn("_n", F.min("_h").over(from_))
    rows = seen.where("_is_left").join(slots, [*keys, "_b"], "left")
    prev, nxt = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    rows = rows.withColumns({"_prev": prev, "_next": nxt})
    dp = F.col("ts_us") - F.col("_prev.ts_us")
    dn = F.col("_next.ts_us") - F.col("ts_us")
    use_prev = F.col("_next").isNull() | (
        F.col("_prev").isNotNull()
        & ((dp < dn) | ((dp == dn) & (-F.col("_prev.nidx") <= F.col("_next.idx"))))
    )
    return rows.select(
        *left.columns,
        F.when(use_prev, -F.col("_prev.nidx")).otherwise(F.col("_next.idx")).alias(f"{prefix}_idx"),
        F.when(use_prev, F.col("_prev.ts_us")).otherwise(F.col("_next.ts_us")).alias(f"{prefix}_ts_us"),
    )


def _error_ms(prefix: str) -> Column:
    return F.abs(F.col("ts_us") - F.col(f"{prefix}_ts_us")) / 1000.0


def sync_frames(
    messages: DataFrame,
    cloud_topic: str,
    image_topic: str,
    info_topic: str | None = None,
    max_error_ms: float = 50.0,
    max_frames: int | None = None,
    bucket_us: int | None = None,
) -> DataFrame:
    """Every cloud message with its nearest image, kept within the tolerance.

    A camera-info message outside the tolerance is dropped, yet its distance still counts in
    ``sync_error_ms``. ``max_frames`` limits the clouds taken and the frames returned.
    """
    bucket_us = bucket_us or int(max(1.0, max_error_ms) * 64000)

    def topic(name: str) -> DataFrame:
        return messages.where(F.col("topic") == name).select("bag", "ts_us", "idx")

    clouds = topic(cloud_topic)
    if max_frames:
        w = Window.partitionBy("bag").orderBy("ts_us", "idx")
        clouds = clouds.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_frames)
        clouds = clouds.drop("_rn")
    out = nearest(clouds, topic(image_topic), ["bag"], bucket_us, "image")
    out = out.withColumn("_ie", _error_ms("image")).where(F.col("_ie") <= max_error_ms)
    if info_topic:
        out = nearest(out, topic(info_topic), ["bag"], bucket_us, "info")
        err = F.coalesce(_error_ms("info"), F.lit(0.0))
        near = err <= max_error_ms
        out = out.withColumn("sync_error_ms", F.greatest(F.col("_ie"), err)).withColumn(
            "info_idx", F.when(near, F.col("info_idx"))
        ).drop("info_ts_us")
    else:
        out = out.withColumn("sync_error_ms", F.col("_ie"))
    return out.drop("_ie").withColumnRenamed("idx", "cloud_idx")


def number_frames(frames: DataFrame) -> DataFrame:
    """Dense 0-based ``frame_index`` in bag and time order (of one bag when there is one)."""
    numbered = dense_ids(frames, [F.col("bag"), F.col("ts_us"), F.col("cloud_idx")], "_n")
    first = numbered.groupBy("bag").agg(F.min("_n").alias("_f"))
    return numbered.join(first, "bag").withColumn("frame_index", F.col("_n") - F.col("_f")).drop("_n", "_f")


def sync_error_avg(frames: DataFrame) -> DataFrame:
    return frames.groupBy("bag").agg(
        F.avg("sync_error_ms").alias("avg_sync_error_ms"), F.count(F.lit(1)).alias("frames")
    )


def topic_stats(messages: DataFrame) -> DataFrame:
    """Messages and rate per topic with the bag's start, end and duration in seconds."""
    per = messages.groupBy("bag", "topic").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min("ts_us").alias("_lo"), F.max("ts_us").alias("_hi"),
    )
    w = Window.partitionBy("bag")  # one row per topic
    lo, hi = F.min("_lo").over(w), F.max("_hi").over(w)
    dur = F.col("duration")
    rate = F.when(
        (F.col("message_count") > 1) & (dur > 0), F.try_divide(F.col("message_count"), dur)
    ).otherwise(F.lit(0.0))
    return (
        per.withColumns({"start_us": lo, "end_us": hi})
        .withColumn("duration", (F.col("end_us") - F.col("start_us")) / 1000000.0)
        .withColumn("frequency_hz", rate)
        .drop("_lo", "_hi")
    )


def pick_topic(messages: DataFrame, topics: list[str]) -> DataFrame:
    """The wanted topic with the most messages per bag; ties to the first name."""
    per = messages.where(F.col("topic").isin(topics)).groupBy("bag", "topic").agg(
        F.count(F.lit(1)).alias("n")
    )
    best = F.min(F.struct((-F.col("n")).alias("m"), "topic")).alias("b")
    return per.groupBy("bag").agg(best).select(
        "bag", F.col("b.topic").alias("topic"), (-F.col("b.m")).alias("message_count")
    )
