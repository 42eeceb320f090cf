"""Structured Streaming jobs. Row rules are those of the batch operators; event time is the time of
the message, and late rows beyond the watermark are dropped by Spark."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewright.functions.joins import iou_join, self_iou_join
from framewright.operators import qa
from framewright.operators.runs import RECENT
from framewright.session import materialize
from framewright.sinks.files import open_fs

# Least milliseconds between events of a type; others take the first.
DEFAULT_INTERVAL_MS = 100
RATE_LIMITS_MS = {"tool_progress": 100, "heartbeat": 30_000, "thinking": 500}


def run_available(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now, into Parquet below ``out``."""
    q = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{out}/_checkpoint").option("path", f"{out}/data")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def progress_latest(
    events: DataFrame, progress_type: str, width: str = "100 milliseconds", delay: str = "10 minutes"
) -> DataFrame:
    """Latest progress event per thread and window; every other event passes.

    ``events``: thread_id, ts TIMESTAMP, type, event_id, value.
    """
    timed = events.withWatermark("ts", delay)
    row = F.struct("ts", "event_id", "value")
    latest = (
        timed.where(F.col("type") == progress_type)
        .groupBy(F.window("ts", width), "thread_id", "type")
        .agg(F.max(row).alias("_r"))
        .select("thread_id", "type", "_r.event_id", "_r.value")
    )
    rest = timed.where(F.col("type") != progress_type).select("thread_id", "type", "event_id", "value")
    return latest.unionByName(rest)


def topic_rate(messages: DataFrame, width: str, slide: str, delay: str = "10 minutes") -> DataFrame:
    """Messages and messages per second of each topic in sliding windows."""
    n = F.count(F.lit(1))
    out = messages.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "topic").agg(
        n.alias("message_count")
    )
    secs = F.unix_micros("window.end") - F.unix_micros("window.start")
    return out.select(
        "topic", F.unix_micros("window.start").alias("start_us"), "message_count",
        (F.col("message_count") * 1_000_000 / secs).alias("frequency_hz"),
    )


def session_expiry(events: DataFrame, ttl: str, delay: str = "10 minutes") -> DataFrame:
    """Threads idle for ``ttl``: one row per closed stretch of activity."""
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", ttl), "thread_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("ts").alias("_last")
    )
    return s.select(
        "thread_id", F.unix_micros("session_window.start").alias("start_us"),
        F.unix_micros("_last").alias("last_us"), "events",
    )


def rate_limit(events: DataFrame, intervals_ms: dict[str, int] | None = None,
               default_ms: int = DEFAULT_INTERVAL_MS) -> DataFrame:
    """Events at least the type's interval after the last one let through, per thread and type.

    State is one number per key; a trigger's rows of a key are ordered by time first.
    """
    limits = RATE_LIMITS_MS if intervals_ms is None else intervals_ms

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gap = limits.get(key[1], default_ms) * 1000
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
        keep = []
        for ts in rows["ts_us"].tolist():
            ok = last is None or ts - last >= gap
            keep.append(ok)
            last = ts if ok else last
        state.update((int(last),))
        yield rows.loc[keep, ["thread_id", "type", "event_id", "ts_us"]]

    slim = events.select("thread_id", "type", "event_id", "ts_us")
    return slim.groupBy("thread_id", "type").applyInPandasWithState(
        step, "thread_id BIGINT, type STRING, event_id BIGINT, ts_us BIGINT", "last_us BIGINT",
        "append", GroupStateTimeout.NoTimeout,
    )


def quality(steps: DataFrame) -> DataFrame:
    """Recent error rate, recent and overall confidence after each step of a run; state is the last
    five results and two running totals."""

    def mean(xs: list[float | None]) -> float | None:
        have = [x for x in xs if x is not None]
        return sum(have) / len(have) if have else None

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, confs, total, count = state.get if state.exists else ([], [], 0.0, 0)
        errors, confs = list(errors), list(confs)
        rows = pd.concat(list(batches)).sort_values("step_key")
        out = []
        for k, err, conf in zip(rows["step_key"].tolist(), rows["error"].tolist(), rows["confidence"].tolist()):
            conf = None if conf is None or conf != conf else float(conf)
            errors = [*errors, bool(err)][-RECENT:]
            confs = [*confs, conf][-RECENT:]
            if conf is not None:
                total, count = total + conf, count + 1
            out.append((key[0], k, sum(errors) / len(errors), mean(confs), total / count if count else None))
        state.update((errors, confs, total, count))
        yield pd.DataFrame(out, columns=[
            "run_id", "step_key", "recent_error_rate", "recent_confidence", "overall_confidence"])

    slim = steps.select("run_id", "step_key", "error", "confidence")
    return slim.groupBy("run_id").applyInPandasWithState(
        step,
        "run_id BIGINT, step_key BIGINT, recent_error_rate DOUBLE, recent_confidence DOUBLE, "
        "overall_confidence DOUBLE",
        "errors ARRAY<BOOLEAN>, confs ARRAY<DOUBLE>, total DOUBLE, count BIGINT",
        "append", GroupStateTimeout.NoTimeout,
    )


def sync(clouds: DataFrame, images: DataFrame, tolerance_us: int, delay: str = "10 minutes",
         width: str = "10 minutes") -> DataFrame:
    """Nearest image of each cloud message within the tolerance: an interval join of two
    watermarked streams, then the closest per cloud message. Both carry ``ts, ts_us, idx``."""
    # A time slot is the equality key, so one bag spreads over tasks; images take every slot in reach.
    slot = 8 * tolerance_us
    tol = F.expr(f"make_dt_interval(0, 0, 0, {tolerance_us / 1e6:.6f})")
    c = clouds.select(F.col("ts").alias("c_ts"), F.col("ts_us").alias("c_us"), F.col("idx").alias("cloud_idx"))
    i = images.select(F.col("ts").alias("i_ts"), F.col("ts_us").alias("i_us"), F.col("idx").alias("image_idx"))
    c = c.withColumn("c_slot", F.floor(F.col("c_us") / slot)).withWatermark("c_ts", delay)
    reach = F.sequence(F.floor((F.col("i_us") - tolerance_us) / slot), F.floor((F.col("i_us") + tolerance_us) / slot))
    i = i.withColumn("i_slot", F.explode(reach)).withWatermark("i_ts", delay)
    near = (F.col("i_ts") >= F.col("c_ts") - tol) & (F.col("i_ts") <= F.col("c_ts") + tol)
    gap = F.abs(F.col("i_us") - F.col("c_us"))
    return (
        c.join(i, (F.col("c_slot") == F.col("i_slot")) & near)
        .groupBy(F.window("c_ts", width), "cloud_idx")
        .agg(F.min(F.struct(gap.alias("gap"), "image_idx")).alias("_m"))
        .select("cloud_idx", F.col("_m.image_idx").alias("image_idx"), (F.col("_m.gap") / 1000.0).alias("error_ms"))
    )


class MergeLog:
    """Reduced batches under a folder, merged in levels like a binary counter of base ``fan``.

    A small file, replaced as a whole, names the live parts. A trigger writes its part aside and then names it; when ``fan`` parts of a
    level are live, they are merged into one of the next level in the same step. So n triggers leave at most ``fan - 1`` parts a level on
    log(n) levels, each row is rewritten once a level, and what a failed trigger left behind is not named and not read.
    """

    def __init__(self, spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame], fan: int = 8) -> None:
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self.spark, self.root, self.merge, self.fan = spark, root.rstrip("/"), merge, fan
        self.fs, self.base = open_fs(self.root)

    def manifest(self) -> dict:
        path = f"{self.base}/manifest.json"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            return {"last": -1, "parts": []}
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _name(self, manifest: dict) -> None:
        self.fs.create_dir(self.base, recursive=True)
        aside = f"{self.base}/.manifest-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(manifest).encode())
        self.fs.move(aside, f"{self.base}/manifest.json")

    def _write(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def add(self, rows: DataFrame, number: int) -> None:
        """Take the rows of a trigger, once: a trigger that is repeated after it was named changes nothing."""
        log = self.manifest()
        if number <= log["last"]:
            return
        parts = [*log["parts"], [0, self._write(self.merge(rows))]]
        made, level = {name for _, name in parts}, 0
        while len(same := [p for p in parts if p[0] == level]) >= self.fan:
            whole = self.merge(self.spark.read.parquet(*[f"{self.root}/{name}" for _, name in same]))
            parts = [[level + 1, self._write(whole)], *[p for p in parts if p[0] != level]]
            made.add(parts[0][1])
            level += 1
        self._name({"last": number, "parts": parts})
        for name in made - {name for _, name in parts}:  # merged, and no longer named
            self.fs.delete_dir(f"{self.base}/{name}")

    def read(self) -> DataFrame | None:
        parts = self.manifest()["parts"]
        return self.merge(self.spark.read.parquet(*[f"{self.root}/{name}" for _, name in parts])) if parts else None


def review_state(edits: DataFrame, out: str, fan: int = 8) -> DataFrame:
    """Latest status per item from a stream of edits.

    Each trigger reduces its edits to one row per item and adds them to a ``MergeLog``; the reader merges its few parts, latest wins.
    """
    at = F.struct("ts", "edit_id")
    new = F.when(F.col("annotations_edited"), "modified").otherwise(F.col("status"))
    spark = edits.sparkSession
    log = MergeLog(spark, f"{out}/data", lambda rows: rows.groupBy("item_id").agg(F.max("last").alias("last")), fan)

    def save(batch: DataFrame, number: int) -> None:
        known = batch.where(F.col("annotations_edited") | F.col("status").isNotNull())
        log.add(known.select("item_id", F.struct(at.alias("at"), new.alias("status")).alias("last")), number)

    q = (
        edits.writeStream.foreachBatch(save).option("checkpointLocation", f"{out}/_checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = log.read()
    if rows is None:
        kind = edits.schema
        return spark.createDataFrame([], T.StructType([kind["item_id"], kind["status"], kind["ts"]]))
    return rows.select("item_id", F.col("last.status").alias("status"), F.col("last.at.ts").alias("ts"))


def new_label_checks(labels: DataFrame) -> DataFrame:
    """Box checks on arriving labels; needs no state."""
    return qa.row_checks(labels)


def new_label_pairs(labels: DataFrame, out: str, threshold: float = qa.IOU, buckets: int = 64) -> DataFrame:
    """Overlap and duplicate checks of arriving labels among each other and against those of all earlier triggers.

    Arrived boxes are kept in buckets of their sample; a trigger reads the buckets that its own samples fall in and joins its
    boxes with theirs, so a pair is found once, by the trigger that completes it. Boxes and issues of a trigger lie under its number
    and are written again after a failure.
    """
    spark = labels.sparkSession
    both = min(threshold, qa.DUPLICATE_IOU)
    kept = ["sample_id", "label_index", "class_id", "class_name", "x1", "y1", "x2", "y2"]
    store, issues = f"{out}/boxes", f"{out}/data"
    kinds = labels.select("sample_id", "label_index", "class_id", "class_name").schema
    schema = T.StructType([*kinds, *[T.StructField(c, T.DoubleType()) for c in kept[4:]], T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def save(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64("sample_id"), F.lit(buckets)).cast("int")
        new = materialize(qa.with_corners(batch).select(*kept, bucket.alias("bucket")))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        pairs = self_iou_join(new, ["sample_id"], "label_index", both).select("sample_id", "l", "r", "iou")
        if number and touched:
            old = spark.read.schema(schema).parquet(store).where(F.col("bucket").isin(touched) & (F.col("batch") < number))
            met = iou_join(new, old.select(*kept, "bucket"), ["sample_id"], both).select("sample_id", "l", "r", "iou")
            turned = F.col("l.label_index") > F.col("r.label_index")
            one, two = (F.when(turned, F.col(a)).otherwise(F.col(b)) for a, b in (("r", "l"), ("l", "r")))
            pairs = pairs.unionByName(met.select("sample_id", one.alias("l"), two.alias("r"), "iou"))
        qa.pair_issues(pairs, threshold).write.mode("overwrite").parquet(f"{issues}/batch={number}")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")

    q = (
        labels.writeStream.foreachBatch(save).option("checkpointLocation", f"{out}/_checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(issues).drop("batch")


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A growing folder of Parquet files as a stream; ``name`` is a file pattern in it."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)
