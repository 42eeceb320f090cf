"""Job runs: quality figures, checkpoint triggers, thread bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.ranking import chunked, with_rank

# Trigger rules.
CRITICAL_TOOLS = ("anonymize", "segment", "detect_3d")
MILESTONES = (0.10, 0.25, 0.50)
ERROR_RATE, CONFIDENCE_DROP, RECENT = 0.05, 0.15, 5


def quality_metrics(steps: DataFrame) -> DataFrame:
    """Per run: mean confidence, errors, items processed (a step without a count and without an
    error counts as one) and items per second."""
    items = F.coalesce(F.col("files_processed"), F.when(F.col("error"), 0).otherwise(1))
    per = steps.groupBy("run_id").agg(
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
        F.count_if("error").alias("error_count"),
        F.sum(items).alias("total_processed"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("_secs"),
    )
    speed = F.when(F.col("_secs") > 0, F.try_divide(F.col("total_processed"), F.col("_secs")))
    return per.withColumn("processing_speed", F.coalesce(speed, F.lit(0.0))).drop("_secs")


def run_summary(steps: DataFrame) -> DataFrame:
    """Per run: steps by status, success rate, duration, counts of results without an error and
    the mean confidence (null when there is none)."""
    fine = ~F.col("error")

    def total(tool: str | None = None) -> Column:
        cond = fine if tool is None else fine & (F.col("tool") == tool)
        return F.coalesce(F.sum(F.when(cond, F.col("files_processed"))), F.lit(0))

    return steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.count_if(fine).alias("completed_steps"),
        F.count_if("error").alias("failed_steps"),
        (F.count_if(fine) / F.count(F.lit(1))).alias("success_rate"),
        F.sum("duration").alias("total_duration"),
        total().alias("files_processed"),
        total("detect").alias("items_detected"),
        total("anonymize").alias("items_anonymized"),
        total("segment").alias("masks_generated"),
        F.avg("confidence").alias("average_confidence"),
    )


def with_history(
    steps: DataFrame, order: str = "step_key", bucket: int = 4096, chunk: int = 20_000
) -> DataFrame:
    """Add, per step: ``step`` (1-based), ``total_steps``, ``recent_error_rate`` and
    ``recent_confidence`` of the last five results, ``overall_confidence`` of all so far.

    A run is ranked and cut into chunks with a border of four rows, so a run of any length spreads
    over tasks; running averages start from the totals of earlier chunks.
    """
    ranked = with_rank(
        steps, ["run_id"], [F.col(order)], F.floor(F.col(order) / bucket), "_rank", "total_steps"
    )
    home = F.floor(F.col("_rank") / chunk).cast("bigint").alias("_chunk")
    sums = ranked.groupBy("run_id", home).agg(
        F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("_s"), F.count("confidence").alias("_c")
    )
    earlier = Window.partitionBy("run_id").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )  # one row per chunk
    base = sums.select(
        "run_id", "_chunk",
        F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"),
    )
    rows = chunked(ranked, "_rank", chunk, before=RECENT - 1).join(base, ["run_id", "_chunk"])
    inside = Window.partitionBy("run_id", "_chunk").orderBy("_rank")
    last = inside.rowsBetween(1 - RECENT, 0)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("_own"), F.col("confidence"))  # border rows belong to earlier totals
    total = F.col("_s0") + F.coalesce(F.sum(own).over(so_far), F.lit(0.0))
    count = F.col("_c0") + F.count(own).over(so_far)
    return (
        rows.withColumns(
            {
                "step": F.col("_rank") + 1,
                "recent_error_rate": F.avg(F.col("error").cast("int")).over(last),
                "recent_confidence": F.avg("confidence").over(last),
                "overall_confidence": F.when(count > 0, F.try_divide(total, count)),
            }
        )
        .where("_own")
        .drop("_own", "_chunk", "_rank", "_s0", "_c0")
    )


def crosses_milestone(step: Column, total: Column) -> Column:
    """Whether progress passes 10, 25 or 50 percent at this step."""
    hit = F.lit(False)
    for m in MILESTONES:
        hit = hit | (((step - 1) / total < m) & (step / total >= m))
    return hit


def _fresh_milestone(step: Column, total: Column, earlier: Column) -> Column:
    """A milestone counts only when its own step number was not checkpointed already;
    ``earlier`` tells that for the step before this one."""
    hit = F.lit(False)
    for m in MILESTONES:
        crossed = ((step - 1) / total < m) & (step / total >= m)
        taken = earlier & (F.floor(total * m) == step - 1)
        hit = hit | (crossed & ~taken)
    return hit


def triggers(
    history: DataFrame, checkpoints: DataFrame | None = None, critical: tuple[str, ...] = CRITICAL_TOOLS
) -> DataFrame:
    """Trigger of each step by priority: critical tool, error rate, confidence drop, milestone.

    ``checkpoints`` (run_id, step) are those taken before; their steps trigger nothing.
    """
    rows = history
    if checkpoints is not None:
        cp = checkpoints.select("run_id", "step").distinct()
        rows = rows.join(cp.withColumn("_done", F.lit(True)), ["run_id", "step"], "left").join(
            cp.select("run_id", (F.col("step") + 1).alias("step"), F.lit(True).alias("_before")),
            ["run_id", "step"], "left",
        )
    else:
        rows = rows.withColumns({"_done": F.lit(None).cast("boolean"), "_before": F.lit(None).cast("boolean")})
    drop = F.col("overall_confidence") - F.col("recent_confidence")
    kind = (
        F.when(F.col("_done"), None)
        .when(F.col("tool").isin(list(critical)), "critical_step")
        .when(F.col("recent_error_rate") > ERROR_RATE, "error_rate")
        .when(drop > CONFIDENCE_DROP, "quality_drop")
        .when(
            _fresh_milestone(F.col("step"), F.col("total_steps"), F.coalesce("_before", F.lit(False))),
            "percentage",
        )
    )
    return rows.withColumn("trigger", kind).drop("_done", "_before")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    rest = [c for c in snapshots.columns if c != "thread_id"]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "snapshot_id")).alias("_s")
    return snapshots.groupBy("thread_id").agg(newest).select("thread_id", "_s.*")


def thread_stats(threads: DataFrame, snapshots: DataFrame) -> DataFrame:
    one = F.lit(1).alias("_one")
    per = threads.agg(
        F.count(F.lit(1)).alias("total_threads"),
        *[
            F.count_if(F.col("status") == s).alias(f"{s}_threads")
            for s in ("active", "completed", "cancelled")
        ],
    )
    snaps = snapshots.agg(F.count(F.lit(1)).alias("total_snapshots"))
    return per.select("*", one).join(snaps.select("*", one), "_one").drop("_one")


def list_threads(threads: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    rows = threads.where(F.col("status") == status) if status else threads
    return rows.orderBy(F.desc("updated_at"), "thread_id").limit(limit)


def thread_progress(steps: DataFrame) -> DataFrame:
    """Per run: all, completed and failed steps and percent done."""
    done = F.count_if(~F.col("error"))
    total = F.count(F.lit(1))
    return steps.groupBy("run_id").agg(
        total.alias("total_steps"), done.alias("completed_steps"),
        F.count_if("error").alias("failed_steps"), (done / total * 100).alias("progress_percent"),
    )


def resume_status(awaiting: Column, failed: Column, current: Column, total: Column) -> Column:
    return (
        F.when(awaiting, "awaiting review")
        .when(failed > 0, "failed")
        .when((total > 0) & (current >= total), "completed")
        .when(total > 0, "in progress")
        .otherwise("ready")
    )


def retention(threads: DataFrame, cutoff: Column, *children: DataFrame) -> tuple[DataFrame, ...]:
    """Threads and child tables without finished threads older than ``cutoff``."""
    old = threads.where(
        F.col("status").isin("completed", "cancelled") & (F.col("updated_at") < cutoff)
    ).select("thread_id")
    return tuple(t.join(old, "thread_id", "left_anti") for t in (threads, *children))


def chain(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, token: str) -> DataFrame:
    """``prev`` and ``next`` token inside ``keys``, empty at the ends, with chunked windows."""
    ranked = with_rank(df, keys, order, bucket, "_rank")
    rows = chunked(ranked, "_rank", 50_000, before=1, after=1)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_rank")
    return (
        rows.withColumn("prev", F.coalesce(F.lag(token).over(w), F.lit("")))
        .withColumn("next", F.coalesce(F.lead(token).over(w), F.lit("")))
        .where("_own")
        .drop("_own", "_chunk", "_rank")
    )
