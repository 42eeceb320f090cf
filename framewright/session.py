"""Session helpers: a tuned session, durable materialization, shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "framewright", cores: str = "8", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's ``spark.checkpoint.dir``.

    Only a ``local`` master may go without: there a folder of the machine is made. On a cluster the
    executors would each write to their own disk, so a missing setting is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="framewright-")
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job through reliable storage.

    The rows go to the shared folder, so a lost executor costs a re-read, not a re-run of
    every earlier round.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes begun inside take their shuffle files away when they end, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("_PASSING", default=())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end: for work that is done when it returns, as a writer's."""
    paths: list[str] = []
    token = _PASSING.set((*_PASSING.get(), paths))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            remove(spark, path)


def stored(df: DataFrame, label: str, outlives: bool = False) -> DataFrame:
    """Write rows to the shared folder and read them back. Unlike ``materialize`` the result has a known size, so that Spark
    can tell a side that is small enough to broadcast. ``outlives`` is for what a block of ``passing`` hands on."""
    path = scratch_path(df.sparkSession, label)
    if lists := _PASSING.get()[: -1 if outlives else None]:
        lists[-1].append(path)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that is never sent to every task. Spark takes the size of a stored table for that of its rows, but sorted
    numbers are some forty times larger in the driver's memory than in a file."""
    return df.hint("merge")


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys of a following Python group function.

    The partition count is the session's, stated outright: small rows can mean long Python work,
    and adaptive coalescing only sees bytes. The grouping reuses this shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def finely(df: DataFrame, *keys: str, rows: int = 500_000, count: int | None = None) -> DataFrame:
    """Hash-partition by the keys of a following group or join into parts of about ``rows`` rows, at least as many as the session's.

    The count is stated outright, as the session's number is the same for any input and a sort or hash table holds what a task got.
    ``count`` is the number of rows if it is known.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-(df.count() if count is None else count) // rows)), *keys)
