"""Columns and joins that several training-data operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.session import scratch_path

#: A side is broadcast up to this many rows of a few numbers each (some 20 MB); more rows are shuffled.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain ``lower`` is the same on pure ASCII and much faster."""
    mapped = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(mapped)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a small or reused intermediate to the shared folder and read it back.

    A lost executor then costs a re-read, and a plan that uses the rows twice computes them once.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Hint a broadcast if the (stored or small) side has at most ``rows`` rows; tell whether it was hinted."""
    fits = df.count() <= rows
    return (F.broadcast(df), True) if fits else (df, False)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of columns of the same names on both sides; null equals null."""
    on = F.lit(True)
    for name in names:
        on = on & left[name].eqNullSafe(right[name])
    return on


def in_order(df: DataFrame, keys: list[str], order: list[Column], label: str) -> DataFrame:
    """Stored ``df`` with ``pos``, the place of a row (from 0) among those of its ``keys`` by ``order``, and ``n``, their number.

    Rows are cut into ranges of keys and order and sorted there; a range then only needs the counts of the ranges before
    it. ``keys`` must not be null. Rows that tie are told apart by their place in the input, so that a hot value is cut too.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order, F.col("_tie")]
    ranges = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = stored(ranges.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), label)
    part, at = F.shiftright("_at", 33), F.col("_at") % (1 << 33)
    rows = rows.withColumn("_part", part).withColumn("_at", at)
    counts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # a row for each range
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(*keys, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    side, _ = small_side(stored(shifts, f"{label}-shifts"))
    return rows.join(side, [*keys, "_part"]).withColumn("pos", F.col("_shift") + F.col("_at")).drop("_shift", "_at", "_part")


def whole_row(df: DataFrame) -> Column:
    """All columns as ``row``, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


class Forest:
    """Union-find over ids; ``add`` tells whether a link joins two parts."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if up in parent else up
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def thinned(edges: DataFrame, *keys: str) -> DataFrame:
    """``a, b``: links that connect what all links of a task connect, so never more than a task has nodes.

    ``keys`` say which links should meet in a task; a dense group should be cut into a few by a salt.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for batch in batches:
            kept = [(a, b) for a, b in zip(batch["a"].tolist(), batch["b"].tolist()) if forest.add(a, b)]
            yield pd.DataFrame(kept, columns=["a", "b"], dtype=np.int64)

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, *keys).mapInPandas(run, "a LONG, b LONG")
