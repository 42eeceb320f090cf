"""Exact ranks, running windows and quantiles that survive a hot key.

A plain ``row_number() OVER (PARTITION BY key)`` sends a whole key to one task. Here every key is
cut into buckets by a monotone function of the order, ranked inside (key, bucket), and shifted by
the number of rows in earlier buckets. Only the bucket counts are ever seen together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import materialize, stored


def _part(keys: Sequence[str]):
    # No key: the partition holds bucket counts only, never data rows.
    return Window.partitionBy(*(keys or [F.lit(0)]))


def _pinned(df: DataFrame) -> DataFrame:
    """Rows in reliable storage, as Parquet unless a column has no type."""
    return materialize(df) if any("void" in kind for _, kind in df.dtypes) else stored(df, "pinned")


def with_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based rank of each row inside ``keys`` by ``order``.

    ``bucket`` must not decrease along ``order`` and ``keys`` must not be null. ``total`` names
    an optional column with the number of rows of the key.
    """
    keys = list(keys)
    data = df.withColumn("_bucket", bucket)
    counts = data.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = _part(keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(_part(keys)).alias("_total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = data.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*keys, "_bucket"])
    ranked = ranked.withColumn(name, F.col("_offset") + F.col("_rn") - 1)
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_bucket", "_rn", "_offset", "_total")


def range_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank", total: str | None = None) -> DataFrame:
    """Add the 0-based rank of each row inside ``keys`` by ``order``, whatever the values look like.

    For orders without an even bucket function: rows are cut into ranges of keys and order, sorted there and pinned in reliable
    storage; each range is shifted by the rows of its key in the ranges before it. Rows that tie follow their place in the input, so
    that one hot value is cut too. ``keys`` must not be null.
    """
    keys = list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order, F.col("_tie")]
    ranges = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    pinned = _pinned(ranges.drop("_tie").withColumn("_mid", F.monotonically_increasing_id()))
    pinned = pinned.withColumn("_part", F.shiftright("_mid", 33))
    counts = pinned.groupBy(*keys, "_part").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(_part(keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    shifts = counts.select(
        *keys, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(_part(keys)).alias("_total")
    )
    ranked = pinned.join(shifts, [*keys, "_part"]).withColumn(name, F.col("_mid") + F.col("_shift"))
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_mid", "_part", "_shift", "_total")


def shuffle_key(id_col: Column | str, seed: int) -> Column:
    """Reproducible pseudo-random order key: the hex digest of id and seed."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))))


def with_shuffled_rank(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    seed: int,
    name: str = "rank",
    total: str | None = None,
    hex_digits: int = 3,
) -> DataFrame:
    """Rank in seeded random order; the digest's leading digits are even-sized buckets."""
    data = df.withColumn("_digest", shuffle_key(id_col, seed))
    bucket = F.substring("_digest", 1, hex_digits)
    return with_rank(data, keys, [F.col("_digest")], bucket, name, total).drop("_digest")


def chunked(df: DataFrame, rank: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut ranked rows into chunks of ``size`` rows and copy the border rows that a window
    reaching ``before`` rows back and ``after`` rows ahead needs.

    Adds ``_chunk`` and ``_own``; compute over (key, _chunk) and keep the ``_own`` rows.
    """
    r = F.col(rank)
    home = (r / size).cast("bigint")
    first = F.greatest(F.lit(0).cast("bigint"), ((r - after) / size).cast("bigint"))
    last = ((r + before) / size).cast("bigint")
    if before > size or after > size:
        raise ValueError("window is wider than a chunk")
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def dense_ids(df: DataFrame, order: Sequence[Column], name: str = "id", start: int = 0) -> DataFrame:
    """Consecutive ids in a global order without a single-partition window.

    Range-sorts, pins the partitions in reliable storage, and shifts each partition's local
    numbering by the rows before it. The driver sees one count per partition.
    """
    spark = df.sparkSession
    pinned = _pinned(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    sizes = (
        pinned.groupBy(part.alias("_part")).agg((F.max("_mid") % (1 << 33) + 1).alias("_n")).collect()
    )
    offset, shift = start, []
    for row in sorted(sizes, key=lambda r: r["_part"]):
        shift.append((int(row["_part"]), offset))
        offset += row["_n"]
    offsets = spark.createDataFrame(shift, "_part INT, _shift BIGINT")
    return (
        pinned.withColumn("_part", part.cast("int"))
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, F.col("_shift") + F.col("_mid") % (1 << 33))
        .drop("_mid", "_part", "_shift")
    )


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, name: str = "quantile", bins: int = 512
) -> DataFrame:
    """Linear-interpolated quantile per key (numpy's default rule), exact, without buffering a
    group: equal values collapse to counts, a histogram finds the bin of the wanted rank, and only
    that bin is ranked.
    """
    keys = list(keys)
    v = F.col("_v")
    freq = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    span = freq.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n")
    )
    step = (F.col("_hi") - F.col("_lo")) / bins
    binned = freq.join(span, keys).withColumn(
        "_bin",
        F.when(step > 0, F.least(F.floor((v - F.col("_lo")) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1)))
        .otherwise(F.lit(0))
        .cast("int"),
    )
    pos = (F.col("_n") - 1) * F.lit(float(q))
    hist = binned.groupBy(*keys, "_bin").agg(
        F.sum("_c").alias("_bc"), F.first("_n").alias("_n")
    )
    w = _part(keys).orderBy("_bin")  # at most `bins` rows per key
    hist = hist.withColumn("_end", F.sum("_bc").over(w)).withColumn(
        "_start", F.col("_end") - F.col("_bc")
    )
    wanted = hist.where(
        (F.col("_end") > F.floor(pos)) & (F.col("_start") <= F.ceil(pos))
    ).select(*keys, "_bin", "_start")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    picked = (
        binned.join(wanted, [*keys, "_bin"])
        .withColumn("_to", F.col("_start") + F.sum("_c").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_c"))
    )
    lo = F.min(F.when((F.col("_from") <= F.floor(pos)) & (F.col("_to") > F.floor(pos)), v))
    hi = F.min(F.when((F.col("_from") <= F.ceil(pos)) & (F.col("_to") > F.ceil(pos)), v))
    frac = F.first(pos - F.floor(pos))
    return picked.groupBy(*keys).agg(
        (lo + (hi - lo) * frac).alias(name), F.first("_n").alias("_n")
    ).drop("_n")
