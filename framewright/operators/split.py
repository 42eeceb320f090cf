"""Reproducible splits and folds. Order comes from a digest of id and seed, so the same rows get
the same split on any cluster; counts follow the largest-remainder rule."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.model import Dataset
from framewright.operators.ranking import with_shuffled_rank


def normalize_ratios(ratios: Mapping[str, float]) -> dict[str, float]:
    clean = {str(k).strip(): float(v) for k, v in ratios.items()}
    if not clean or not all(clean) or min(clean.values()) < 0 or sum(clean.values()) <= 0:
        raise ValueError("ratios need names and non-negative values with a positive sum")
    total = sum(clean.values())
    return {k: v / total for k, v in clean.items()}


def _largest_remainder(total: Column, ratios: Mapping[str, float]) -> list[Column]:
    """Rows per split, as columns over the group's row count."""
    want = [total * F.lit(r) for r in ratios.values()]
    base = [F.floor(e) for e in want]
    left = total
    for b in base:
        left = left - b
    frac = [e - b for e, b in zip(want, base)]
    counts = []
    for i, f in enumerate(frac):
        ahead = F.lit(0)
        for j, g in enumerate(frac):
            if j != i:
                beats = (g >= f) if j < i else (g > f)
                ahead = ahead + beats.cast("int")
        counts.append(base[i] + (ahead < left).cast("bigint"))
    return counts


def _floor_then_rest(total: Column, ratios: Mapping[str, float]) -> list[Column]:
    counts = [F.floor(total * F.lit(r)) for r in list(ratios.values())[:-1]]
    rest = total
    for c in counts:
        rest = rest - c
    return [*counts, rest]


def _cut(rank: Column, counts: list[Column], names: list[str]) -> Column:
    out, end = F.lit(names[-1]), F.lit(0).cast("bigint")
    ends = []
    for c in counts:
        end = end + c
        ends.append(end)
    for name, e in reversed(list(zip(names[:-1], ends[:-1]))):
        out = F.when(rank < e, name).otherwise(out)
    return out


def split_random(
    samples: DataFrame, ratios: Mapping[str, float], seed: int = 0, rule: str = "remainder"
) -> DataFrame:
    """Add ``assigned``. ``rule='floor'`` rounds every split but the last down."""
    ratios = normalize_ratios(ratios)
    alloc = _largest_remainder if rule == "remainder" else _floor_then_rest
    ranked = with_shuffled_rank(samples, [], "sample_id", seed, "_rank", "_n")
    return ranked.withColumn(
        "assigned", _cut(F.col("_rank"), alloc(F.col("_n"), ratios), list(ratios))
    ).drop("_rank", "_n")


def primary_class(ds: Dataset) -> DataFrame:
    """``sample_id, stratum``: the class of a sample's first label."""
    first = F.min_by(F.struct("class_name", "class_id"), "label_index")
    per = ds.labels.groupBy("sample_id").agg(first.alias("_l"))
    name = F.trim("_l.class_name")
    stratum = (
        F.when(F.col("_l").isNull(), "__unlabeled__")
        .when(name != "", name)
        .otherwise(F.concat(F.lit("__class_"), F.col("_l.class_id"), F.lit("__")))
    )
    return ds.samples.select("sample_id").join(per, "sample_id", "left").select(
        "sample_id", stratum.alias("stratum")
    )


def split_stratified(ds: Dataset, ratios: Mapping[str, float], seed: int = 0) -> DataFrame:
    """Samples with ``stratum`` and ``assigned``; the ratios hold inside every stratum."""
    ratios = normalize_ratios(ratios)
    ranked = with_shuffled_rank(primary_class(ds), ["stratum"], "sample_id", seed, "_rank", "_n")
    counts = _largest_remainder(F.col("_n"), ratios)
    return ranked.select(
        "sample_id", "stratum", _cut(F.col("_rank"), counts, list(ratios)).alias("assigned")
    )


def kfold(samples: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """Add ``fold`` (0..k-1); the first n mod k folds hold one sample more. A fold's training
    part is every row of another fold."""
    if k < 2:
        raise ValueError(f"k must be >= 2, got {k}")
    ranked = with_shuffled_rank(samples, [], "sample_id", seed, "_rank", "_n")
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    edge = more * (size + 1)
    fold = F.when(F.col("_rank") < edge, F.floor(F.try_divide(F.col("_rank"), size + 1))).otherwise(
        more + F.floor(F.try_divide(F.col("_rank") - edge, size))
    )
    return ranked.withColumn("fold", fold.cast("int")).drop("_rank", "_n")


def split_by_metadata(samples: DataFrame, default: str = "train") -> DataFrame:
    named = F.nullif(F.trim("split"), F.lit(""))
    return samples.withColumn("assigned", F.coalesce(named, F.lit(default)))


def split_report(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Per split and class: samples, labels, share of all samples, labels of the class."""
    slim = assigned.select("sample_id", "assigned")
    sizes = slim.groupBy("assigned").agg(F.count(F.lit(1)).alias("sample_count"))
    per = (
        labels.groupBy("sample_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
        .join(slim, "sample_id")
        .groupBy("assigned", "class_name")
        .agg(F.sum("n").alias("class_labels"))
    )
    from pyspark.sql import Window  # splits x classes rows only

    share = F.col("sample_count") / F.sum("sample_count").over(Window.partitionBy(F.lit(0)))
    sizes = sizes.withColumn("actual_ratio", share)
    return (
        sizes.join(per, "assigned", "left")
        .withColumn(
            "label_count",
            F.coalesce(F.sum("class_labels").over(Window.partitionBy("assigned")), F.lit(0)),
        )
    )
