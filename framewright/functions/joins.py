"""Pair joins that stay bounded when one group holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.boxes import iou
from framewright.session import materialize

CORNERS = ("x1", "y1", "x2", "y2")


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Keys with more than ``rows`` rows, found by a partial aggregate."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows)
        .select(*keys, F.lit(True).alias("_hot"))
    )


def flag_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(hot, list(keys), "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))


def tiled(left: DataFrame, right: DataFrame, on: Sequence[str], groups: DataFrame, keys: Sequence[str], tile: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with ``_tile`` for a join on ``on``: where more than ``tile`` left rows meet, they are dealt to tiles and the
    right rows are sent to each, so that no task forms all pairs of a crowd.

    ``groups`` has the ``keys`` with more than ``tile`` rows. Without any, nothing is added.
    """
    on = list(on)
    crowded = left.join(groups.select(*keys), list(keys), "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    crowded = materialize(crowded.where(F.col("_n") > tile).select(*on, F.ceil(F.col("_n") / tile).cast("int").alias("_tiles")))
    if crowded.isEmpty():
        return left, right, on
    tiles = F.coalesce("_tiles", F.lit(1))
    mine = F.pmod(F.xxhash64(*[c for c in left.columns if c not in on]), tiles).cast("int")
    left = left.join(crowded, on, "left").withColumn("_tile", mine).drop("_tiles")
    right = right.join(crowded, on, "left").withColumn("_tile", F.explode(F.sequence(F.lit(0), tiles - 1))).drop("_tiles")
    return left, right, [*on, "_tile"]


def iou_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    threshold: float,
    where: Callable[[Column, Column], Column] | None = None,
    hot_rows: int = 256,
    tile: int = 8192,
) -> DataFrame:
    """Pairs of boxes of the same key with an overlap ratio of at least ``threshold``.

    Result: the keys, structs ``l`` and ``r``, and ``iou``. Both inputs carry ``x1..y2``.

    Small groups meet in one cell. A group above ``hot_rows`` is cut into cells: an overlap ratio
    of t or more forces widths and heights within a factor t and centers within (1 - t) times the
    larger side, so a left box takes the one cell of its size class and center and a right box
    takes every cell it may reach. Each pair meets in exactly one cell, so nothing has to be
    de-duplicated and no pair is missed. A crowd in one cell, as of equal boxes, or at threshold 0 in one group, is
    joined in tiles of ``tile`` left boxes. To count a crowd's pairs instead of listing them see ``self_iou_counts``.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be between 0 and 1, got {threshold}")
    keys = list(keys)
    t = (threshold or 1.0) * (1 - 1e-9)
    reach_log = -math.log(t) + 1e-9
    cell_log = min(4 * reach_log, math.log(4.0))
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    every = left.select(*keys).unionByName(right.select(*keys))  # counted before the geometry
    left, right = left.where(solid), right.where(solid)
    split = threshold > 0  # at 0 every pair of a key is a result
    sides = (("w", "x1", "x2", "kx", "ix"), ("h", "y1", "y2", "ky", "iy"))
    cells = [c for s in sides for c in s[3:]]

    # Flat prefixed columns up to the join; the structs are put together above it.
    lcols, rcols = list(left.columns), list(right.columns)
    lrow = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in lcols])
    rrow = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in rcols])
    if split:
        hot = hot_keys(every, keys, hot_rows)
        lrow, rrow = flag_hot(lrow, hot, keys), flag_hot(rrow, hot, keys)
        for _, a, b, k, i in sides:
            size = F.col(f"l_{b}") - F.col(f"l_{a}")
            mid = (F.col(f"l_{a}") + F.col(f"l_{b}")) / 2
            kcol = F.when(F.col("_hot"), F.floor(F.ln(size) / cell_log)).otherwise(F.lit(0))
            lrow = lrow.withColumn(k, kcol.cast("bigint"))
            width = F.exp((F.col(k) + 1) * cell_log)
            icol = F.when(F.col("_hot"), F.floor(mid / width)).otherwise(F.lit(0))
            lrow = lrow.withColumn(i, icol.cast("bigint"))
        for _, a, b, k, i in sides:
            size = F.col(f"r_{b}") - F.col(f"r_{a}")
            mid = (F.col(f"r_{a}") + F.col(f"r_{b}")) / 2
            zero = F.array(F.lit(0).cast("bigint"))
            span = F.sequence(
                F.floor((F.ln(size) - reach_log) / cell_log).cast("bigint"),
                F.floor((F.ln(size) + reach_log) / cell_log).cast("bigint"),
            )
            rrow = rrow.withColumn(k, F.explode(F.when(F.col("_hot"), span).otherwise(zero)))
            width = F.exp((F.col(k) + 1) * cell_log)
            reach = F.greatest(size, F.least(width, size / t)) * (1 - t) * (1 + 1e-9)
            span = F.sequence(
                F.floor((mid - reach) / width).cast("bigint"),
                F.floor((mid + reach) / width).cast("bigint"),
            )
            rrow = rrow.withColumn(i, F.explode(F.when(F.col("_hot"), span).otherwise(zero)))
        lrow, rrow = lrow.drop("_hot"), rrow.drop("_hot")
        on = keys + cells
    else:
        on = keys
    large = materialize(hot_keys(every, keys, tile))
    if not large.isEmpty():
        lrow, rrow, on = tiled(lrow, rrow, on, large, keys, tile)
    pairs = lrow.join(rrow, on).select(
        *keys,
        F.struct(*[F.col(f"l_{c}").alias(c) for c in lcols]).alias("l"),
        F.struct(*[F.col(f"r_{c}").alias(c) for c in rcols]).alias("r"),
    )
    if where is not None:
        pairs = pairs.where(where(F.col("l"), F.col("r")))
    ratio = iou(
        tuple(F.col(f"l.{c}") for c in CORNERS), tuple(F.col(f"r.{c}") for c in CORNERS)
    )
    return (
        pairs.withColumn("iou", ratio).where(F.col("iou") >= threshold).select(*keys, "l", "r", "iou")
    )


def crowd_counts(xy: np.ndarray, threshold: float, by: np.ndarray | None = None, cells: int = 1 << 15) -> tuple[int, int, float | None]:
    """``self_iou_counts`` of the solid boxes of one key, given as rows ``x1, y1, x2, y2`` of finite numbers, at a
    threshold above 0: pairs, boxes and the largest ratio. Some ``cells`` pairs are formed at a time."""
    if by is not None:  # pairs agree in ``by``, so each of its values is a crowd of its own
        some = [crowd_counts(xy[by == v], threshold, None, cells) for v in np.unique(by)]
        tops = [top for _, _, top in some if top is not None]
        return sum(s[0] for s in some), sum(s[1] for s in some), max(tops, default=None)
    xy = xy[np.lexsort(xy.T)]
    starts = np.flatnonzero(np.r_[True, (xy[1:] != xy[:-1]).any(axis=1)])
    weight = np.diff(np.r_[starts, len(xy)])
    x1, y1, x2, y2 = xy[starts].T.copy()
    area, own = (x2 - x1) * (y2 - y1), weight * (weight - 1)
    twice, top = own.copy(), 1.0 if own.any() else 0.0
    step = max(1, cells // len(starts))
    for lo in range(0, len(starts), step):
        s = slice(lo, lo + step)
        ix = np.minimum(x2[s, None], x2)
        ix -= np.maximum(x1[s, None], x1)
        iy = np.minimum(y2[s, None], y2)
        iy -= np.maximum(y1[s, None], y1)
        inter = np.maximum(ix, 0.0, out=ix)
        inter *= np.maximum(iy, 0.0, out=iy)
        union = area[s, None] + area
        union -= inter
        with np.errstate(invalid="ignore", divide="ignore"):
            ratio = np.divide(inter, union, out=inter)
        one = np.arange(len(ratio))
        ratio[one, lo + one] = 0.0
        i, j = np.nonzero(ratio >= threshold)
        if len(i):
            np.add.at(twice, lo + i, weight[lo + i] * weight[j])
            top = max(top, float(ratio[i, j].max()))
    return int(twice.sum()) // 2, int(weight[twice > 0].sum()), top or None


def self_iou_join(
    boxes: DataFrame,
    keys: Sequence[str],
    index: str,
    threshold: float,
    where: Callable[[Column, Column], Column] | None = None,
    hot_rows: int = 256,
    tile: int = 8192,
) -> DataFrame:
    """Each unordered pair of a key once, the lower ``index`` on the left."""

    def ordered(l: Column, r: Column) -> Column:
        cond = l[index] < r[index]
        return cond & where(l, r) if where is not None else cond

    return iou_join(boxes, boxes, keys, threshold, ordered, hot_rows, tile)


def self_iou_counts(
    boxes: DataFrame, keys: Sequence[str], threshold: float, by: Sequence[str] = (), hot_rows: int = 256, tile: int = 8192
) -> DataFrame:
    """``pairs, max_iou, boxes`` per key: how many unordered pairs overlap by a ratio of at least ``threshold``, and how many boxes take part.

    Nothing is listed box by box: equal boxes of a key (and equal ``by`` columns; pairs must agree in these) become one with a weight,
    only different boxes are joined, and n equal boxes are n (n - 1) / 2 pairs of ratio 1. So 100,000 equal boxes are one row.
    Boxes without area overlap with nothing.
    """
    keys, by = list(keys), list(by)
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    plain = boxes.where(solid).select(*keys, *by, *[(F.col(c) + 0.0).alias(c) for c in CORNERS])
    classes = materialize(plain.groupBy(*keys, *by, *CORNERS).agg(F.count(F.lit(1)).alias("weight")).withColumn(
        "place", F.xxhash64(*by, *CORNERS)).withColumn("twin", F.hash(*by, *CORNERS)))

    def before(l: Column, r: Column) -> Column:
        mine, other = (F.struct(x["place"], x["twin"], *[x[c] for c in (*CORNERS, *by)]) for x in (l, r))
        return mine < other

    pairs = iou_join(classes, classes, [*keys, *by], threshold, before, hot_rows, tile)
    one = F.struct(F.col("l.weight").alias("mine"), *[F.col(f"l.{c}").alias(c) for c in CORNERS])
    two = F.struct(F.col("r.weight").alias("mine"), *[F.col(f"r.{c}").alias(c) for c in CORNERS])
    found = pairs.select(*keys, *by, (F.col("l.weight") * F.col("r.weight")).alias("n"), "iou", F.explode(F.array(one, two)).alias("box"))
    # Every pair came twice, once for each of its boxes.
    of_box = found.groupBy(*keys, *by, "box").agg(F.sum("n").alias("n"), F.max("iou").alias("iou"))
    mixed = of_box.select(*keys, *by, *[F.col(f"box.{c}").alias(c) for c in CORNERS], F.col("n").alias("twice"), "iou")
    own = F.col("weight") * (F.col("weight") - 1)
    all_ = classes.join(mixed, [*keys, *by, *CORNERS], "left").select(
        *keys, "weight", (F.coalesce("twice", F.lit(0)) + own).alias("twice"),
        F.greatest(F.col("iou"), F.when(own > 0, 1.0)).alias("iou"),
    ).where(F.col("twice") > 0)
    return all_.groupBy(*keys).agg(
        (F.sum("twice") / 2).cast("bigint").alias("pairs"), F.max("iou").alias("max_iou"), F.sum("weight").alias("boxes")
    )
