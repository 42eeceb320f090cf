"""Camera-lidar fusion: box matching, frustum queries and lifted boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.joins import iou_join
from framewright.operators.ranking import exact_quantile
from framewright.session import shuffled, spread_by, stored

# Smallest lifted box, spread factor, confidence of lifted boxes.
LIFT_MIN, LIFT_PAD, LIFT_CONF, LIFT_POINTS = 0.5, 1.1, 0.5, 3


def candidates(
    boxes2d: DataFrame, boxes3d: DataFrame, threshold: float = 0.3, same_class: bool = False
) -> DataFrame:
    """Pairs ``frame_id, i, j, iou`` of 2D boxes (key ``i``) and projected 3D boxes (key ``j``),
    both with pixel corners ``x1..y2``. The class test ignores case."""
    keys = ["frame_id"]
    cols = ["x1", "y1", "x2", "y2"]
    a, b = boxes2d, boxes3d  # boxes that are not visible have null corners and match nothing
    if same_class:
        keys.append("_cls")
        a, b = (d.withColumn("_cls", F.lower("class_name")) for d in (a, b))
    pairs = iou_join(a.select(*keys, "i", *cols), b.select(*keys, "j", *cols), keys, threshold)
    return pairs.select("frame_id", F.col("l.i").alias("i"), F.col("r.j").alias("j"), "iou")


def _match_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by (frame, falling overlap, i, j); a frame may go on in the next batch."""
    frame, used_i, used_j = None, set(), set()
    for batch in batches:
        keep = []
        for f, i, j in zip(batch["frame_id"], batch["i"], batch["j"]):
            if f != frame:
                frame, used_i, used_j = f, set(), set()
            keep.append(i not in used_i and j not in used_j)
            if keep[-1]:
                used_i.add(i), used_j.add(j)
        yield batch[np.array(keep, dtype=bool)]


def greedy_match(pairs: DataFrame, gather: int = 20_000) -> DataFrame:
    """One-to-one pairs by falling overlap, ties by ``(i, j)``, inside each frame.

    Frames of up to ``gather`` pairs are walked by one task each. In larger ones the sorted list picks
    exactly the pairs that are best for both ends once earlier picks are gone, so every round takes all
    mutual best pairs at once; the rounds needed are the longest chain of dependent picks.
    """
    pairs = shuffled(stored(pairs.select("frame_id", "i", "j", "iou"), "match-pairs"))
    large = pairs.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > gather).select("frame_id")
    large = stored(large, "match-large")
    small = spread_by(pairs.join(large, "frame_id", "left_anti"), "frame_id")
    small = small.sortWithinPartitions("frame_id", F.desc("iou"), "i", "j")
    done = small.mapInPandas(_match_frames, pairs.schema)
    if large.isEmpty():
        return done
    left = shuffled(stored(pairs.join(large, "frame_id", "left_semi"), "match-left"))
    # Smallest (-iou, i, j) is first in the sorted list.
    order = F.struct((-F.col("iou")).alias("s"), "i", "j")
    while True:
        best_i = left.groupBy("frame_id", "i").agg(F.min(order).alias("best"))
        best_j = left.groupBy("frame_id", "j").agg(F.min(order).alias("best"))
        picked = best_i.select("frame_id", "best.*").join(
            best_j.select("frame_id", "best.*"), ["frame_id", "s", "i", "j"], "left_semi"
        )
        picked = shuffled(stored(picked.select("frame_id", "i", "j", (-F.col("s")).alias("iou")), "match-picked"))
        done = done.unionByName(picked)
        left = shuffled(stored(
            left.join(picked.select("frame_id", "i"), ["frame_id", "i"], "left_anti").join(
                picked.select("frame_id", "j"), ["frame_id", "j"], "left_anti"
            ), "match-left"
        ))
        if left.limit(1).count() == 0:
            return done


def fuse(
    boxes2d: DataFrame,
    boxes3d: DataFrame,
    threshold: float = 0.3,
    same_class: bool = False,
) -> DataFrame:
    """Matched pairs, then unmatched 2D boxes, then unmatched visible 3D boxes.

    ``boxes2d``: frame_id, i, class_id, class_name, confidence, x1..y2 (pixels).
    ``boxes3d``: frame_id, j, class_id, class_name, confidence, depth, x1..y2 (projected).
    A 3D-only row takes its truncated pixel box, and its own confidence for both.
    """
    matched = greedy_match(candidates(boxes2d, boxes3d, threshold, same_class))
    two = boxes2d.join(matched, ["frame_id", "i"], "left")
    three = boxes3d.select(
        "frame_id", "j", F.col("confidence").alias("confidence_3d"), F.col("depth")
    )
    with_2d = two.join(three, ["frame_id", "j"], "left").select(
        "frame_id", "i", "j", "class_id", "class_name",
        F.col("confidence").alias("confidence_2d"), "confidence_3d", "iou", "depth",
        "x1", "y1", "x2", "y2",
    )
    only_3d = (
        boxes3d.where(F.col("x1").isNotNull())
        .join(matched.select("frame_id", "j"), ["frame_id", "j"], "left_anti")
        .select(
            "frame_id", F.lit(None).cast("bigint").alias("i"), "j", "class_id", "class_name",
            F.col("confidence").alias("confidence_2d"), F.col("confidence").alias("confidence_3d"),
            F.lit(None).cast("double").alias("iou"), "depth",
            *[F.col(c).cast("int").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")],
        )
    )
    return with_2d.unionByName(only_3d)


def fusion_summary(fused: DataFrame) -> DataFrame:
    return fused.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("j").isNotNull()).alias("with_3d"),
        F.count_if(F.col("j").isNull()).alias("only_2d"),
    )


def frustum_points(
    projected: DataFrame, boxes: DataFrame, cell: float = 64.0, margin: float = 1.0
) -> DataFrame:
    """Pairs of boxes and the valid projected points inside them (edges included).

    ``projected``: frame_id, u, v, valid and point columns; ``boxes``: frame_id, box_id, x1..y2.
    Points take one pixel cell, boxes the cells they cover, so the join key is frame and cell.
    """
    b = boxes.select("frame_id", "box_id", "x1", "y1", "x2", "y2")
    if margin != 1.0:
        mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
        hw = (F.col("x2") - F.col("x1")) / 2 * margin
        hh = (F.col("y2") - F.col("y1")) / 2 * margin
        b = b.select(
            "frame_id", "box_id", (mx - hw).alias("x1"), (my - hh).alias("y1"),
            (mx + hw).alias("x2"), (my + hh).alias("y2"),
        )

    def span(low: str, high: str) -> Column:
        return F.explode(
            F.sequence(F.floor(F.col(low) / cell).cast("int"), F.floor(F.col(high) / cell).cast("int"))
        )

    b = b.withColumn("_cu", span("x1", "x2")).withColumn("_cv", span("y1", "y2"))
    p = (
        projected.where("valid")
        .withColumn("_cu", F.floor(F.col("u") / cell).cast("int"))
        .withColumn("_cv", F.floor(F.col("v") / cell).cast("int"))
    )
    inside = F.col("u").between(F.col("x1"), F.col("x2")) & F.col("v").between(
        F.col("y1"), F.col("y2")
    )
    return p.join(b, ["frame_id", "_cu", "_cv"]).where(inside).drop("_cu", "_cv", "x1", "y1", "x2", "y2")


def lift_boxes(
    inside: DataFrame, boxes: DataFrame, priors: DataFrame | None = None,
    min_points: int = LIFT_POINTS,
) -> DataFrame:
    """3D boxes from the points in each 2D box: median center, size from the class prior
    (``class_name, l, w, h``) or the padded spread, yaw along the main direction in the plane.

    Boxes with fewer than ``min_points`` give no row.
    """
    keys = ["frame_id", "box_id"]
    n = F.count(F.lit(1)).alias("point_count")
    spread = [(F.max(c) - F.min(c)).alias(f"r{c}") for c in ("x", "y", "z")]
    spin = [
        F.var_pop("x").alias("_xx"), F.var_pop("y").alias("_yy"), F.covar_pop("x", "y").alias("_xy")
    ]
    base = inside.groupBy(*keys).agg(n, *spread, *spin).where(F.col("point_count") >= min_points)
    # All three medians in one pass over (axis, value) rows.
    axes = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("value")) for c in "xyz"])
    long = inside.select(*keys, F.explode(axes).alias("_a")).select(*keys, "_a.axis", "_a.value")
    med = exact_quantile(long, [*keys, "axis"], "value", 0.5, "m")
    center = med.groupBy(*keys).agg(
        *[F.max(F.when(F.col("axis") == c, F.col("m"))).alias(c) for c in "xyz"]
    )
    out = base.join(center, keys).join(boxes.select(*keys, "class_name"), keys)
    dims = {
        s: F.greatest(F.lit(LIFT_MIN), F.col(f"r{c}") * LIFT_PAD) for s, c in zip("lwh", "xyz")
    }
    if priors is not None:
        p = priors.select("class_name", *[F.col(s).alias(f"_p{s}") for s in "lwh"])
        out = out.join(p, "class_name", "left")
        dims = {s: F.coalesce(F.col(f"_p{s}"), e) for s, e in dims.items()}
    yaw = 0.5 * F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy"))
    return out.select(
        *keys, "class_name", "point_count", "x", "y", "z",
        *[e.alias(s) for s, e in dims.items()], yaw.alias("yaw"),
        F.lit(LIFT_CONF).alias("confidence"),
    )


def rank_detections(dets: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Position of each detection by falling confidence inside ``keys``."""
    from framewright.operators.ranking import with_rank

    bucket = F.floor((1 - F.col("confidence")) * 256)
    order = [F.desc("confidence"), F.col(tie)]
    return with_rank(dets, keys, order, bucket, "position").withColumn(
        "position", F.col("position") + 1
    )


def preview(dets: DataFrame, images: int = 6, per_image: int = 50) -> DataFrame:
    """First images (by ordinal) with their first detections, as the preview pane shows them."""
    first = dets.select("sample_id").distinct().orderBy("sample_id").limit(images)
    w = Window.partitionBy("sample_id").orderBy("label_index")
    return (
        dets.join(F.broadcast(first), "sample_id", "left_semi")  # `images` rows
        .withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= per_image)
    )
