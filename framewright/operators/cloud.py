"""Point-cloud statistics, sampling, chunks, octree levels and coarse clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.ranking import exact_quantile, with_rank, with_shuffled_rank
from framewright.session import finely, shuffled, stored

XYZ = ("x", "y", "z")


def finite(df: DataFrame, cols=XYZ) -> DataFrame:
    """Rows whose coordinates are all finite numbers."""
    inf = float("inf")
    for c in cols:
        df = df.where(~F.isnan(c) & (F.col(c) < inf) & (F.col(c) > -inf))
    return df


def voxel(size: float | tuple[float, float, float]) -> list[Column]:
    sizes = size if isinstance(size, tuple) else (size,) * 3
    if min(sizes) <= 0:
        raise ValueError("voxel size must be positive")
    return [F.floor(F.col(c) / s).alias(f"v{c}") for c, s in zip(XYZ, sizes)]


def cloud_stats(points: DataFrame) -> DataFrame:
    """Count, bounds, extent and center per cloud, and which optional columns it has."""
    ends = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))]
    flags = [
        (F.max(F.col(c)).isNotNull() if c in points.columns else F.lit(False)).alias(f"has_{c}")
        for c in ("intensity", "rgb", "classification")
    ]
    base = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("point_count"), *ends, *flags)
    return base.withColumns(
        {
            **{f"extent_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ},
            **{f"center_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in XYZ},
        }
    )


def normalize_intensity(points: DataFrame) -> DataFrame:
    """Divide by a cloud's largest intensity when that is above 1."""
    top = points.groupBy("cloud_id").agg(F.max("intensity").alias("_top"))
    scaled = F.when(F.col("_top") > 1, F.col("intensity") / F.col("_top")).otherwise(F.col("intensity"))
    return points.join(top, "cloud_id").withColumn("intensity", scaled).drop("_top")


def voxel_mean(points: DataFrame, size: float) -> DataFrame:
    """Mean point of each occupied voxel."""
    mean = [c for c in (*XYZ, "intensity") if c in points.columns]
    return points.groupBy("cloud_id", *voxel(size)).agg(
        *[F.avg(c).alias(c) for c in mean], F.count(F.lit(1)).alias("point_count")
    )


def sample_voxel_first(points: DataFrame, size: float) -> DataFrame:
    """First point (lowest index) of each occupied voxel."""
    rest = [c for c in points.columns if c != "cloud_id"]
    first = F.min_by(F.struct(*rest), "point_idx").alias("_p")
    return points.groupBy("cloud_id", *voxel(size)).agg(first).select("cloud_id", "_p.*")


def sample_random(
    points: DataFrame, ratio: float | None = None, target: int | None = None, seed: int = 0
) -> DataFrame:
    """Exactly ceil(n * ratio) points per cloud, or ``target`` (all when there are fewer)."""
    if (ratio is None) == (target is None):
        raise ValueError("give ratio or target")
    if ratio is not None and not 0.0 <= ratio <= 1.0:
        raise ValueError("ratio must be in [0, 1]")
    if target is not None and target <= 0:
        raise ValueError("target must be positive")
    if ratio == 1.0:
        return points
    ranked = with_shuffled_rank(points, ["cloud_id"], "point_idx", seed, "_rank", "_n")
    keep = F.ceil(F.col("_n") * F.lit(ratio)) if ratio is not None else F.lit(target)
    return ranked.where(F.col("_rank") < keep).drop("_rank", "_n")


def sample_uniform(points: DataFrame, step: int) -> DataFrame:
    if step < 1:
        raise ValueError("step must be positive")
    return points.where(F.col("point_idx") % step == 0)


def point_chunks(points: DataFrame, size: int = 100_000) -> DataFrame:
    """Chunk number of each point and the number of chunks of its cloud."""
    if size < 1:
        raise ValueError("chunk size must be positive")
    totals = points.groupBy("cloud_id").agg(
        F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("total_chunks")
    )
    return points.join(totals, "cloud_id").withColumn(
        "chunk_index", F.floor(F.col("point_idx") / size)
    )


def unpack_rgb(points: DataFrame, packed: str = "rgb") -> DataFrame:
    rgb = F.col(packed)
    return points.withColumns(
        {
            "r": F.shiftright(rgb, 16).bitwiseAND(255),
            "g": F.shiftright(rgb, 8).bitwiseAND(255),
            "b": rgb.bitwiseAND(255),
        }
    )


# ---- octree ---------------------------------------------------------------------------------


def octree_codes(points: DataFrame, depth: int) -> DataFrame:
    """Points with the cell ``cx, cy, cz`` at the deepest level."""
    bounds = cloud_stats(points.select("cloud_id", *XYZ)).select(
        "cloud_id", *[f"{n}_{c}" for c in XYZ for n in ("min", "max")]
    )
    coded = points.join(bounds, "cloud_id").withColumns(
        {f"c{c}": F.lit(0).cast("bigint") for c in XYZ}
    )
    for _ in range(depth):  # the upper half begins at the middle
        coded = coded.withColumns({f"_mid_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in XYZ})
        halves = {}
        for c in XYZ:
            mid, up = F.col(f"_mid_{c}"), F.col(c) >= F.col(f"_mid_{c}")
            halves[f"min_{c}"] = F.when(up, mid).otherwise(F.col(f"min_{c}"))
            halves[f"max_{c}"] = F.when(up, F.col(f"max_{c}")).otherwise(mid)
            halves[f"c{c}"] = F.col(f"c{c}") * 2 + up.cast("bigint")
        coded = coded.withColumns(halves)
    return coded.drop(*[f"{n}_{c}" for c in XYZ for n in ("min", "max", "_mid")])


def _shift(col: str, depth: int, level: Column) -> Column:
    return F.floor(F.col(col) / F.pow(F.lit(2.0), depth - level)).cast("bigint")


_NODE = ["cloud_id", "level", "nx", "ny", "nz"]


def octree_nodes(
    points: DataFrame, limit: int = 10_000, depth: int = 8, target: int = 5_000
) -> DataFrame:
    """Nodes of the tree: level, cell, points below, leaf or not, points kept and the step.

    A node exists when its parent holds more than ``limit`` points. Counts roll up from the
    deepest cells level by level, so points are aggregated once and a node meets at most its eight children. Cells are
    cut by their number, as the tables of a group grow with what a task gets.
    """
    cell = ["cloud_id", "cx", "cy", "cz"]
    codes = octree_codes(points.select("cloud_id", *XYZ), depth).select(*cell)
    cells = stored(finely(codes, *cell, count=points.count()).groupBy(*cell).agg(F.count(F.lit(1)).alias("point_count")), "octree-cells")
    many = cells.count()
    at = cells.select("cloud_id", F.lit(depth).alias("level"), *[F.col(f"c{c}").alias(f"n{c}") for c in XYZ], "point_count")
    nodes = at
    for level in reversed(range(depth)):
        up = at.select("cloud_id", F.lit(level).alias("level"), *[F.floor(F.col(f"n{c}") / 2).alias(f"n{c}") for c in XYZ], "point_count")
        at = stored(finely(up, *_NODE, count=many).groupBy(*_NODE).agg(F.sum("point_count").alias("point_count")), "octree-level")
        many = at.count()
        nodes = nodes.unionByName(at)
    lv = F.col("level")
    inner = nodes.where((F.col("point_count") > limit) & (lv < depth)).select(
        "cloud_id", (lv + 1).alias("level"), *[F.col(f"n{c}").alias(f"p{c}") for c in XYZ]
    )
    keyed = nodes.withColumns({f"p{c}": F.floor(F.col(f"n{c}") / 2) for c in XYZ})
    children = keyed.join(shuffled(inner), ["cloud_id", "level", "px", "py", "pz"], "left_semi")
    tree = keyed.where("level = 0").unionByName(children).drop("px", "py", "pz")
    leaf = (F.col("point_count") <= limit) | (lv >= depth)
    step = F.when(leaf, F.lit(1)).otherwise(F.ceil(F.col("point_count") / target)).cast("bigint")
    return tree.withColumn("is_leaf", leaf).withColumn("step", step).withColumn(
        "kept", F.ceil(F.col("point_count") / F.col("step")).cast("bigint")
    )


def octree_points(
    points: DataFrame, limit: int = 10_000, depth: int = 8, target: int = 5_000
) -> DataFrame:
    """Points shown at each node: all at a leaf, every step-th by index at an inner node.

    Cells learn their nodes first, so a point is copied only for the nodes that hold it. Ranks are taken in parts of bounded size.
    """
    coded = stored(octree_codes(points, depth), "octree-points")
    nodes = stored(octree_nodes(coded.select("cloud_id", *XYZ), limit, depth, target).select(*_NODE, "step", "is_leaf", "point_count"), "octree-nodes")
    cell = ["cloud_id", "cx", "cy", "cz"]
    lv = F.col("level")
    levels = coded.select(*cell).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    held = levels.withColumns({f"n{c}": _shift(f"c{c}", depth, lv) for c in XYZ}).join(shuffled(nodes.drop("point_count")), _NODE)
    shown = coded.join(shuffled(stored(held, "octree-held")), cell).drop("cx", "cy", "cz").withColumn("_part", F.floor(F.col("point_idx") / 65536))
    many = nodes.agg(F.coalesce(F.sum("point_count"), F.lit(0))).first()[0]  # a point stands in each of its nodes
    ranked = with_rank(finely(shown, *_NODE, "_part", count=many), _NODE, [F.col("point_idx")], F.col("_part"), "_rank")
    return ranked.where(F.col("_rank") % F.col("step") == 0).select(
        "cloud_id", "level", "nx", "ny", "nz", *[c for c in points.columns if c != "cloud_id"], "is_leaf"
    )


# ---- coarse clusters ------------------------------------------------------------------------

# Rules of the cluster heuristic.
GROUND_Q, GROUND_GAP, MIN_ABOVE = 0.12, 0.12, 60
CLUSTER_VOXEL, MIN_POINTS, MIN_SIZE, MIN_DIM = (1.6, 1.6, 1.2), 90, 0.2, 0.4
FALLBACK_POINTS, FALLBACK_CONF = 200, 0.6


def voxel_clusters(
    points: DataFrame, confidence: float = 0.3, class_name: str = "Car", min_points: int = MIN_POINTS,
    size: tuple[float, float, float] = CLUSTER_VOXEL, most: int | None = None,
) -> DataFrame:
    """Boxes around dense voxels above the ground; one box for the whole cloud when there is none and the
    cloud is large enough. ``most`` keeps only that many of the fullest voxels of a cloud (default: all)."""
    pts = finite(points).select("cloud_id", *XYZ)
    ground = exact_quantile(pts, ["cloud_id"], "z", GROUND_Q, "_ground")
    pts = pts.join(ground, "cloud_id").withColumn(
        "_above", F.col("z") > F.col("_ground") + GROUND_GAP
    )
    # Bounds per voxel and side of the ground; whole-cloud figures follow from the same table.
    ends = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))]
    cells = pts.groupBy("cloud_id", "_above", *voxel(size)).agg(F.count(F.lit(1)).alias("n"), *ends)
    above = cells.groupBy("cloud_id").agg(
        F.coalesce(F.sum(F.when(F.col("_above"), F.col("n"))), F.lit(0)).alias("_n_above")
    )
    used = cells.join(above, "cloud_id").where(F.col("_above") | (F.col("_n_above") < MIN_ABOVE))
    roll = [
        f(f"{n}_{c}").alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))
    ]
    boxes = used.groupBy("cloud_id", "vx", "vy", "vz").agg(F.sum("n").alias("n"), *roll)
    size_of = {c: F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ}
    conf = F.least(F.lit(0.95), F.lit(0.5) + F.col("n") / 6000.0)
    solid = boxes.where(F.col("n") >= min_points).withColumn("confidence", conf)
    for c in XYZ:
        solid = solid.where(size_of[c] >= MIN_SIZE)
    solid = solid.where(F.col("confidence") >= confidence)
    top = solid
    if most is not None:
        w = Window.partitionBy("cloud_id").orderBy(F.desc("n"), "vx", "vy", "vz")
        top = solid.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
    whole = boxes.groupBy("cloud_id").agg(F.sum("n").alias("n"), *roll)
    rest = whole.where(F.col("n") >= FALLBACK_POINTS).join(top, "cloud_id", "left_anti")
    rest = rest.withColumn("confidence", F.lit(max(confidence, FALLBACK_CONF)))
    both = top.select(*rest.columns).unionByName(rest)
    dims = {"x": "length", "y": "width", "z": "height"}
    return both.select(
        "cloud_id",
        F.lit(class_name).alias("class_name"),
        F.round("confidence", 3).alias("confidence"),
        F.col("n").alias("point_count"),
        *[F.round((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2, 3).alias(f"center_{c}") for c in XYZ],
        *[F.round(F.greatest(size_of[c], F.lit(MIN_DIM)), 3).alias(dims[c]) for c in XYZ],
        F.lit(0.0).alias("yaw"),
    )
