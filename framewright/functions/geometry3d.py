"""Rigid transforms, pinhole projection and 3D boxes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Axis maps between lidar frames, rows of a 3x3 matrix.
AXES = {
    ("nuscenes", "kitti"): ((0, 1, 0), (-1, 0, 0), (0, 0, 1)),
    ("kitti", "nuscenes"): ((0, -1, 0), (1, 0, 0), (0, 0, 1)),
    ("waymo", "kitti"): ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    ("kitti", "waymo"): ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
}
# Corner signs (front +, left +, top +) in corner order.
CORNER_SIGNS = (
    (1, 1, -1), (1, -1, -1), (1, -1, 1), (1, 1, 1),
    (-1, 1, -1), (-1, -1, -1), (-1, -1, 1), (-1, 1, 1),
)
IDENTITY4 = (1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0)


def convert_axes(x: Column, y: Column, z: Column, source: str, target: str) -> tuple[Column, ...]:
    if source == target:
        return x, y, z
    if (source, target) not in AXES:
        raise ValueError(f"no axis map from {source} to {target}")
    pick = {1: lambda c: c, -1: lambda c: -c}
    return tuple(
        next(pick[s](c) for s, c in zip(row, (x, y, z)) if s) for row in AXES[source, target]
    )


def _at(m: Column | Sequence[float], i: int) -> Column:
    """Entry of a matrix given as an array column or as plain numbers."""
    return F.get(m, F.lit(i)) if isinstance(m, Column) else F.lit(float(m[i]))


def transform(x: Column, y: Column, z: Column, t: Column | Sequence[float]) -> tuple[Column, ...]:
    """Apply a row-major 4x4 matrix."""
    return tuple(
        _at(t, r) * x + _at(t, r + 1) * y + _at(t, r + 2) * z + _at(t, r + 3) for r in (0, 4, 8)
    )


def pinhole(
    x: Column, y: Column, z: Column, k: Column | Sequence[float], d: Column | None = None
) -> tuple[Column, Column]:
    """Pixel position of a point in the camera frame; ``d`` holds k1, k2, p1, p2, k3."""
    a, b = F.try_divide(x, z), F.try_divide(y, z)
    if d is not None:
        k1, k2, p1, p2, k3 = (F.coalesce(F.get(d, F.lit(i)), F.lit(0.0)) for i in range(5))
        r2 = a * a + b * b
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        a, b = (
            a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a),
            b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b,
        )
    return _at(k, 0) * a + _at(k, 2), _at(k, 4) * b + _at(k, 5)


def project(
    points: DataFrame,
    k: Column | Sequence[float],
    width: Column | int,
    height: Column | int,
    t: Column | Sequence[float] | None = None,
    d: Column | None = None,
    keep_behind: bool = False,
) -> DataFrame:
    """Add ``u, v, depth, in_front, valid``. ``valid`` means in front and inside the image."""
    xyz = (F.col("x"), F.col("y"), F.col("z"))
    cam = transform(*xyz, t) if t is not None else xyz
    out = points.withColumns(dict(zip(("_px", "_py", "depth"), cam)))
    u, v = pinhole(F.col("_px"), F.col("_py"), F.col("depth"), k, d)
    front = F.lit(True) if keep_behind else F.col("depth") > 0
    W = width if isinstance(width, Column) else F.lit(width)
    H = height if isinstance(height, Column) else F.lit(height)
    inside = (F.col("u") >= 0) & (F.col("u") < W) & (F.col("v") >= 0) & (F.col("v") < H)
    return (
        out.withColumn("in_front", front)
        .withColumn("u", F.when(F.col("in_front"), u))
        .withColumn("v", F.when(F.col("in_front"), v))
        .withColumn("valid", F.col("in_front") & F.coalesce(inside, F.lit(False)))
        .drop("_px", "_py")
    )


def box_corners(x, y, z, l, w, h, yaw) -> Column:
    """The eight corners of a box turned about z, as an array of ``x, y, z`` structs."""
    cos, sin = F.cos(yaw), F.sin(yaw)
    corners = []
    for sl, sw, sh in CORNER_SIGNS:
        dx, dy, dz = l / 2 * sl, w / 2 * sw, h / 2 * sh
        corners.append(
            F.struct(
                (x + (dx * cos - dy * sin)).alias("x"),
                (y + (dx * sin + dy * cos)).alias("y"),
                (z + dz).alias("z"),
            )
        )
    return F.array(*corners)


def project_boxes(
    boxes: DataFrame,
    k: Column | Sequence[float],
    width: int,
    height: int,
    t: Sequence[float] | None = None,
) -> DataFrame:
    """Add the clipped image box ``x1, y1, x2, y2`` of the corners in front of the camera, null
    when nothing of it is visible. Works inside the row: no explode, no grouping."""
    # A corner is the center plus or minus three half axes, also after a rigid transform: these
    # twelve numbers per box leave only sums per corner.
    cos, sin, zero = F.cos("yaw"), F.sin("yaw"), F.lit(0.0)
    l, w, h = (F.col(c) / 2 for c in "lwh")
    vectors = {
        "c": (F.col("x"), F.col("y"), F.col("z")), "l": (l * cos, l * sin, zero),
        "w": (-w * sin, w * cos, zero), "h": (zero, zero, h),
    }
    if t is not None:
        origin = transform(zero, zero, zero, t)
        for name, v in vectors.items():
            moved = transform(*v, t)
            vectors[name] = moved if name == "c" else tuple(m - o for m, o in zip(moved, origin))
    out = boxes.withColumns({f"_{n}{a}": e for n, v in vectors.items() for a, e in zip("xyz", v)})
    names = range(len(CORNER_SIGNS))

    def along(axis: str, signs: tuple[int, int, int]) -> Column:
        total = F.col(f"_c{axis}")
        for n, sign in zip("lwh", signs):
            total = total + F.col(f"_{n}{axis}") if sign > 0 else total - F.col(f"_{n}{axis}")
        return total

    out = out.withColumns(
        {f"_{a}{i}": along(a, CORNER_SIGNS[i]) for i in names for a in "xyz"}
    )
    spots = {}
    for i in names:
        u, v = pinhole(F.col(f"_x{i}"), F.col(f"_y{i}"), F.col(f"_z{i}"), k)
        front = F.col(f"_z{i}") > 0
        spots[f"_u{i}"], spots[f"_v{i}"] = F.when(front, u), F.when(front, v)
    out = out.withColumns(spots)
    us, vs = [F.col(f"_u{i}") for i in names], [F.col(f"_v{i}") for i in names]

    def hold(value: Column, top: int) -> Column:
        # Null when no corner is in front: least and greatest skip the hidden ones only.
        held = F.least(F.lit(float(top)), F.greatest(F.lit(0.0), value))
        return F.when(value.isNotNull(), held)

    out = out.withColumns(
        {
            "_x1": hold(F.least(*us), width), "_y1": hold(F.least(*vs), height),
            "_x2": hold(F.greatest(*us), width), "_y2": hold(F.greatest(*vs), height),
        }
    )
    ok = (F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1"))
    box = F.struct(*[F.when(ok, F.col(f"_{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")])
    # The generator keeps later filters on the corners from being pushed down and computed again.
    return out.select(*boxes.columns, F.inline(F.array(box)))


def yaw_quaternion(yaw: Column) -> Column:
    return F.array(F.cos(yaw / 2), F.lit(0.0), F.lit(0.0), F.sin(yaw / 2))


def matrix_product(a: Column, b: Column, rows: int, inner: int, cols: int) -> Column:
    """Row-major product of two small matrices held as arrays."""
    cells = []
    for i in range(rows):
        for j in range(cols):
            cell = F.get(a, F.lit(i * inner)) * F.get(b, F.lit(j))
            for m in range(1, inner):
                cell = cell + F.get(a, F.lit(i * inner + m)) * F.get(b, F.lit(m * cols + j))
            cells.append(cell)
    return F.array(*cells)
