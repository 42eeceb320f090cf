"""Calibration rows ``key, k[9], t[16], width, height`` from text and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.geometry3d import matrix_product

KITTI_SIZE, NUSCENES_SIZE = (1242, 375), (1600, 900)  # fixed values: default image sizes


def _rigid(r: Column, t: list[Column]) -> Column:
    """4x4 matrix of a 3x3 array and a translation."""
    cells = []
    for i in range(3):
        cells += [F.get(r, F.lit(3 * i + j)) for j in range(3)] + [t[i]]
    return F.array(*cells, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def kitti(lines: DataFrame, camera: int = 2) -> DataFrame:
    """``NAME: v v v ...`` lines (``path, line``): K from the camera's P, T = R0_rect * Tr."""
    name = F.regexp_extract("line", r"^([^:\s]+):", 1)
    vals = F.transform(
        F.split(F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)), r"\s+"), lambda v: v.try_cast("double")
    )
    wide = lines.groupBy("path").agg(
        *[
            F.max(F.when(name == n, vals)).alias(a)
            for n, a in ((f"P{camera}", "p"), ("R0_rect", "r0"), ("Tr_velo_to_cam", "tr"))
        ]
    ).where("p IS NOT NULL")
    tr3 = F.array(*[F.get("tr", F.lit(4 * i + j)) for i in range(3) for j in range(3)])
    shift = F.array(*[F.get("tr", F.lit(4 * i + 3)) for i in range(3)])
    rot = matrix_product(F.col("r0"), tr3, 3, 3, 3)
    moved = matrix_product(F.col("r0"), shift, 3, 3, 1)
    t = _rigid(rot, [F.get(moved, F.lit(i)) for i in range(3)])
    return wide.select(
        F.col("path").alias("key"),
        F.array(*[F.get("p", F.lit(4 * i + j)) for i in range(3) for j in range(3)]).alias("k"),
        F.when(F.col("r0").isNotNull() & F.col("tr").isNotNull(), t).alias("t"),
        F.lit(KITTI_SIZE[0]).alias("width"), F.lit(KITTI_SIZE[1]).alias("height"),
    )


def nuscenes(records: DataFrame) -> DataFrame:
    """Rows with ``token, camera_intrinsic`` (3x3 or flat) and optional ``lidar_to_camera``,
    ``width``, ``height``."""
    k = F.col("camera_intrinsic")
    if records.schema["camera_intrinsic"].dataType.simpleString().startswith("array<array"):
        k = F.flatten(k)
    cols = records.columns
    t = F.flatten("lidar_to_camera") if "lidar_to_camera" in cols else F.lit(None).cast("array<double>")
    size = [
        F.coalesce(F.col(c), F.lit(d)) if c in cols else F.lit(d)
        for c, d in zip(("width", "height"), NUSCENES_SIZE)
    ]
    return records.select(
        F.col("token").alias("key"), k.alias("k"), t.alias("t"), size[0].alias("width"), size[1].alias("height")
    )


def from_json(docs: DataFrame) -> DataFrame:
    """``key, value`` rows holding ``K, D, width, height, T_cam_lidar``; matrices may be flat or
    nested, and a 3x4 transform gets its last row."""

    def numbers(path: str) -> Column:
        text = F.regexp_replace(F.get_json_object("value", path), r"[\[\]\s]", "")
        return F.transform(F.split(text, ","), lambda v: v.try_cast("double"))

    t = numbers("$.T_cam_lidar")
    last = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return docs.select(
        "key", numbers("$.K").alias("k"), numbers("$.D").alias("d"),
        F.when(F.size(t) == 12, F.concat(t, last)).otherwise(t).alias("t"),
        F.get_json_object("value", "$.width").cast("int").alias("width"),
        F.get_json_object("value", "$.height").cast("int").alias("height"),
    )
