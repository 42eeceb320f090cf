"""Point-cloud queries over the suppliers' line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import cloud, neighbors
from framewright.plans import fixtures as X
from framewright.plans.fixtures import sql
from framewright.plans.registry import query

XYZ = ("x", "y", "z")


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "cloud_stats",
    sql(
        """SELECT cloud_id, count(*) AS point_count, round(min(x), 6) AS min_x,
        round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y,
        round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, true AS has_intensity,
        round(max(x) - min(x), 6) AS extent_x, round(max(y) - min(y), 6) AS extent_y,
        round(max(z) - min(z), 6) AS extent_z, round((min(x) + max(x)) / 2, 6) AS center_x,
        round((min(y) + max(y)) / 2, 6) AS center_y, round((min(z) + max(z)) / 2, 6) AS center_z
        FROM points GROUP BY 1""",
        "points",
    ),
)
def cloud_stats(spark, sf):
    stats = cloud.cloud_stats(X.raw_points(spark, sf)).drop("has_rgb", "has_classification")
    return _rounded(stats, [f"{n}_{c}" for c in XYZ for n in ("min", "max", "extent", "center")])


@query(
    "finite_filter",
    sql(
        """SELECT cloud_id, count(*) AS kept FROM points WHERE y <> 0 AND z > 0
        GROUP BY 1""",
        "points",
    ),
)
def finite_filter(spark, sf):
    # Points on the ground plane get an infinite coordinate here and must go.
    z = F.when(F.col("z") > 0, F.col("z")).otherwise(F.lit(float("nan")))
    pts = X.raw_points(spark, sf).withColumn("z", z)
    return cloud.finite(pts).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "intensity_normalize",
    sql(
        """, top AS (SELECT cloud_id, max(z) AS m FROM points GROUP BY 1)
        SELECT cloud_id, round(sum(CASE WHEN m > 1 THEN z / m ELSE z END), 4) AS total,
        round(max(CASE WHEN m > 1 THEN z / m ELSE z END), 6) AS top
        FROM points JOIN top USING (cloud_id) GROUP BY 1""",
        "points",
    ),
)
def intensity_normalize(spark, sf):
    pts = X.raw_points(spark, sf).select("cloud_id", F.col("z").alias("intensity"))
    return cloud.normalize_intensity(pts).groupBy("cloud_id").agg(
        F.round(F.sum("intensity"), 4).alias("total"), F.round(F.max("intensity"), 6).alias("top")
    )


@query(
    "voxel_mean",
    sql(
        """SELECT cloud_id, CAST(floor(x / 10.0) AS BIGINT) AS vx,
        CAST(floor(y / 10.0) AS BIGINT) AS vy, CAST(floor(z / 10.0) AS BIGINT) AS vz,
        round(avg(x) + 1e-9, 6) AS x, round(avg(y) + 1e-9, 6) AS y,
        round(avg(z) + 1e-9, 6) AS z, round(avg(intensity) + 1e-9, 6) AS intensity, count(*) AS point_count
        FROM points GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY cloud_id, floor(points.x / 10.0), floor(points.y / 10.0), floor(points.z / 10.0)"),
        "points",
    ),
)
def voxel_mean(spark, sf):
    got = cloud.voxel_mean(X.raw_points(spark, sf), 10.0)
    # The offset keeps exact rounding ties on the same side in both engines.
    return got.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in (*XYZ, "intensity")})


@query(
    "sample_voxel_first",
    sql(
        """SELECT cloud_id, min(point_idx) AS point_idx, round(arg_min(x, point_idx), 6) AS x,
        round(arg_min(y, point_idx), 6) AS y FROM points
        GROUP BY cloud_id, floor(x / 12.5), floor(y / 12.5), floor(z / 12.5)""".replace(
            "floor(x", "floor(points.x").replace("floor(y", "floor(points.y"),
        "points",
    ),
)
def sample_voxel_first(spark, sf):
    got = cloud.sample_voxel_first(X.points(spark, sf), 12.5)
    return _rounded(got.select("cloud_id", "point_idx", "x", "y"), ("x", "y"))


@query(
    "sample_random",
    sql(
        """SELECT cloud_id, point_idx FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id
        ORDER BY md5(point_idx || ':5')) AS rn, count(*) OVER (PARTITION BY cloud_id) AS n
        FROM points) WHERE rn <= ceil(n * CAST(0.3 AS DOUBLE))""",
        "points",
    ),
)
def sample_random(spark, sf):
    return cloud.sample_random(X.points(spark, sf), ratio=0.3, seed=5).select("cloud_id", "point_idx")


@query(
    "sample_uniform",
    sql("SELECT cloud_id, point_idx FROM points WHERE point_idx % 7 = 0", "points"),
)
def sample_uniform(spark, sf):
    return cloud.sample_uniform(X.points(spark, sf), 7).select("cloud_id", "point_idx")


@query(
    "point_chunks",
    sql(
        """SELECT cloud_id, point_idx // 100 AS chunk_index, count(*) AS points,
        CAST(ceil(any_value(n) / 100.0) AS BIGINT) AS total_chunks FROM (SELECT *, count(*) OVER
        (PARTITION BY cloud_id) AS n FROM points) GROUP BY 1, 2""",
        "points",
    ),
)
def point_chunks(spark, sf):
    return cloud.point_chunks(X.points(spark, sf), 100).groupBy(
        "cloud_id", "chunk_index", "total_chunks"
    ).agg(F.count(F.lit(1)).alias("points"))


@query(
    "rgb_unpack",
    """SELECT l_partkey, count(*) AS n, (l_partkey >> 16) & 255 AS r, (l_partkey >> 8) & 255 AS g,
    l_partkey & 255 AS b FROM lineitem GROUP BY 1""",
)
def rgb_unpack(spark, sf):
    per = X.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return cloud.unpack_rgb(per, "l_partkey")


_TREE = """/*recursive*/, box AS (SELECT cloud_id, min(x) AS x0, max(x) AS x1, min(y) AS y0,
    max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points GROUP BY 1),
  walk AS (SELECT cloud_id, point_idx, x, y, z, x0, x1, y0, y1, z0, z1, 0 AS level,
    CAST(0 AS BIGINT) AS nx, CAST(0 AS BIGINT) AS ny, CAST(0 AS BIGINT) AS nz
    FROM points JOIN box USING (cloud_id) UNION ALL
    SELECT cloud_id, point_idx, x, y, z,
    CASE WHEN x >= (x0 + x1) / 2 THEN (x0 + x1) / 2 ELSE x0 END,
    CASE WHEN x >= (x0 + x1) / 2 THEN x1 ELSE (x0 + x1) / 2 END,
    CASE WHEN y >= (y0 + y1) / 2 THEN (y0 + y1) / 2 ELSE y0 END,
    CASE WHEN y >= (y0 + y1) / 2 THEN y1 ELSE (y0 + y1) / 2 END,
    CASE WHEN z >= (z0 + z1) / 2 THEN (z0 + z1) / 2 ELSE z0 END,
    CASE WHEN z >= (z0 + z1) / 2 THEN z1 ELSE (z0 + z1) / 2 END, level + 1,
    nx * 2 + (x >= (x0 + x1) / 2)::BIGINT, ny * 2 + (y >= (y0 + y1) / 2)::BIGINT,
    nz * 2 + (z >= (z0 + z1) / 2)::BIGINT FROM walk WHERE level < 4),
  nodes AS (SELECT cloud_id, level, nx, ny, nz, count(*) AS point_count FROM walk GROUP BY ALL),
  tree AS (SELECT n.*, n.point_count <= 50 OR n.level >= 4 AS is_leaf FROM nodes n
    LEFT JOIN nodes p ON p.cloud_id = n.cloud_id AND p.level = n.level - 1 AND p.nx = n.nx // 2
    AND p.ny = n.ny // 2 AND p.nz = n.nz // 2 WHERE n.level = 0 OR p.point_count > 50),
  stepped AS (SELECT *, CASE WHEN is_leaf THEN 1 ELSE CAST(ceil(point_count / 20.0) AS BIGINT) END
    AS step FROM tree)"""


@query(
    "octree_levels",
    sql(
        _TREE + """ SELECT *, CAST(ceil(point_count / CAST(step AS DOUBLE)) AS BIGINT) AS kept
        FROM stepped""",
        "points",
    ),
)
def octree_levels(spark, sf):
    return cloud.octree_nodes(X.raw_points(spark, sf), limit=50, depth=4, target=20)


@query(
    "octree_points",
    sql(
        _TREE + """ SELECT cloud_id, level, nx, ny, nz, point_idx, is_leaf FROM (SELECT w.*, step,
        is_leaf, row_number() OVER (PARTITION BY cloud_id, level, nx, ny, nz ORDER BY point_idx) - 1
        AS r FROM walk w JOIN stepped USING (cloud_id, level, nx, ny, nz)) WHERE r % step = 0""",
        "points",
    ),
)
def octree_points(spark, sf):
    return cloud.octree_points(X.points(spark, sf).drop("intensity"), limit=50, depth=4, target=20).select(
        "cloud_id", "level", "nx", "ny", "nz", "point_idx", "is_leaf"
    )


@query(
    "voxel_clusters",
    sql(
        """, ground AS (SELECT cloud_id, quantile_cont(z, 0.12) AS g FROM points GROUP BY 1),
        flagged AS (SELECT p.*, z > g + CAST(0.12 AS DOUBLE) AS above FROM points p
          JOIN ground USING (cloud_id)),
        used AS (SELECT * FROM (SELECT *, sum(above::INT) OVER (PARTITION BY cloud_id) AS na
          FROM flagged) WHERE above OR na < 60),
        boxes AS (SELECT cloud_id, floor(x / 20.0) AS vx, floor(y / 20.0) AS vy,
          floor(z / 5.0) AS vz, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0,
          max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM used GROUP BY 1, 2, 3, 4),
        solid AS (SELECT *, least(0.95::DOUBLE, 0.5::DOUBLE + n / 6000.0::DOUBLE) AS conf
          FROM boxes WHERE n >= 28 AND x1 - x0 >= 0.2 AND y1 - y0 >= 0.2 AND z1 - z0 >= 0.2),
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY n DESC,
          vx, vy, vz) AS rn FROM solid WHERE conf >= 0.3) WHERE rn <= 10),
        whole AS (SELECT cloud_id, sum(n) AS n, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0,
          max(y1) AS y1, min(z0) AS z0, max(z1) AS z1 FROM boxes GROUP BY 1),
        found AS (SELECT cloud_id, conf, n, x0, x1, y0, y1, z0, z1 FROM top UNION ALL
          SELECT cloud_id, 0.6, n, x0, x1, y0, y1, z0, z1 FROM whole WHERE n >= 200
          AND cloud_id NOT IN (SELECT cloud_id FROM top))
        SELECT cloud_id, 'Car' AS class_name, round(conf + 1e-9, 3) AS confidence,
        CAST(n AS BIGINT) AS point_count, round((x0 + x1) / 2, 3) AS center_x,
        round((y0 + y1) / 2, 3) AS center_y, round((z0 + z1) / 2, 3) AS center_z,
        round(greatest(x1 - x0, 0.4), 3) AS length, round(greatest(y1 - y0, 0.4), 3) AS width,
        round(greatest(z1 - z0, 0.4), 3) AS height, 0.0::DOUBLE AS yaw FROM found""",
        "points",
    ),
)
def voxel_clusters(spark, sf):
    return cloud.voxel_clusters(
        X.raw_points(spark, sf), min_points=28, size=(20.0, 20.0, 5.0), most=10
    )


_NEAR = """, pairs AS (SELECT a.cloud_id, a.point_idx, b.point_idx AS other,
    sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
    FROM points a JOIN points b ON a.cloud_id = b.cloud_id AND a.point_idx <> b.point_idx)"""
_RADIUS = """, counts AS (SELECT a.cloud_id, a.point_idx, count(*) FILTER (a.point_idx <> b.point_idx
    AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 16)
    AS neighbors FROM points a JOIN points b ON a.cloud_id = b.cloud_id GROUP BY 1, 2)"""


@query("radius_neighbors", sql(_RADIUS + " SELECT * FROM counts", "points"))
def radius_neighbors(spark, sf):
    return neighbors.radius_counts(X.points(spark, sf), 4.0)


@query(
    "outlier_radius",
    sql(_RADIUS + " SELECT cloud_id, point_idx FROM counts WHERE neighbors >= 2", "points"),
)
def outlier_radius(spark, sf):
    return neighbors.radius_outliers(X.points(spark, sf), 4.0, 2).select(
        "cloud_id", "point_idx"
    )


@query(
    "knn",
    sql(
        _NEAR + """ SELECT cloud_id, point_idx, rank, other, round(d, 6) AS dist FROM (SELECT *,
        row_number() OVER (PARTITION BY cloud_id, point_idx ORDER BY d, other) AS rank FROM pairs)
        WHERE rank <= 4""",
        "points",
    ),
)
def knn(spark, sf):
    return neighbors.nearest(X.points(spark, sf), 4).select(
        "cloud_id", "point_idx", (F.col("rank") + 1).alias("rank"), F.col("idx").alias("other"),
        F.round("dist", 6).alias("dist"),
    )


@query(
    "outlier_statistical",
    sql(
        _NEAR + """, near AS (SELECT cloud_id, point_idx, sum(d) / 6 AS m FROM (SELECT *,
          row_number() OVER (PARTITION BY cloud_id, point_idx ORDER BY d, other) AS rank FROM pairs)
          WHERE rank <= 5 GROUP BY 1, 2),
        rule AS (SELECT cloud_id, avg(m) + 1.5 * stddev_samp(m) AS lim FROM near WHERE m > 0
          GROUP BY 1)
        SELECT cloud_id, point_idx, round(m, 6) AS mean_dist FROM near JOIN rule USING (cloud_id)
        WHERE m > 0 AND m < lim""",
        "points",
    ),
)
def outlier_statistical(spark, sf):
    got = neighbors.statistical_outliers(X.points(spark, sf), 6, 1.5)
    return _rounded(got.select("cloud_id", "point_idx", "mean_dist"), ("mean_dist",))


_NORMALS = _NEAR + """, near AS (SELECT cloud_id, point_idx, other FROM (SELECT *,
      row_number() OVER (PARTITION BY cloud_id, point_idx ORDER BY d, other) AS rank FROM pairs) WHERE rank <= 9 AND d <= 12.0),
    members AS (SELECT * FROM near UNION ALL SELECT cloud_id, point_idx, point_idx FROM points),
    cov AS (SELECT m.cloud_id, m.point_idx, count(*) - 1 AS used, var_pop(p.x) AS xx, var_pop(p.y) AS yy, var_pop(p.z) AS zz,
      covar_pop(p.x, p.y) AS xy, covar_pop(p.x, p.z) AS xz, covar_pop(p.y, p.z) AS yz
      FROM members m JOIN points p ON p.cloud_id = m.cloud_id AND p.point_idx = m.other GROUP BY 1, 2),
    mid AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cov),
    wide AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM mid),
    half AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz)
      + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) END AS r FROM wide)
    SELECT cloud_id, point_idx, used, true AS unit, true AS toward, CASE WHEN used < 2 THEN 0.0 ELSE
      round(q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3 + 2 * pi() / 3) + 0.013, 1) END AS residual FROM half"""


@query("normals", sql(_NORMALS, "points"))
def normals(spark, sf):
    # The smallest eigenvalue has a closed form, its vector has not: the SQL knows length, side and residual.
    got = neighbors.normals(X.points(spark, sf), radius=12.0, max_nn=10)
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in ("ny", "nz")), F.col("nx") * F.col("nx")))
    side = F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z")
    return got.select(
        "cloud_id", "point_idx", F.col("used").cast("bigint").alias("used"), (F.abs(length - 1) < 1e-9).alias("unit"),
        ((side <= 1e-9) | (F.col("used") < 2)).alias("toward"),
        F.when(F.col("used") < 2, 0.0).otherwise(F.round(F.col("residual") + 0.013, 1)).alias("residual"),
    )
