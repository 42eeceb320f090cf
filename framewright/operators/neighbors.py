"""Radius and nearest-neighbor searches in point clouds, and what builds on them.

A cloud of up to a block of points is one task unit. Larger ones are cut into the leaves of a linear octree, with equal points as one
weighted point; a task compares a leaf with the leaves in reach. Candidate pairs live only as a small distance matrix
inside a task and never become rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators import octree
from framewright.operators.cloud import XYZ
from framewright.session import materialize, shuffled, spread_by, stored

_POINT = "cloud_id BIGINT, point_idx BIGINT"
_NEAR = f"{_POINT}, rank INT, dist DOUBLE, idx BIGINT, nx DOUBLE, ny DOUBLE, nz DOUBLE"


def _sq_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.zeros((len(a), len(b)))
    for k in range(3):
        d += (a[:, k, None] - b[None, :, k]) ** 2
    return d


def _by_size(points: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Points of clouds of up to ``block`` points, and of the others if there are any. Stored first: they are read two times or more."""
    points = stored(points.select("cloud_id", "point_idx", *XYZ), "cloud-points")
    counts = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(counts.where(F.col("_n") > block).select("cloud_id"))
    if large.isEmpty():
        return points, None
    return points.join(large, "cloud_id", "left_anti"), points.join(large, "cloud_id", "left_semi")


def _alone(points: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(idx, xyz) -> columns`` over whole small clouds."""

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = kernel(part["point_idx"].to_numpy(), part[list(XYZ)].to_numpy(np.float64))
        return pd.DataFrame({"cloud_id": key[0], **out})

    return spread_by(points.select("cloud_id", "point_idx", *XYZ), "cloud_id").groupBy("cloud_id").applyInPandas(one, schema)


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.frombuffer(row["xyz"], np.float64).reshape(-1, 3), np.frombuffer(row["lens"], np.int64), np.frombuffer(row["ids"], np.int64),
        np.frombuffer(row["weights"], np.int64),
    )


def _together(leaves: DataFrame, pairs: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(query leaf, iterator of partner leaves, chunks) -> columns`` over leaves and their partners."""
    keys = ["cloud_id", "q", "chunk"]
    rows = octree.meetings(pairs).join(leaves, ["cloud_id", "leaf"])

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        query = part[part["is_query"]].iloc[0]
        partners = part[~part["is_query"]]
        partners = partners.iloc[np.argsort(partners["leaf"].to_numpy() != query["leaf"], kind="stable")]  # its own first
        out = kernel(query, (row for _, row in partners.iterrows()), query["chunks"])
        return pd.DataFrame({"cloud_id": key[0], **out})

    return spread_by(rows, *keys).groupBy(*keys).applyInPandas(one, schema)


def radius_counts(points: DataFrame, radius: float, block: int = 2048) -> DataFrame:
    """``neighbors``: other points within ``radius`` of each point. Coordinates must be finite."""
    if radius <= 0:
        raise ValueError("radius must be positive")

    def alone(idx: np.ndarray, xyz: np.ndarray) -> dict:
        n = np.concatenate([(_sq_dist(xyz[s : s + 512], xyz) <= radius * radius).sum(axis=1) for s in range(0, len(xyz), 512)])
        return {"point_idx": idx, "neighbors": n - 1}

    small, large = _by_size(points, block)
    out = _alone(small, alone, f"{_POINT}, neighbors BIGINT")
    if large is None:
        return out

    def near(query: pd.Series, partners, chunks: int) -> dict:
        xyz, _, ids, _ = _unpacked(query)
        n = np.zeros(len(xyz), np.int64)
        for row in partners:
            other, _, _, weights = _unpacked(row)
            for s in range(0, len(xyz), 512):
                n[s : s + 512] += (_sq_dist(xyz[s : s + 512], other) <= radius * radius) @ weights
        return {"head": ids, "n": n}

    equal = large.groupBy("cloud_id", *XYZ).agg(F.array(F.min("point_idx")).alias("ids"), F.count(F.lit(1)).alias("weight"))
    equal = shuffled(stored(equal, "equal-points"))
    leaves = shuffled(stored(octree.packed(octree.leaves(equal, block)), "cloud-leaves"))
    pairs = octree.leaf_pairs(leaves.withColumn("reach", F.lit(float(radius))))
    heads = _together(leaves, pairs, near, "cloud_id BIGINT, head BIGINT, n BIGINT").groupBy("cloud_id", "head").agg(F.sum("n").alias("n"))
    places = equal.select("cloud_id", *XYZ, F.col("ids")[0].alias("head")).join(heads, ["cloud_id", "head"])
    found = large.join(places, ["cloud_id", *XYZ]).select("cloud_id", "point_idx", (F.col("n") - 1).alias("neighbors"))
    return out.unionByName(found)


def radius_outliers(points: DataFrame, radius: float, min_neighbors: int) -> DataFrame:
    """Points with at least ``min_neighbors`` others in reach."""
    keep = radius_counts(points, radius).where(F.col("neighbors") >= min_neighbors)
    return points.join(keep.select("cloud_id", "point_idx"), ["cloud_id", "point_idx"], "left_semi")


def _nearest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k smallest finite entries of each row, by value and id."""
    take = min(k, d.shape[1])
    kth = np.partition(d, take - 1, axis=1)[:, take - 1]
    row, col = np.nonzero((d <= kth[:, None]) & (d < np.inf))
    order = np.lexsort((ids[col], d[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < take
    return row[first], col[first]


def _ranks(row: np.ndarray) -> np.ndarray:
    return (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.int32)


def _nearest_alone(idx: np.ndarray, xyz: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance of the k nearest other points of each point of a small cloud."""
    parts = []
    for s in range(0, len(xyz), 512):
        d = _sq_dist(xyz[s : s + 512], xyz)
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        row, col = _nearest(d, idx, k)
        parts.append((row + s, col, np.sqrt(d[row, col])))
    return tuple(np.concatenate(p) for p in zip(*parts))


def nearest(points: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """``cloud_id, point_idx, rank, dist, idx, nx, ny, nz``: the k nearest other points of each, ranked from 0, ties by index; fewer only when
    the cloud has fewer. Coordinates must be finite.

    A leaf of a large cloud first finds k neighbors inside itself. That bounds how far each of its points must look, hence which
    leaves it meets; one round is always enough. Of equal points only the first k + 1 can be anyone's neighbors.
    """
    if k < 1:
        raise ValueError("k must be positive")

    def alone(idx: np.ndarray, xyz: np.ndarray) -> dict:
        row, col, dist = _nearest_alone(idx, xyz, k)
        return {"point_idx": idx[row], "rank": _ranks(row), "dist": dist, "idx": idx[col], **{f"n{c}": xyz[col, i] for i, c in enumerate(XYZ)}}

    small, large = _by_size(points, block)
    out = _alone(small, alone, _NEAR)
    return out if large is None else out.unionByName(_nearest_large(large, k, block))


def _nearest_large(points: DataFrame, k: int, block: int) -> DataFrame:
    same = Window.partitionBy("cloud_id", *XYZ).orderBy("point_idx")
    first = points.select("cloud_id", "point_idx", *XYZ).withColumn("_rn", F.row_number().over(same)).where(F.col("_rn") <= k + 1)
    equal = first.groupBy("cloud_id", *XYZ).agg(F.sort_array(F.collect_list("point_idx")).alias("ids"))  # k + 1 at most
    equal = shuffled(stored(equal.withColumn("weight", F.lit(1).cast("bigint")), "equal-points"))
    leaves = octree.packed(octree.leaves(equal, block))

    def bound(batches):
        for batch in batches:
            reach = []
            for _, row in batch.iterrows():
                xyz, lens, _, _ = _unpacked(row)
                if lens.sum() <= k:
                    reach.append(np.full(len(xyz), np.inf))
                    continue
                other = np.repeat(xyz, lens, axis=0)
                reach.append(np.concatenate([
                    np.partition(_sq_dist(xyz[s : s + 256], other), k, axis=1)[:, k] for s in range(0, len(xyz), 256)
                ]))
            yield batch.assign(bound=[r.tobytes() for r in reach], reach=[float(np.sqrt(r.max())) for r in reach])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema)
    leaves = shuffled(stored(leaves.mapInPandas(bound, f"{kinds}, bound BINARY, reach DOUBLE"), "cloud-leaves"))
    pairs = octree.leaf_pairs(leaves)

    def near(query: pd.Series, partners, chunks: int) -> dict:
        xyz, _, own, _ = _unpacked(query)
        heads = own[np.cumsum(np.append(0, np.frombuffer(query["lens"], np.int64)[:-1]))]
        most = np.frombuffer(query["bound"], np.float64)
        found = []
        for row in partners:
            other, lens, ids, _ = _unpacked(row)
            other = np.repeat(other, lens, axis=0)
            for s in range(0, len(xyz), 256):
                d = _sq_dist(xyz[s : s + 256], other)
                i, j = np.nonzero(d <= most[s : s + 256, None])
                found.append((i + s, d[i, j], ids[j], other[j]))
        i, d, ids, at = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, d, i))
        i, d, ids, at = i[order], d[order], ids[order], at[order]
        first = _ranks(i) <= k
        i, d, ids, at = i[first], d[first], ids[first], at[first]
        return {"head": heads[i], "chunks": chunks, "dist": np.sqrt(d), "idx": ids, **{f"n{c}": at[:, n] for n, c in enumerate(XYZ)}}

    rows = _together(leaves, pairs, near, "cloud_id BIGINT, head BIGINT, chunks INT, dist DOUBLE, idx BIGINT, nx DOUBLE, ny DOUBLE, nz DOUBLE")
    rows = shuffled(stored(rows, "cloud-near"))
    by = Window.partitionBy("cloud_id", "head").orderBy("dist", "idx")
    once = rows.where("chunks = 1").drop("chunks")
    several = rows.where("chunks > 1").withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= k + 1).select(*once.columns)
    places = equal.select("cloud_id", *XYZ, F.col("ids")[0].alias("head"))
    of_point = points.select("cloud_id", "point_idx", *XYZ).join(places, ["cloud_id", *XYZ]).select("cloud_id", "point_idx", "head")
    all_ = of_point.join(once.unionByName(several), ["cloud_id", "head"]).where(F.col("idx") != F.col("point_idx"))
    own = Window.partitionBy("cloud_id", "point_idx").orderBy("dist", "idx")
    return all_.withColumn("rank", (F.row_number().over(own) - 1).cast("int")).where(F.col("rank") < k).select(
        "cloud_id", "point_idx", "rank", "dist", "idx", "nx", "ny", "nz"
    )


def knn(points: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """``neighbors``: the k nearest other points as (dist, idx, x, y, z), nearest first; see ``nearest``."""
    entry = F.struct("rank", "dist", "idx", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"))
    listed = nearest(points, k, block).groupBy("cloud_id", "point_idx").agg(F.sort_array(F.collect_list(entry)).alias("neighbors"))
    plain = F.transform("neighbors", lambda n: n.dropFields("rank"))
    found = points.select("cloud_id", "point_idx").join(listed, ["cloud_id", "point_idx"], "left")
    none = F.array().cast("array<struct<dist:double,idx:bigint,x:double,y:double,z:double>>")
    return found.select("cloud_id", "point_idx", F.coalesce(plain, none).alias("neighbors"))


def statistical_outliers(points: DataFrame, nb_neighbors: int, std_ratio: float, block: int = 2048) -> DataFrame:
    """Points whose mean distance to their neighbors (themselves counted as the first) is below
    the cloud's mean plus ``std_ratio`` sample deviations."""
    if nb_neighbors < 2 or std_ratio <= 0:
        raise ValueError("nb_neighbors must be at least 2 and std_ratio positive")
    k = nb_neighbors - 1

    def alone(idx: np.ndarray, xyz: np.ndarray) -> dict:
        row, _, dist = _nearest_alone(idx, xyz, k)
        at, n = np.unique(row, return_counts=True)
        return {"point_idx": idx[at], "total": np.bincount(row, dist, len(xyz))[at], "n": n}

    small, large = _by_size(points, block)
    near = _alone(small, alone, f"{_POINT}, total DOUBLE, n BIGINT")  # a row per point, not per neighbor
    if large is not None:
        near = near.unionByName(_nearest_large(large, k, block).select("cloud_id", "point_idx", F.col("dist").alias("total"), F.lit(1).cast("bigint").alias("n")))
    mean = near.groupBy("cloud_id", "point_idx").agg((F.sum("total") / (F.sum("n") + 1)).alias("mean_dist"))
    mean = stored(mean, "cloud-means")
    rule = mean.where("mean_dist > 0").groupBy("cloud_id").agg(
        (F.avg("mean_dist") + std_ratio * F.coalesce(F.stddev_samp("mean_dist"), F.lit(0.0))).alias("_limit")
    )
    keep = mean.join(rule, "cloud_id").where(
        (F.col("mean_dist") > 0) & (F.col("mean_dist") < F.col("_limit"))
    )
    return points.join(shuffled(keep.select("cloud_id", "point_idx", "mean_dist")), ["cloud_id", "point_idx"])


_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _spread_of_lists(points: DataFrame, near: DataFrame, radius: float) -> DataFrame:
    """``used`` and the covariances ``cxx`` to ``czz`` of points and the listed neighbors within ``radius``."""
    near = near.withColumn("neighbors", F.filter("neighbors", lambda n: n["dist"] <= radius))
    local = points.select("cloud_id", "point_idx", *XYZ).join(near, ["cloud_id", "point_idx"])
    n = (F.size("neighbors") + 1).cast("double")

    def total(f: Callable[[Column, Column, Column], Column]) -> Column:
        return F.aggregate("neighbors", F.lit(0.0), lambda s, p: s + f(p["x"], p["y"], p["z"])) + f(
            F.col("x"), F.col("y"), F.col("z")
        )

    mean = {c: total(lambda x, y, z, c=c: {"x": x, "y": y, "z": z}[c]) / n for c in XYZ}
    local = local.withColumns({f"m{c}": e for c, e in mean.items()})

    def cov(ab: str) -> Column:
        a, b = ab
        return total(
            lambda x, y, z: ({"x": x, "y": y, "z": z}[a] - F.col(f"m{a}"))
            * ({"x": x, "y": y, "z": z}[b] - F.col(f"m{b}"))
        ) / n

    return local.select("cloud_id", "point_idx", *XYZ, F.size("neighbors").alias("used"), *[cov(ab).alias(f"c{ab}") for ab in _PAIRS])


def normals(points: DataFrame, radius: float, max_nn: int, block: int = 2048) -> DataFrame:
    """Unit normal from the spread of the nearest ``max_nn`` points (itself included) within
    ``radius``; (0, 0, 1) below three points; turned toward the origin. ``used`` is the number of other points, ``residual``
    the variance along the normal (0 below three points). A small cloud's neighbors stay in its task, which gives a row per point."""
    k = max_nn - 1
    if k < 1:
        raise ValueError("max_nn must be at least 2")

    def alone(idx: np.ndarray, xyz: np.ndarray) -> dict:
        row, col, dist = _nearest_alone(idx, xyz, k)
        row, col = row[dist <= radius], col[dist <= radius]
        used = np.bincount(row, minlength=len(xyz))
        mean = np.stack([(np.bincount(row, xyz[col, i], len(xyz)) + xyz[:, i]) / (used + 1) for i in range(3)], axis=1)
        off, own = xyz[col] - mean[row], xyz - mean
        at = [("xyz".index(a), "xyz".index(b)) for a, b in _PAIRS]
        covs = [(np.bincount(row, off[:, i] * off[:, j], len(xyz)) + own[:, i] * own[:, j]) / (used + 1) for i, j in at]
        return {
            "point_idx": idx, **{c: xyz[:, i] for i, c in enumerate(XYZ)}, "used": used.astype(np.int32),
            **{f"c{ab}": v for ab, v in zip(_PAIRS, covs)},
        }

    small, large = _by_size(points, block)
    kinds = ", ".join(f"{c} DOUBLE" for c in XYZ), ", ".join(f"c{ab} DOUBLE" for ab in _PAIRS)
    local = _alone(small, alone, f"{_POINT}, {kinds[0]}, used INT, {kinds[1]}").where("cloud_id IS NOT NULL AND point_idx IS NOT NULL")
    if large is not None:
        local = local.unionByName(_spread_of_lists(large, knn(large, k, block), radius))

    @F.pandas_udf("struct<nx:double,ny:double,nz:double>")
    def smallest(
        xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series
    ) -> pd.DataFrame:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
        _, vec = np.linalg.eigh(m)
        return pd.DataFrame(vec[:, :, 0], columns=["nx", "ny", "nz"])

    local = local.withColumn("_v", smallest(*[F.col(f"c{ab}") for ab in _PAIRS]))
    toward = -(F.col("_v.nx") * F.col("x") + F.col("_v.ny") * F.col("y") + F.col("_v.nz") * F.col("z"))
    sign = F.when(toward < 0, -1.0).otherwise(1.0)
    enough = F.col("used") >= 2
    flat = {"nx": 0.0, "ny": 0.0, "nz": 1.0}
    along = [F.col(f"_v.n{a}") * F.col(f"_v.n{b}") * F.col(f"c{a}{b}") * (1 if a == b else 2) for a, b in _PAIRS]
    return local.select(
        "cloud_id", "point_idx", *XYZ,
        *[F.when(enough, F.col(f"_v.{c}") * sign).otherwise(v).alias(c) for c, v in flat.items()],
        "used", F.when(enough, sum(along[1:], along[0])).otherwise(0.0).alias("residual"),
    )
