"""Linear octree: the points of a cloud in Morton order, cut into leaves of about equal count, and pairs of leaves in reach.

Leaves follow the counts and not a fixed grid, so a dense region is many small leaves and an empty one none. Every leaf carries
the tight box of its points; whatever the order puts together, the boxes decide which leaves can hold neighbors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.cloud import XYZ
from framewright.operators.ranking import range_rank
from framewright.session import materialize

#: Bits of an axis in each of the two sort keys.
BITS = 21
_BOX = ("x0", "y0", "z0", "x1", "y1", "z1")
_FAN = 3  # log2 of the children of a node


def _spread(v: Column) -> Column:
    """The 21 low bits, two zero bits after each."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _morton(cells: list[Column]) -> Column:
    x, y, z = (_spread(c) for c in cells)
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def leaves(points: DataFrame, size: int) -> DataFrame:
    """``points`` with ``leaf``, numbered from 0 in each cloud; a leaf holds between half of ``size`` and ``size`` rows.

    Two Morton codes of 21 bits an axis order the points to a 4e12th of the cloud's extent. Points in one cell of that follow
    each other in any order.
    """
    span = points.groupBy("cloud_id").agg(
        *[F.min(c).alias(f"_{c}") for c in XYZ], F.greatest(*[F.max(c) - F.min(c) for c in XYZ]).alias("_extent")
    )
    cells = [F.floor((F.col(c) - F.col(f"_{c}")) / F.nullif("_extent", F.lit(0.0)) * float((1 << 2 * BITS) - 1)) for c in XYZ]
    cells = [F.coalesce(c, F.lit(0)).cast("bigint") for c in cells]
    low = F.lit((1 << BITS) - 1)
    coded = points.join(span, "cloud_id").withColumns({
        "_high": _morton([F.shiftright(c, BITS) for c in cells]), "_low": _morton([c.bitwiseAND(low) for c in cells]),
    }).select(*points.columns, "_high", "_low")
    ranked = range_rank(coded, ["cloud_id"], [F.col("_high"), F.col("_low")], "_pos", "_n")
    count = F.ceil(F.col("_n") / size)
    return ranked.withColumn("leaf", F.expr("_pos") * count).withColumn("leaf", F.floor(F.col("leaf") / F.col("_n")).cast("bigint")).drop(
        "_high", "_low", "_pos", "_n"
    )


def packed(points: DataFrame) -> DataFrame:
    """One row per leaf: ``cloud_id, leaf``, its box, and as bytes ``xyz`` of its points, how many ``ids`` each has, the ids, and the weights.

    ``points``: ``cloud_id, leaf, x, y, z, ids (ARRAY<BIGINT>), weight``.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        xyz = part[list(XYZ)].to_numpy(np.float64)
        lens = part["ids"].map(len).to_numpy(np.int64)
        box = dict(zip(_BOX, [*xyz.min(axis=0), *xyz.max(axis=0)]))
        ids = np.concatenate([np.asarray(i, np.int64) for i in part["ids"]])
        return pd.DataFrame([{
            "cloud_id": key[0], "leaf": key[1], **box, "xyz": xyz.tobytes(), "lens": lens.tobytes(), "ids": ids.tobytes(),
            "weights": part["weight"].to_numpy(np.int64).tobytes(),
        }])

    kinds = ", ".join(f"{c} DOUBLE" for c in _BOX)
    return points.groupBy("cloud_id", "leaf").applyInPandas(
        run, f"cloud_id BIGINT, leaf BIGINT, {kinds}, xyz BINARY, lens BINARY, ids BINARY, weights BINARY"
    )


def _apart(q: str, c: str) -> Column:
    """Squared distance of two boxes."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{c}{a}0") - F.col(f"{q}{a}1"), F.col(f"{q}{a}0") - F.col(f"{c}{a}1")) for a in XYZ]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def leaf_pairs(boxes: DataFrame) -> DataFrame:
    """``cloud_id, q, c``: leaves q and the leaves c, itself included, whose box lies within ``reach`` of q's box.

    ``boxes``: ``cloud_id, leaf``, the box and ``reach``. The pairs descend from the root: eight leaves, then eight nodes, share a node with a
    box around all and the largest reach, and only pairs of nodes in reach are opened, so a cloud of any size never lists the
    pairs of all its leaves.
    """
    last = boxes.agg(F.max("leaf")).first()[0] or 0
    depth = math.ceil(math.log(last + 1, 1 << _FAN)) if last else 0
    around = [*[F.min(c).alias(c) for c in _BOX[:3]], *[F.max(c).alias(c) for c in _BOX[3:]], F.max("reach").alias("reach")]

    def nodes(level: int) -> DataFrame:
        at = boxes.withColumn("node", F.shiftright("leaf", _FAN * level))
        return at.groupBy("cloud_id", "node").agg(*around)

    def side(level: int, name: str) -> DataFrame:
        own = nodes(level)
        return own.select(
            F.col("cloud_id"), F.col("node").alias(name), F.shiftright("node", _FAN).alias(f"{name}_up"),
            *[F.col(c).alias(f"{name}_{c}") for c in (*_BOX, "reach")],
        )

    pairs = nodes(depth).select("cloud_id", F.col("node").alias("q"), F.col("node").alias("c"))
    for level in reversed(range(depth)):
        up = pairs.withColumnsRenamed({"q": "q_up", "c": "c_up"})
        near = _apart("q_", "c_") <= F.col("q_reach") * F.col("q_reach") * (1 + 1e-9)
        pairs = up.join(side(level, "q"), ["cloud_id", "q_up"]).join(side(level, "c"), ["cloud_id", "c_up"]).where(near).select("cloud_id", "q", "c")
        pairs = materialize(pairs)
    return pairs


def meetings(pairs: DataFrame, most: int = 32) -> DataFrame:
    """``cloud_id, q, chunk, chunks, leaf, is_query``: a leaf and at most about ``most`` of its partners are one chunk."""
    sizes = pairs.groupBy("cloud_id", "q").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("chunks"))
    partners = pairs.join(sizes, ["cloud_id", "q"]).select(
        "cloud_id", "q", F.pmod(F.xxhash64("c"), "chunks").cast("int").alias("chunk"), "chunks", F.col("c").alias("leaf"), F.lit(False).alias("is_query")
    )
    own = sizes.select(
        "cloud_id", "q", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks", F.col("q").alias("leaf"), F.lit(True).alias("is_query")
    )
    return partners.unionByName(own)
