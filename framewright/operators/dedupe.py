"""Near-duplicate search: similarity joins and transitive groups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import materialize, spread_by

_ROWS, _COPIES = 512, 16_384  # rows of a tile compared at once; copies of vectors sent on at once


def max_distance(threshold: float, bits: int = 64) -> int:
    """Most differing bits a pair with similarity ``threshold`` can have."""
    return int(math.floor((1 - threshold) * bits + 1e-9))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _band_masks(bits: int, bands: int) -> list[int]:
    cut = [round(i * bits / bands) for i in range(bands + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]


def _band_work(distinct: int, distance: int, bits: int, k: int) -> float:
    """Work per hash with ``k`` bands at once, in checks of bucket partners; a shuffled row costs about fifty."""
    return math.comb(distance + k, k) * (50 + distinct / 2 ** (bits * k / (distance + k)))


def _combination_size(distinct: int, distance: int, bits: int) -> int:
    """How many bands to require at once: least work for rows shuffled and bucket partners checked."""
    sizes = [k for k in range(1, bits - distance + 1) if k == 1 or math.comb(distance + k, k) <= 256]
    return min(sizes, key=lambda k: _band_work(distinct, distance, bits, k))


def _tiled_hash_pairs(uniq: DataFrame, distinct: int, d: int, bits: int, tile: int | None = None) -> DataFrame:
    """All pairs of blocks of hashes compared by bit counts in small strips: quadratic, but bounded in memory and spread over tasks."""
    blocks = math.ceil(distinct / (tile or max(4096, min(65536, distinct // 48))))
    home = F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int")
    rows = uniq.select("hash", home.alias("_h")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("hash", "_h", F.least("_h", "_o").alias("i"), F.greatest("_h", "_o").alias("j"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = (np.sort(pdf.loc[pdf["_h"] == n, "hash"].to_numpy()) for n in (i, j))
        found = []
        strip = max(1, (1 << 22) // max(1, len(right)))
        for at in range(0, len(left), strip):
            some = left[at : at + strip]
            r, c = np.nonzero(np.bitwise_count(some.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= d)
            a, b = some[r], right[c]
            keep = a < b if i == j else a != b
            found.append(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        share = 1 - np.bitwise_count((a ^ b).view(np.uint64)) / bits
        return pd.DataFrame({"hash_a": a, "hash_b": b, "similarity": share})

    return spread_by(rows, "i", "j").groupBy("i", "j").applyInPandas(match, "hash_a BIGINT, hash_b BIGINT, similarity DOUBLE")


def distinct_hashes(hashes: DataFrame) -> DataFrame:
    """``hash, copies, first_id``: equal hashes collapse before any join."""
    return hashes.groupBy("hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")
    )


def hash_pairs(
    hashes: DataFrame, threshold: float = 0.9, bits: int = 64, expected: int | None = None
) -> DataFrame:
    """Pairs ``hash_a < hash_b`` of distinct hashes with ``1 - distance/bits >= threshold``.

    With d+k bands, a pair at distance d or less agrees on at least k whole bands, so it meets in
    the bucket of some k bands. A pair is kept only in the first such bucket, so no duplicate
    removal follows. k grows with the number of hashes, which keeps buckets small at any size.
    Ids sharing one hash stay collapsed; ``distinct_hashes`` links them. Where d is a large part of the bits, bands are so short that
    buckets hold a fixed share of all hashes; then blocks of hashes are compared whole, in tiles.
    """
    d = max_distance(threshold, bits)
    if d >= bits:
        raise ValueError("threshold would accept every pair")
    uniq = hashes.where("hash IS NOT NULL").select("hash").distinct()
    n = expected or uniq.count()
    k = _combination_size(n, d, bits)
    if n >= 16384 and n / 16 < _band_work(n, d, bits, k):  # a check in a tile is some eight times cheaper, and each pair comes once
        return _tiled_hash_pairs(uniq, n, d, bits)
    masks = _band_masks(bits, d + k)
    combos = list(combinations(range(d + k), k))
    keys, must_differ = [], []
    for combo in combos:
        mask = sum(masks[i] for i in combo)
        keys.append(F.col("hash").bitwiseAND(F.lit(_signed(mask)).cast("bigint")))
        skipped = [_signed(masks[i]) for i in range(combo[-1]) if i not in combo]
        must_differ.append(F.array(*[F.lit(m).cast("bigint") for m in skipped]).cast("array<bigint>"))
    rows = uniq.select("hash", F.posexplode(F.array(*keys)).alias("combo", "part"))
    a = rows.select("combo", "part", F.col("hash").alias("hash_a"))
    b = rows.select("combo", "part", F.col("hash").alias("hash_b"))
    x = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    first = F.forall(F.get(F.array(*must_differ), F.col("combo")), lambda m: x.bitwiseAND(m) != 0)
    near = (F.col("hash_a") < F.col("hash_b")) & (F.bit_count(x) <= d)
    return (
        a.join(b, ["combo", "part"])
        .where(near)
        .where(first)
        .select("hash_a", "hash_b", (1 - F.bit_count(x) / bits).alias("similarity"))
    )


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Distinct vectors scaled to length 1: ``id`` (smallest of equal vectors), ``u, copies``.
    Zero vectors are similar to nothing and leave."""
    doubles = F.col("vector").cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, v: s + v * v))
    return (
        vectors.groupBy("vector")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("_norm", norm)
        .where(F.col("_norm") > 0)
        .select("id", F.transform(doubles, lambda v: v / F.col("_norm")).alias("u"), "copies")
    )


def cosine_pairs(
    vectors: DataFrame, threshold: float = 0.9, tile: int = 2048, forest: bool = False,
    expected: int | None = None,
) -> DataFrame:
    """Pairs ``a < b`` of distinct vectors with cosine similarity of at least ``threshold``.

    A metric join: each vector belongs to its nearest pivot, and is copied to every pivot of lower
    number whose cell may hold a partner (distance to it within twice the pair radius of its own).
    Cells are cut into tiles of bounded size, each one matrix product. ``forest=True`` returns
    only edges that connect what each tile connects, at most one per row, for grouping.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    unit = unit_vectors(vectors)
    n = expected or unit.count()
    n_pivots = max(1, min(1024, n // (4 * tile)))
    picked = unit.orderBy(F.md5(F.col("id").cast("string"))).limit(n_pivots).collect()  # <= 1024 rows
    pivots = np.array([r["u"] for r in picked], dtype=np.float64)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            whole, ids = np.stack(b["u"].to_numpy()), b["id"].to_numpy()
            for s in range(0, len(whole), _ROWS):
                u = whole[s : s + _ROWS]
                dist = np.sqrt(np.clip(2 - 2 * u @ pivots.T, 0, None))
                home = dist.argmin(axis=1)
                own = dist[np.arange(len(u)), home]
                near = dist <= own[:, None] + 2 * radius + 1e-6
                near &= np.arange(len(pivots))[None, :] <= home[:, None]
                near[np.arange(len(u)), home] = True
                row, cell = np.nonzero(near)
                for at in range(0, len(row), _COPIES):
                    r, c = row[at : at + _COPIES], cell[at : at + _COPIES]
                    yield pd.DataFrame({"id": ids[r + s], "u": [u[i] for i in r], "cell": c.astype(np.int32), "home": home[r] == c})

    cells = unit.select("id", "u").mapInPandas(
        assign, "id BIGINT, u ARRAY<DOUBLE>, cell INT, home BOOLEAN"
    )
    sizes = cells.groupBy("cell").agg(
        F.ceil(F.count_if("home") / tile).cast("int").alias("lb"),
        F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("rb"),
    )
    rows = cells.join(sizes, "cell")
    pick = F.xxhash64("id")
    left = rows.where("home").select(
        "cell", F.pmod(pick, "lb").cast("int").alias("ti"),
        F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("tj"), "id", "u", "home",
        F.lit(True).alias("is_left"),
    )
    right = rows.select(
        "cell", F.explode(F.sequence(F.lit(0), F.greatest("lb", F.lit(1)) - 1)).alias("ti"),
        F.pmod(pick, "rb").cast("int").alias("tj"), "id", "u", "home",
        F.lit(False).alias("is_left"),
    )

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "similarity": []})
        l, r = pdf[pdf["is_left"]], pdf[~pdf["is_left"]]
        if l.empty or r.empty:
            return empty
        lid, rid = l["id"].to_numpy(), r["id"].to_numpy()
        a, b = np.stack(l["u"].to_numpy()), np.stack(r["u"].to_numpy())
        home = r["home"].to_numpy()
        if forest:
            near = np.empty((len(a), len(b)), bool)
            for s in range(0, len(a), _ROWS):
                near[s : s + _ROWS] = _near(a[s : s + _ROWS] @ b.T, lid[s : s + _ROWS], rid, home, threshold)
            i, j = _branches(near)
            sim = np.einsum("nd,nd->n", a[i], b[j])
            return _spanning(pd.DataFrame({"a": np.minimum(lid[i], rid[j]), "b": np.maximum(lid[i], rid[j]), "similarity": sim}))
        parts = [empty]
        for s in range(0, len(a), _ROWS):
            sim = a[s : s + _ROWS] @ b.T
            i, j = np.nonzero(_near(sim, lid[s : s + _ROWS], rid, home, threshold))
            x, y = lid[i + s], rid[j]
            if len(x):
                parts.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "similarity": sim[i, j]}))
        return pd.concat(parts[1:], ignore_index=True) if len(parts) > 1 else empty

    both = spread_by(left.unionByName(right), "cell", "ti", "tj")
    return both.groupBy("cell", "ti", "tj").applyInPandas(
        match, "a BIGINT, b BIGINT, similarity DOUBLE"
    )


def _near(sim: np.ndarray, lid: np.ndarray, rid: np.ndarray, home: np.ndarray, threshold: float) -> np.ndarray:
    """Cells of a block of similarities that count: those of two vectors at home once, those of a visitor always."""
    return (sim >= threshold) & ~(home[None, :] & (lid[:, None] >= rid[None, :]))


def _branches(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of cells that join the same rows and columns as all that are set, at most one a row and column: every row and
    column is opened once, so that a tile of equal vectors never lists its pairs."""
    rows, cols, found = near.any(axis=1), near.any(axis=0), []
    for start in range(len(near)):
        todo = [(True, start)] if rows[start] else []
        rows[start] = False
        while todo:
            is_row, at = todo.pop()
            fresh = np.flatnonzero(near[at] & cols) if is_row else np.flatnonzero(near[:, at] & rows)
            (cols if is_row else rows)[fresh] = False
            fixed = np.full(len(fresh), at)
            found.append((fixed, fresh) if is_row else (fresh, fixed))
            todo += [(not is_row, k) for k in fresh.tolist()]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


def _spanning(pairs: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one tile that join two parts not joined by earlier ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
        ra, rb = root(a), root(b)
        keep.append(ra != rb)
        parent[ra] = rb
    return pairs[np.array(keep, dtype=bool)]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of an edge.

    Alternating star contraction: each round re-hangs neighbors on the smallest one, first those
    above a node, then those below. Node degrees are handled by partial aggregates and skew-aware
    joins; a round's edges go to reliable storage.
    """
    cur = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    mark = None
    while True:
        both = cur.union(cur.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        big = both.where(F.col("v") > F.col("u")).join(least, "u")
        cur = big.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = cur.groupBy("u").agg(F.min("v").alias("m"))
        small = cur.join(least, "u")
        cur = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        cur = materialize(cur)
        now = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def duplicate_groups(members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per member of a group of two or more.

    ``members`` is ``id, key`` (key: a hash or the representative of equal vectors), ``edges``
    pairs of keys. The representative is the smallest id. Members stay rows: a group may be large.
    """
    comp = components(edges).select(F.col("node").alias("key"), "component")
    tagged = members.join(comp, "key", "left").select(
        "id", F.coalesce("component", "key").alias("component")
    )
    groups = (
        tagged.groupBy("component")
        .agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    return tagged.join(groups, "component").select(
        "representative",
        F.col("id").alias("member"),
        "group_size",
        (F.col("id") == F.col("representative")).alias("is_representative"),
    )


def removals(groups: DataFrame) -> DataFrame:
    return groups.where(~F.col("is_representative")).select("member", "representative")


def report(groups: DataFrame, max_groups: int = 50) -> DataFrame:
    """Largest groups first, with totals over all of them and whether some are not shown."""
    heads = groups.where("is_representative").select("representative", "group_size")
    totals = heads.agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.coalesce(F.sum(F.col("group_size") - 1), F.lit(0)).alias("total_duplicates"),
    ).withColumn("_one", F.lit(1))
    top = heads.orderBy(F.desc("group_size"), "representative").limit(max_groups)
    return (
        top.withColumn("_one", F.lit(1))
        .join(totals, "_one")
        .withColumn("truncated", F.col("total_groups") > max_groups)
        .drop("_one")
    )
