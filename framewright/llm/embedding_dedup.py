"""Embedding near-duplicates: sorted passes over concatenated random hashes, then exact blocks in the groups that these link."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import Forest, small_side, stored, thinned
from framewright.operators.dedupe import components
from framewright.session import spread_by


def unit_vectors(vectors: pd.Series) -> np.ndarray:
    """Double-precision unit vectors of equal length; infinite rows cannot occur."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # tiny and huge components stay in range when squared
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def agreement(distance: float, width: float) -> float:
    """Chance that one hash, a cell of ``width`` on a random line, holds two points at a distance."""
    u = width / distance
    return math.erf(u / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * u) * (1 - math.exp(-u * u / 2))


def pass_keys(vectors: DataFrame, passes: range, hashes: int, width: float, seed: int) -> DataFrame:
    """``dim, pass, key, vec_id, scale, small``: for every pass a sort key, and the vector in bytes.

    A key has four bits for each of ``hashes`` random projections: the cell of ``width`` that the vector falls in, counted from a
    random offset. Unlike signs, cells also part vectors that share a direction.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines: dict[int, list] = {}
        for batch in batches:
            for dim, rows in batch.groupby("dim", sort=False):
                if dim not in lines:
                    draws = [np.random.default_rng([seed, int(dim), p]) for p in passes]
                    lines[dim] = [(d.standard_normal((int(dim), hashes)), d.uniform(0, width, hashes)) for d in draws]
                x = unit_vectors(rows["embedding"])
                scale = np.abs(x).max(axis=1) / 127
                small = [v.tobytes() for v in np.rint(x / scale[:, None]).astype(np.int8)]
                for p, (line, offset) in zip(passes, lines[dim]):
                    cell = (np.clip(np.floor((x @ line + offset) / width), -8, 7) + 8).astype(np.uint8)
                    yield pd.DataFrame({
                        "dim": rows["dim"], "pass": np.int32(p), "key": [k.tobytes() for k in cell[:, ::2] << 4 | cell[:, 1::2]],
                        "vec_id": rows["vec_id"], "scale": scale.astype(np.float32), "small": small,
                    })

    return vectors.mapInPandas(run, "dim INT, pass INT, key BINARY, vec_id LONG, scale FLOAT, small BINARY")


class Window:
    """Neighbours in one sort order: links, and how surely each row has met all that it links with."""

    def __init__(self, window: int, threshold: float, agree: float, begins: bool) -> None:
        self.window, self.threshold, self.agree = window, threshold, agree
        self.ids, self.keys, self.x, self.scale = np.empty(0, np.int64), None, None, np.empty(0)
        self.first, self.begins = 0, begins  # rows before ``first`` have their depth; does the order begin here

    def add(self, ids: np.ndarray, keys: np.ndarray, x: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of new rows with the ``window`` rows before each that may reach the threshold, given the rounding to bytes."""
        fresh = len(self.ids)
        if fresh:
            ids, keys = np.concatenate([self.ids, ids]), np.concatenate([self.keys, keys])
            x, scale = np.concatenate([self.x, x]), np.concatenate([self.scale, scale])
        self.ids, self.keys, self.x, self.scale = ids, keys, x, scale
        margin = float(scale.max()) * math.sqrt(x.shape[1]) * 1.01
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(fresh, len(ids), 256):
            hi, low = min(lo + 256, len(ids)), max(0, lo - self.window)
            i, j = np.nonzero(x[lo:hi] @ x[low:hi].T >= self.threshold - margin)
            i, j = i + lo, j + low
            near = (j < i) & (i - j <= self.window)
            left.append(ids[i[near]]), right.append(ids[j[near]])
        return np.concatenate(left), np.concatenate(right)

    def covered(self, ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and log chances to have missed a link, of the rows whose neighbours on both sides are known; drops what is done.

        A row that shares fewer than L hashes with the rows ``window`` places before and after it meets all that share L with
        it. ``ends``: the order ends here; otherwise the last rows wait.
        """
        n, w, m = len(self.ids), self.window, self.keys.shape[1]
        shared = np.zeros(max(0, n - w), np.int64)
        if n > w:
            other = self.keys[w:] != self.keys[:-w]
            shared = np.where(other.any(axis=1), other.argmax(axis=1), m)
        after = np.concatenate([shared, np.full(min(n, w), -1 if ends else m)])
        before = np.concatenate([np.full(min(n, w), -1 if self.begins else m), shared])
        last = n if ends else max(self.first, n - w)
        depth = np.maximum(after, before)[self.first : last] + 1
        missed = np.where(depth <= m, np.log1p(-np.minimum(self.agree**depth, 1 - 1e-9)), 0.0)
        ids = self.ids[self.first : last]
        drop = max(0, last - w)
        self.ids, self.keys, self.x, self.scale = self.ids[drop:], self.keys[drop:], self.x[drop:], self.scale[drop:]
        self.first, self.begins = last - drop, self.begins and not drop
        return ids, missed


def neighbours(keyed: DataFrame, window: int, threshold: float, agree: float, parts: int) -> DataFrame:
    """``a, b, missed``: links that join parts not joined by earlier ones of the task; and, with null in ``b``, log chances of a row ``a``
    to have missed a link in a pass.

    The rows are range-partitioned by (dimension, pass, key), so neighbours in the order are neighbours in a task. Rows at a task's border,
    where the order goes on unseen, count as not covered by the pass.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, at, state = Forest(), None, None

        def rows(a, b, missed) -> pd.DataFrame:
            return pd.DataFrame({"a": np.asarray(a, np.int64), "b": pd.array(b, "Int64"), "missed": missed})

        def done(ends: bool) -> pd.DataFrame:
            ids, missed = state.covered(ends)
            return rows(ids, [None] * len(ids), missed)

        for batch in batches:
            for key, part in batch.groupby(["dim", "pass"], sort=False):
                if key != at:
                    if state is not None:
                        yield done(True)
                    state = Window(window, threshold, agree, at is not None)
                    at = key
                packed = np.frombuffer(b"".join(part["key"]), np.uint8).reshape(len(part), -1)
                cells = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(part), -1)
                scale = part["scale"].to_numpy(np.float32)
                x = np.frombuffer(b"".join(part["small"]), np.int8).reshape(len(part), -1) * scale[:, None]
                a, b = state.add(part["vec_id"].to_numpy(), cells, x, scale)
                kept = [(p, q) for p, q in zip(a.tolist(), b.tolist()) if p != q and forest.add(p, q)]
                yield rows([min(k) for k in kept], [max(k) for k in kept], np.zeros(len(kept)))
                yield done(False)
        if state is not None:
            yield done(False)

    order = ("dim", "pass", "key", "vec_id")
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(run, "a LONG, b LONG, missed DOUBLE")


def window_links(
    classes: DataFrame, threshold: float, window: int, passes: int, rounds: int, miss: float, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` found in sorted passes, and the vectors ``vec_id`` that these do not cover.

    ``classes``: ``vec_id, dim, embedding``. After ``passes`` passes the vectors go out whose chance to have missed a link at the
    threshold is at most ``miss``, by what their keys shared with those around them. The others, as in a dense group, go on with
    further projections, for ``rounds`` rounds at most. A pair is covered if one of its vectors is.
    """
    spark = classes.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    distance = math.sqrt(2 - 2 * threshold)
    width = 4 * distance
    agree = agreement(distance, width)
    left, found, sums = classes.select("vec_id", "dim", "embedding"), None, None
    n = left.count()
    for k in range(rounds):
        if n < 2:
            break
        hashes = 2 * math.ceil(min(40, max(8, 2 + math.log(n) / math.log(1 / agreement(2 * distance, width)))) / 2)
        keyed = pass_keys(left, range(k * passes, (k + 1) * passes), hashes, width, seed)
        parts = max(1, min(most, n * passes // (32 * window)))
        seen = stored(neighbours(keyed, window, threshold, agree, parts), "vec-windows")
        links = seen.where("b IS NOT NULL").select("a", "b").distinct()
        found = links if found is None else found.unionByName(links)
        now = seen.where("b IS NULL").groupBy(F.col("a").alias("vec_id")).agg(F.sum("missed").alias("missed"))
        if sums is not None:
            now = now.join(sums.withColumnRenamed("missed", "earlier"), "vec_id").select("vec_id", (F.col("missed") + F.col("earlier")).alias("missed"))
        sums = stored(now.where(F.col("missed") > math.log(miss)), "vec-open")
        left = stored(classes.select("vec_id", "dim", "embedding").join(sums.select("vec_id"), "vec_id"), "vec-left")
        n = left.count()
    if found is None:
        found = spark.createDataFrame([], "a LONG, b LONG")
    return found, left.select("vec_id")


def grouped(classes: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """Members of the groups (``vec_id, component``) with ``part``: the group, or for groups up to ``block`` one that several share."""
    sizes = stored(groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "vec-groups")
    few = sizes.where(F.col("n") <= block).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = -1 - F.pmod(F.xxhash64("component"), F.lit(max(1, few // block)))
    sizes = sizes.select("component", F.when(F.col("n") <= block, shared).otherwise(F.col("component")).alias("part"))
    return classes.join(groups.join(sizes, "component").select("vec_id", "part"), "vec_id")


def tile_links(members: DataFrame, threshold: float, block: int | None, window: int) -> DataFrame:
    """``vec_id, linked, head, whole``: per block pair and vector linked in it, the weight of the vectors it links with there and the
    smallest id it is connected to there, and whether its part has no other block pair. Vectors without a link give no row.

    ``members``: ``part, vec_id, dim, copies, embedding``. The vectors of a part and length are dealt to blocks, and a task compares two of
    them, so every pair of a part is compared once. The product is in single precision; pairs closer to the threshold than its error
    are compared again in double precision. By default a block has 16 MB of floats at most, and a part a dozen blocks at least
    as soon as these hold 1,024 vectors.
    """
    sizes = members.groupBy("part", "dim").agg(F.count(F.lit(1)).alias("n"))
    most = F.lit(float(block)) if block else F.greatest(
        F.lit(1.0), F.least(F.lit(float(1 << 22)) / F.col("dim"), F.greatest(F.lit(1024.0), F.col("n") / 12))
    )
    sizes, _ = small_side(stored(sizes.select("part", "dim", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "vec-blocks"))
    rows = members.join(sizes, ["part", "dim"]).withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "part", "dim", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "vec_id", "copies", "embedding",
        (F.col("blocks") == 1).alias("whole"),
    )

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, dim, i, j = (int(k) for k in key)
        left = pdf[pdf["mine"] == i]
        right = pdf[pdf["mine"] == j] if i != j else left
        if left.empty or right.empty:
            return pd.DataFrame({"vec_id": [], "linked": [], "head": [], "whole": []}).astype({"vec_id": "int64", "linked": "int64", "head": "int64", "whole": bool})
        x = unit_vectors(left["embedding"])
        y = unit_vectors(right["embedding"]) if i != j else x
        shift = len(x) if i != j else 0
        nodes = left if i == j else pd.concat([left, right])
        ids, copies = nodes["vec_id"].to_numpy(), nodes["copies"].to_numpy()
        linked, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        low, low_t = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
        margin = (dim + 8) * 2.0**-23
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(x), window):
            hi = min(lo + window, len(x))
            for first in range(lo if i == j else 0, len(y), 4096):
                last = min(first + 4096, len(y))
                sim = low[lo:hi] @ low_t[:, first:last]
                at = np.flatnonzero(sim >= np.float32(threshold - margin))
                if not len(at):
                    continue
                a, b = lo + at // (last - first), first + at % (last - first)
                sure = sim.ravel()[at] >= threshold + margin
                if i == j:
                    above = b > a
                    a, b, sure = a[above], b[above], sure[above]
                doubt = np.flatnonzero(~sure)
                for k in range(0, len(doubt), 16_384):
                    some = doubt[k : k + 16_384]
                    sure[some] = np.einsum("ij,ij->i", x[a[some]], y[b[some]]) >= threshold
                a, b = a[sure], b[sure] + shift
                if not len(a):
                    continue
                linked[lo:hi] += np.bincount(a - lo, copies[b], hi - lo).astype(np.int64)
                linked[first + shift : last + shift] += np.bincount(b - first - shift, copies[a], last - first).astype(np.int64)
                apart = label[a] != label[b]
                if apart.any():
                    waiting.append((a[apart], b[apart]))
                if sum(len(w[0]) for w in waiting) > 100_000:
                    label = united(label, waiting)
                    waiting.clear()
        label = united(label, waiting)
        heads = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(heads, label, ids)
        return pd.DataFrame({"vec_id": ids, "linked": linked, "head": heads[label], "whole": bool(pdf["whole"].iloc[0])})[linked > 0]

    return spread_by(rows, "part", "dim", "i", "j").groupBy("part", "dim", "i", "j").applyInPandas(
        compare, "vec_id LONG, linked LONG, head LONG, whole BOOLEAN"
    )


def united(label: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The labels after the parts of linked places are joined; a part's label is its first place."""
    if not links:
        return label
    a, b = (np.concatenate(side) for side in zip(*links))
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            return label
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(over := up[up], up):
            up = over
        label = up[label]


def near_duplicates(
    embeddings: DataFrame,
    threshold: float = 0.95,
    window: int = 128,
    passes: int = 10,
    rounds: int = 8,
    miss: float = 0.001,
    block: int | None = None,
    seed: int = 11,
) -> DataFrame:
    """One row per vector row: ``vec_id, n_links, component_id, kept``.

    Equal vectors collapse first. Each pass sorts the vectors by its own concatenated random hashes and compares each with the
    ``window`` rows before it; links of all passes are united to groups. Passes go on until a link at the threshold is missed with
    a chance of ``miss`` at most, see ``window_links``; vectors that stay open after ``rounds * passes`` passes are compared with each other
    in blocks. All pairs of a group are then compared exactly in blocks, so a group larger than a window loses no link, and
    what only came together by rounding falls apart again.

    Null and zero vectors and those with null or non-finite components link with nothing. Vectors of different length
    do not link. Repeated ids with different vectors stay separate rows of one vertex; a null id links with nothing.
    An empty table gives an empty result. Columns other than ``vec_id, embedding`` are not looked at.
    """
    # Floats stay floats while they are moved; every comparison is in double precision.
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("embedding").isNotNull() & ~F.coalesce(wrong, F.lit(True)) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    signed = F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind))  # -0.0 is 0.0
    good = rows.where(fine).select("vec_id", signed.alias("embedding"), F.md5(F.to_json(signed)).alias("same"))
    classes = good.groupBy("same").agg(
        F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")
    )
    classes = stored(classes.select(
        "same", F.monotonically_increasing_id().alias("vec_id"), "head", "copies", "embedding", F.size("embedding").alias("dim")
    ), "vec-classes")
    plain = classes.drop("same", "head")
    near, left = window_links(plain, threshold, window, passes, rounds, miss, seed)
    rest = stored(tile_links(plain.join(left, "vec_id").withColumn("part", F.lit(0).cast("long")), threshold, block, 256), "vec-rest")
    near = near.unionByName(rest.where("head < vec_id").select(F.col("head").alias("a"), F.col("vec_id").alias("b")).distinct())
    groups = stored(components(thinned(near, "a")).select(F.col("node").alias("vec_id"), "component"), "vec-near")
    tiles = stored(tile_links(grouped(plain, groups, 512), threshold, block, 256), "vec-tiles")
    found = tiles.where("whole").select("vec_id", F.col("head").alias("component"))
    links = stored(tiles.where("NOT whole AND head < vec_id").select(F.col("head").alias("a"), F.col("vec_id").alias("b")).distinct(), "vec-links")
    if not links.isEmpty():
        found = found.unionByName(components(thinned(links, "a")).select(F.col("node").alias("vec_id"), "component"))
    members = stored(classes.join(found, "vec_id").select("vec_id", "component", "head"), "vec-members")
    linked = tiles.groupBy("vec_id").agg(F.sum("linked").alias("linked"))
    lowest = members.groupBy("component").agg(F.min("head").alias("component_id"))
    of_class = members.select("vec_id", "component").join(lowest, "component").join(linked, "vec_id", "left").select(
        "vec_id", "component_id", "linked"
    )
    of_class = classes.select("same", "vec_id", "head", "copies").join(of_class, "vec_id", "left").select(
        "same", F.coalesce("component_id", "head").alias("component_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    key = F.when(fine, F.md5(F.to_json(signed)))
    out = rows.select("vec_id", key.alias("same")).join(of_class, "same", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
