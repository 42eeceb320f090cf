"""Manifest of a dataset: a SHA-256 tree that keeps hash states, so that a changed leaf resumes the state before its slot."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import in_order, lower_ascii, small_side, stored

ARITY = 8
#: Levels of the tree that one group covers; a group has up to ARITY ** DEPTH nodes.
DEPTH = 4
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "ARRAY<STRUCT<left: STRING, right: STRING>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**values: Column) -> Column:
    """Digest of a row; ``values`` replace columns."""
    return F.sha2(F.concat(*[field(values.get(c, F.col(c))) for c in LEAF]), 256)


def lowered(docs: DataFrame) -> tuple[Column, Column]:
    """Which rows are tampered with, and their text after it."""
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, lower_ascii(docs["text"])


class Tree:
    """Levels above some nodes. ``slots[k][i]``: hash state before the child, and the siblings left and right of it."""

    def __init__(self, nodes: list[bytes], depth: int | None) -> None:
        """Up to one node, or over exactly ``depth`` levels."""
        self.slots: list[list[tuple]] = []
        while len(self.slots) < depth if depth is not None else len(nodes) > 1:
            level, parents = [], []
            for first in range(0, len(nodes), ARITY):
                run, state = nodes[first : first + ARITY], hashlib.sha256()
                for j, child in enumerate(run):
                    level.append((state.copy(), b"".join(run[:j]), b"".join(run[j + 1 :])))
                    state.update(child)
                parents.append(state.hexdigest().encode())
            self.slots.append(level)
            nodes = parents
        self.root = nodes[0]

    def path(self, i: int) -> list[tuple]:
        """Slots from node ``i`` to the root."""
        return [level[i // ARITY**k] for k, level in enumerate(self.slots)]


def resumed(path: list[tuple[str, str]]) -> list[tuple]:
    """Slots of a path that was kept as its siblings."""
    return [(hashlib.sha256(left.encode()), left.encode(), right.encode()) for left, right in path]


def fold(node: bytes, path: list[tuple]) -> bytes:
    """Root above ``node``: in each parent the state before its slot takes the node and the right siblings only."""
    for before, _, right in path:
        state = before.copy()
        state.update(node)
        state.update(right)
        node = state.hexdigest().encode()
    return node


def _tree(nodes: pd.DataFrame, depth: int) -> Tree:
    """Tree of one group; if its tree has several groups, all of them have the same depth."""
    several = nodes["n"].iloc[0] > ARITY**depth
    return Tree([d.encode() for d in nodes["digest"]], depth if several else None)


def _grouped(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("group", F.expr(f"pos div {ARITY**depth}"))


def roots(nodes: DataFrame, depth: int) -> DataFrame:
    """``tree, pos, n, digest`` of the groups' roots, from ``tree, pos, n, digest``."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        row = part.iloc[0]
        top = _tree(part, depth).root.decode()
        return pd.DataFrame({"tree": [row["tree"]], "pos": [row["group"]], "n": [-(-row["n"] // ARITY**depth)], "digest": [top]})

    grouped = _grouped(nodes.select("tree", "pos", "n", "digest"), depth).groupBy("tree", "group")
    return grouped.applyInPandas(run, "tree STRING, pos LONG, n LONG, digest STRING")


def climbed(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes, their groups' roots, and so on until every tree has one node; each step is a few thousandths of the last."""
    steps = [nodes]
    while True:
        steps.append(stored(roots(steps[-1], depth), "manifest-roots"))
        if (steps[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return steps


def descended(steps: list[DataFrame], above: DataFrame, depth: int) -> DataFrame:
    """``tree, pos, path`` of the nodes of the first step; ``above`` has those of the last."""

    def run(part: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        tree = _tree(part, depth)
        rest = [(p["left"], p["right"]) for p in top["path"].iloc[0]]
        paths = [[(left.decode(), right.decode()) for _, left, right in tree.path(i)] + rest for i in range(len(part))]
        return pd.DataFrame({"tree": part["tree"].to_numpy(), "pos": part["pos"].to_numpy(), "path": paths})

    for nodes in reversed(steps[:-1]):
        left = _grouped(nodes.select("tree", "pos", "n", "digest"), depth).groupBy("tree", "group")
        right = above.withColumnRenamed("pos", "group").groupBy("tree", "group")
        above = stored(left.cogroup(right).applyInPandas(run, f"tree STRING, pos LONG, path {_PATH}"), "manifest-paths")
    return above


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row; see ``prove``.

    Leaves of a language ascend by id (null first, ties by digest, equal rows in any order); null is a language. A tree is cut
    into groups of ``ARITY ** depth`` nodes, whose roots are nodes of the next step, so no task sees more than a group and
    a hot language is as many groups as its rows need. Null and empty fields have different digests. Very long texts are
    hashed where they are read and do not travel. An empty table gives no rows. Columns outside ``LEAF`` are not looked at.
    """
    tampered, text = lowered(docs)
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id"),
        F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang"))).alias("tree"),
        leaf_digest().alias("digest"), F.when(tampered, leaf_digest(text=text)).alias("tampered"),
    )
    leaves = in_order(stored(rows, "manifest-leaves"), ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest")], "manifest-order")
    return prove(leaves, depth).select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", "root",
                                "proof_sha256", "folded_root", "verified")


def prove(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Proof and fold of every leaf: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``leaves``: ``id`` (string), ``tree`` (not null; trees follow each other by it), ``pos, n`` in the tree, ``digest``, and the digest ``tampered``
    or null. The proof is the digest of all siblings on the way to the root, the folded root what the tampered, else the own digest
    gives with these siblings.
    """
    steps = climbed(leaves, depth)
    subroots = steps[-1].select("tree", F.col("digest").alias("subroot"))
    tops = in_order(subroots.withColumnsRenamed({"tree": "name", "subroot": "digest"}), [], [F.col("name")], "manifest-tops")
    top_steps = climbed(tops.withColumn("tree", F.lit("")), depth)
    last = top_steps[-1]
    root = next(iter([r["digest"] for r in last.select("digest").take(1)]), "")
    above = descended(top_steps, last.select("tree", "pos", F.array().cast(_PATH).alias("path")), depth)
    above = above.drop("tree").join(tops.select("pos", F.col("name").alias("tree")), "pos").select("tree", F.lit(0).cast("long").alias("pos"), "path")
    above = descended(steps[1:], above, depth)
    side, _ = small_side(subroots)
    above = above.join(side, "tree").withColumnRenamed("pos", "group")

    def run(part: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        tree = _tree(part, depth)
        rest = resumed([(p["left"], p["right"]) for p in top["path"].iloc[0]])
        beyond = b"".join(left + right for _, left, right in rest)
        proofs, folded, known = [], [], {}
        for i, (digest, tampered) in enumerate(zip(part["digest"], part["tampered"])):
            path = tree.path(i)
            proof = hashlib.sha256(b"".join(left + right for _, left, right in path))
            proof.update(beyond)
            proofs.append(proof.hexdigest())
            node = fold((tampered if isinstance(tampered, str) else digest).encode(), path)
            if node not in known:
                known[node] = fold(node, rest).decode()
            folded.append(known[node])
        return pd.DataFrame({
            "id": part["id"].to_numpy(), "leaf": part["digest"].to_numpy(), "subroot": top["subroot"].iloc[0], "root": root,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        })

    left = _grouped(leaves.select("id", "tree", "pos", "n", "digest", "tampered"), depth).groupBy("tree", "group")
    return left.cogroup(above.groupBy("tree", "group")).applyInPandas(
        run, "id STRING, leaf STRING, subroot STRING, root STRING, proof_sha256 STRING, folded_root STRING, verified BOOLEAN"
    )
