"""Exact Jaccard join of word n-gram sets: universe partition, pigeonhole, one-deletion neighbourhoods."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import BROADCAST_ROWS, small_side, stored, thinned, whole_row
from framewright.operators.dedupe import components

#: Cost model of the allocation: documents of a size band that meet in one index, and the chance that a shingle of one also
#: stands in another that has nothing to do with it.
BAND_ROWS, SHARED = 1e6, 0.005
#: Sizes of one band differ by this factor at most.
BAND = 1.25
#: Up to so many shared index keys (two numbers each, some 100 MB) the keys are filtered by broadcast.
SHARED_KEYS = 3_000_000
#: Up to so many classes that share an index key or an element are compared pair by pair.
FEW = 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle, no words none.

    A-Z is lower-cased and words are split at ASCII white space only, which is what bytes do."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


@lru_cache(maxsize=4096)
def band_of(index: int) -> tuple[int, int]:
    """Smallest and largest set size of a band."""
    if index == 0:
        return 1, 1
    low = band_of(index - 1)[1] + 1
    return low, max(low, math.floor(low * BAND))


@lru_cache(maxsize=65_536)
def bands_for(size: int, percent: int) -> tuple[int, ...]:
    """Bands in which a set of this size meets its partners: its own, and those of smaller partners that are large enough."""
    least, index, out = -(-percent * size // 100), 0, []
    while band_of(index)[0] <= size:
        if band_of(index)[1] >= least:
            out.append(index)
        index += 1
    return tuple(out)


#: Numbers of segments with deletions, and of segments that may be skipped, among which the allocation chooses.
CHOICES = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)


@lru_cache(maxsize=4096)
def allocation(index: int, percent: int) -> tuple[int, int, int]:
    """(segments, segments with one-deletion neighbourhoods, segments that may be skipped) of a band.

    Sets of sizes a <= b that link differ in at most a * (1 - t) / t elements; H is that for the largest a. An exact
    segment fails by one difference, one with deletions by two, so with ``m + k`` or more than H at least one matches, and
    ``skip`` more match if the numbers are raised accordingly. Among the choices the cheapest is taken: index rows
    of a set, plus expected chance meetings of equal segments, and of empty ones if a set has more of them than it may skip.
    """
    low, high = band_of(index)
    most = high * (100 - percent) // percent
    if most == 0:
        return 1, 0, 0
    best = (math.inf, 1, 0, 0)
    for skip in (c for c in CHOICES if c <= most + 1):
        for k in {*(c for c in CHOICES if c <= most + 1), (most + 1) // 2, most // 2 + 1, most + 1}:
            m = most + 1 + skip if k <= skip else max(most + 1 + 2 * skip - k, k)
            tokens = low / m
            rows = (m - k) + k * (1 + tokens)
            chance = (m - k) * SHARED**tokens + k * (1 + tokens) * SHARED ** max(tokens - 1, 0)
            none = (m - k) * math.exp(-tokens) + k * (1 + tokens) * math.exp(-tokens)  # affected segments of a set
            term, within = math.exp(-none), 0.0
            for i in range(skip + 1):
                within += term
                term *= none / (i + 1)
            empty = 0 if m == 1 else none * math.exp(-tokens) * max(0.0, 1 - within) ** 2
            cost = rows + BAND_ROWS * (chance + empty)
            if cost < best[0]:
                best = (cost, m, k, skip)
    return best[1:]


def signatures(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set in all its bands, and for each how many keys a linked set must share in that band at least: one more
    than the segments that may be skipped, less those this set skips."""
    out, needs = [], []
    for index in bands_for(len(tokens), percent):
        m, k, skip = allocation(index, percent)
        value = mix(tokens + np.uint64(0x632BE59BD9B4E019 * (index + 1) & 0xFFFFFFFFFFFFFFFF))
        segment = ((value >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        value = mix(value)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, segment, value)
        count = np.bincount(segment, minlength=m)
        label = mix(np.arange(m, dtype=np.uint64) + np.uint64(index << 32 | 1))
        exact = mix(sums ^ label)
        some = count > 0
        near = segment < k
        shorter = mix((sums[segment[near]] - value[near]) ^ label[segment[near]])
        affected = int((~some).sum() + (count[:k] == 1).sum())
        need = 1
        if affected <= skip:  # empty segments say little and enough others must match
            exact = exact[some]
            shorter = shorter[count[segment[near]] > 1]
            need = skip + 1 - affected
        keys = np.unique(np.concatenate([exact, shorter]))
        out.append(keys)
        needs.append(np.full(len(keys), need, np.int64))
    return np.concatenate(out).view(np.int64), np.concatenate(needs)


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, row_key, n, digest`` of every row; the digest is null for empty sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                n, digest = [], []
                for text in batch.pop("text"):
                    tokens = shingle_set(text, shingle)
                    n.append(len(tokens))
                    digest.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                yield batch.assign(n=n, digest=digest)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    return rows.mapInPandas(run, "doc_id LONG, row_key LONG, n LONG, digest BINARY")


def class_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``cid, text`` of stored ``row_key, cid``, one text of each class (more if its row is repeated)."""
    side, _ = small_side(classes.select("row_key", "cid"))
    return docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text").join(side, "row_key").select("cid", "text")


def index_keys(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``sig, cid, n, need``: the index keys of every class, see ``signatures``. They outweigh the texts, so they are computed
    where they are needed rather than stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                cids, sigs, sizes = [], [], []
                for i, (cid, text) in enumerate(zip(batch["cid"], batch["text"]), 1):
                    tokens = shingle_set(text, shingle)
                    keys, needs = signatures(tokens, percent)
                    cids.append(np.full(len(keys), cid)), sigs.append(keys), sizes.append((len(tokens) << 16) + needs)
                    if i % 500 == 0 or i == len(batch):
                        yield pd.DataFrame({"sig": np.concatenate(sigs), "cid": np.concatenate(cids), "size": np.concatenate(sizes)})
                        cids, sigs, sizes = [], [], []

    rows = texts.mapInPandas(run, "sig LONG, cid LONG, size LONG")
    return rows.select("sig", "cid", F.shiftright("size", 16).alias("n"), (F.col("size") % 65536).alias("need"))


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, shingle: int, percent: int, chunk: int = 64) -> DataFrame:
    """``a, b, linked, delta`` for the stored ``a, b``: whether the sets reach the threshold, and the tokens only one of them has.

    Only the texts of classes in a pair are read again, one of each class. The partners of ``a`` are cut into chunks that meet one copy of
    ``a``'s set, so that a class with many partners is spread over many tasks.
    """
    spark = docs.sparkSession
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    cut = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    roles = cut.select("a", "chunk", F.col("b").alias("cid"), F.lit(1).alias("role")).unionByName(
        cut.select("a", "chunk", F.col("a").alias("cid"), F.lit(0).alias("role")).distinct()
    )
    texts = class_texts(docs, stored(classes.join(roles.select("cid").distinct(), "cid").select("cid", "row_key"), "join-need"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                found = [shingle_set(t, shingle).tobytes() for t in batch["text"]]
                yield pd.DataFrame({"cid": batch["cid"], "tokens": found})

    both = roles.join(texts.mapInPandas(sets, "cid LONG, tokens BINARY"), "cid")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(2 * width, "a", "chunk").sortWithinPartitions("a", "chunk", "role", "cid")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, x = None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for a, c, cid, role, tokens in batch[["a", "chunk", "cid", "role", "tokens"]].itertuples(index=False):
                y = np.frombuffer(tokens, np.uint64)
                if role == 0:
                    head, x = (a, c), y
                    continue
                assert head == (a, c), "a chunk came without its head"
                delta = np.setxor1d(x, y, assume_unique=True)
                out.append((a, cid, bool(links(len(x), len(y), len(delta), percent)), delta.view(np.int64)))
            yield pd.DataFrame(out, columns=["a", "b", "linked", "delta"])

    # a row that is repeated in the table meets its leader repeatedly
    return both.mapInPandas(compare, "a LONG, b LONG, linked BOOLEAN, delta ARRAY<LONG>")


def links(n, m, differ, percent: int):
    """Jaccard test from both sizes and the number of differing elements; numbers or columns."""
    return 100 * (n + m - differ) >= percent * (n + m + differ)


def leaders(counted: DataFrame, jumps: int = 3) -> DataFrame:
    """``a, b``: class ``b`` follows ``a``: the smallest class of its index keys that it shares most keys with, then that
    one's leader and so on (``2 ** jumps`` steps), so that a group has one leader. Any choice is right, this one leaves little to do."""
    now = stored(counted.groupBy(F.col("cid").alias("b")).agg(F.max_by("least", F.struct("f", -F.col("least"))).alias("a")), "join-leaders")
    for _ in range(jumps):
        up = now.select(F.col("b").alias("a"), F.col("a").alias("up"))
        now = stored(now.join(up, "a", "left").select("b", F.coalesce("up", "a").alias("a")), "join-leaders")
    return now


def banded_sets(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``grp, cid, n, toks``: the set of every class once for each of its bands. Classes that link meet in the band of the smaller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                for cid, text in zip(batch["cid"].tolist(), batch["text"]):
                    tokens = shingle_set(text, shingle)
                    rows += [(band, cid, len(tokens), tokens.view(np.int64)) for band in bands_for(len(tokens), percent)]
                yield pd.DataFrame(rows, columns=["grp", "cid", "n", "toks"])

    return texts.mapInPandas(run, "grp LONG, cid LONG, n LONG, toks ARRAY<LONG>")


def by_group(rows: DataFrame, side: DataFrame, fits: bool, salts: int = 32) -> DataFrame:
    """``rows`` with the columns of stored ``side``, one row a ``grp``; a large group is dealt over many tasks."""
    if fits:
        return rows.join(F.broadcast(side), "grp", "left")
    side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(salts)).cast("int")).join(side, ["grp", "salt"], "left").drop("salt")


def linked_in_groups(rows: DataFrame, percent: int, few: int) -> DataFrame:
    """``a, b``: links between members of a group, enough to connect what all its links connect.

    ``rows`` has ``grp, cid, n, toks``: a class, its size and its set, or what it differs in from some set of the group; ``u``,
    elements it is known not to share; ``part`` and ``leader``: members with equal ones need no link.

    In each group the elements that more than half of the members have are taken for its centre, and members are given by
    what they differ in from it: ``w`` elements with ``u``. Two members differ in ``w + w' - 2 * overlap`` and link if
    ``v + v' <= 2 * (100 + percent) * overlap`` with ``v = (100 + percent) * w - (100 - percent) * n``. Those with ``v + v' <= 0``
    link at once, also with the member of the smallest ``v``, which stands for them. The others must overlap: differences are ordered by
    rarity, those of one member only cannot overlap, and the first ones are joined as far as ``v`` and the smallest ``v`` allow.
    Up to ``few`` members that share an element are compared; more are a group of the next round, where the elements up to the shared one
    are known not to be shared (pairs that share one meet there). Such a group has half of the members at most. Where the
    new groups would not save half of the pairs, they are compared at once.
    """
    up, down = 100 + percent, 100 - percent
    found = None
    rows = stored(rows, "join-members")
    while not rows.isEmpty():
        counts = rows.select("grp", F.explode("toks").alias("token")).groupBy("grp", "token").agg(F.count(F.lit(1)).alias("f"))
        counts = counts.join(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("g")), "grp").where("2 * f > g")
        centre = stored(counts.groupBy("grp").agg(F.collect_list("token").alias("centre")), "join-centre")
        fits = (centre.agg(F.sum(F.size("centre"))).first()[0] or 0) <= BROADCAST_ROWS
        based = by_group(rows, centre, fits).withColumn("centre", F.coalesce("centre", F.array().cast("array<long>")))
        based = based.withColumn("toks", F.concat(F.array_except("toks", "centre"), F.array_except("centre", "toks")))
        based = based.withColumn("v", up * (F.col("u") + F.size("toks")) - down * F.col("n"))
        based = stored(based.select("grp", "cid", "n", "v", (F.col("u") + F.size("toks")).alias("w"), "part", "leader", "toks"), "join-based")

        best = based.groupBy("grp").agg(F.min(F.struct("v", "cid", "part")).alias("best"), F.count(F.lit(1)).alias("g"))
        best = stored(best.where("g > 1").select("grp", "g", "best.v", "best.cid", "best.part").toDF("grp", "g", "v0", "c0", "part0"), "join-best")
        few_groups = best.count() <= BROADCAST_ROWS
        core = F.col("v") + F.col("v0") <= 0
        near = by_group(based.drop("toks"), best, few_groups).where(core & (F.col("cid") != F.col("c0")) & (F.col("part") != F.col("part0")))
        links_now = stored(near.select(F.col("c0").alias("a"), F.col("cid").alias("b")), "join-links")
        found = links_now if found is None else found.unionByName(links_now)

        tokens = based.withColumn("token", F.explode("toks")).drop("toks")
        counts = tokens.groupBy("grp", "token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
        counts, _ = small_side(stored(counts, "join-tokens"))
        ranked = tokens.join(counts, ["grp", "token"]).groupBy("grp", "cid", "n", "v", "w", "part", "leader")
        ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("f", "token"))).getField("token").alias("toks"))
        ranked = by_group(ranked, best, few_groups).where("v0 IS NOT NULL").withColumn("core", core)
        need = F.greatest(F.lit(1), F.ceil((F.col("v") + F.when(F.col("core"), -F.col("v0")).otherwise(F.col("v0"))) / (2 * up)))
        ranked = ranked.withColumn("part", F.when(F.col("core"), F.col("part0")).otherwise(F.col("part")))
        ranked = ranked.withColumn("d", F.size("toks")).withColumn("width", (F.col("d") - need + 1).cast("int")).where("width > 0")
        ranked = stored(ranked.select("grp", "cid", "n", "v", "w", "part", "leader", "core", "d", "width", "toks"), "join-ranked")

        names = ["cid", "n", "v", "part", "leader", "core", "d", "pos"]
        heads = ranked.select("*", F.posexplode(F.slice("toks", F.lit(1), F.col("width"))).alias("pos", "token"))
        met = heads.groupBy("grp", "token").agg(
            F.count(F.lit(1)).alias("k"), F.min("part").alias("lo"), F.max("part").alias("hi"),
            F.min("leader").alias("from"), F.max("leader").alias("to"), F.min("core").alias("all_core"),
        ).where("k > 1 AND lo <> hi AND from <> to AND NOT all_core")
        met = stored(met.select("grp", "token", "k"), "join-met")
        large = met.where(F.col("k") > few)
        cost = large.groupBy("grp").agg(F.sum(F.col("k") * F.col("k")).alias("cost")).join(best, "grp")
        large = stored(large.join(cost.where("2 * cost <= g * g").select("grp"), "grp", "left_semi").select("grp", "token"), "join-large")
        small = met.join(large, ["grp", "token"], "left_anti").select("grp", "token")

        meet = heads.drop("toks").join(small, ["grp", "token"])
        left, right = (meet.select("grp", "token", *[F.col(c).alias(f"{s}_{c}") for c in names]) for s in "lr")
        rest = F.least(F.col("l_d") - F.col("l_pos"), F.col("r_d") - F.col("r_pos"))
        pairs = left.where("NOT l_core").join(right, ["grp", "token"]).where(
            (F.col("l_cid") != F.col("r_cid")) & (F.col("r_core") | (F.col("l_cid") < F.col("r_cid")))
            & (F.col("l_part") != F.col("r_part")) & (F.col("l_leader") != F.col("r_leader"))
            & (100 * F.least("l_n", "r_n") >= percent * F.greatest("l_n", "r_n")) & (2 * up * rest >= F.col("l_v") + F.col("r_v"))
        )
        pairs = stored(pairs.select("grp", F.col("l_cid").alias("a"), F.col("r_cid").alias("b")).distinct(), "join-near")
        for s in "ab":
            pairs = pairs.join(ranked.select("grp", *[F.col(c).alias(f"{s}{t}") for c, t in (("cid", ""), ("v", "v"), ("toks", "t"))]), ["grp", s])
        pairs = pairs.where(F.col("av") + F.col("bv") <= 2 * up * F.size(F.array_intersect("at", "bt")))
        pairs = pairs.select("grp", F.pmod(F.xxhash64("a"), F.lit(8)).alias("salt"), "a", "b")
        found = found.unionByName(stored(thinned(pairs, "grp", "salt"), "join-links"))

        side, _ = small_side(large)
        rows = heads.join(side, ["grp", "token"]).select(
            F.xxhash64("grp", "token").alias("grp"), "cid", "n", (F.col("w") - F.col("d") + F.col("pos")).alias("u"), "part", "leader",
            F.slice("toks", F.col("pos") + 2, F.col("d")).alias("toks"),
        )
        rows = stored(rows, "join-members")
    return rows.select(F.col("cid").alias("a"), F.col("cid").alias("b")) if found is None else found


def near_copies(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """One row per document row: ``doc_id, row_key, n_shingles, component_id, kept``.

    Documents link if the Jaccard index of their shingle sets is at least ``percent`` / 100; ``component_id`` is the smallest id
    reachable by links, and ``kept`` marks the row with that id (of several, one text).

    Equal sets collapse to classes first. Classes that share an index key are candidates. Each class is verified against its
    leader (``leaders``). Links between followers of one leader, and between classes that share a key with more than ``FEW`` others, come from
    a join of their differences (``linked_in_groups``); other pairs with enough common keys, different leaders and not yet
    one component are verified one by one. So no link between different texts is lost, and a group of copies never becomes all its pairs.

    Null and empty texts and those without words have size 0 and link with nothing. A null id is reached like any other,
    but never named; alone it has a null component. Repeated rows link with each other. Empty tables
    give an empty result. Columns other than ``doc_id, text`` are not looked at.
    """
    prints = stored(fingerprints(docs, shingle), "join-prints")
    first = F.min(F.struct("doc_id", "row_key", "n")).alias("first")
    classes = prints.where("digest IS NOT NULL").groupBy("digest").agg(first, F.min("doc_id").alias("label"))
    classes = stored(
        classes.select(F.monotonically_increasing_id().alias("cid"), "digest", "label", "first.row_key", "first.n"), "join-classes"
    )
    keys = index_keys(class_texts(docs, classes), shingle, percent)
    # rows of a text that is repeated under one id are one class; `lo < hi` tells two classes from one
    met = keys.groupBy("sig").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).where("least < most").drop("most")
    met, _ = small_side(stored(met, "join-met"), SHARED_KEYS)
    shared = stored(keys.join(met, "sig"), "join-shared")

    counted = shared.where("cid <> least").groupBy("cid", "least").agg(F.count(F.lit(1)).alias("f"), F.min("need").alias("need"))
    counted = counted.where("f >= need")
    led = leaders(counted)
    judged = stored(verified(docs, led, classes, shingle, percent).dropDuplicates(["a", "b"]), "join-judged")
    judged = judged.select(F.col("a").alias("leader"), F.col("b").alias("cid"), "linked", "delta")
    found = judged.where("linked").select(F.col("leader").alias("a"), F.col("cid").alias("b"))
    open_groups = judged.groupBy("leader").agg(F.count(F.lit(1)).alias("k"), F.min("linked").alias("all")).where("k > 1 AND NOT all")
    members = judged.join(open_groups.select("leader"), "leader", "left_semi").join(classes.select("cid", "n"), "cid")
    members = members.select(
        F.xxhash64("leader").alias("grp"), "cid", "n", F.lit(0).cast("long").alias("u"),
        F.when(F.col("linked"), F.col("leader")).otherwise(F.col("cid")).alias("part"), F.col("cid").alias("leader"), F.col("delta").alias("toks"),
    )

    # A follower that links with its leader is already one with it, which spares most of the pairs below.
    part = judged.where("linked").select("cid", F.col("leader").alias("part"))
    tagged = shared.join(part, "cid", "left").join(led.select(F.col("b").alias("cid"), F.col("a").alias("leader")), "cid", "left")
    tagged = tagged.select("sig", "cid", "n", "need", F.coalesce("part", "cid").alias("part"), F.coalesce("leader", "cid").alias("leader"))
    mixed = tagged.groupBy("sig").agg(
        F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("leader").alias("from"), F.max("leader").alias("to"),
        F.count(F.lit(1)).alias("k"),
    ).where("lo <> hi AND from <> to").select("sig", "k")
    open_rows = stored(tagged.join(mixed, "sig"), "join-open")

    # Pairs that share a key with many are found as members of groups, by that key alone, the others by all their keys.
    many = stored(open_rows.where(F.col("k") > FEW).select("cid", "part", "leader").distinct(), "join-many")
    texts = class_texts(docs, stored(classes.join(many, "cid").select("cid", "row_key"), "join-need"))
    sets = banded_sets(texts, shingle, percent).dropDuplicates(["grp", "cid"]).join(many, "cid")
    members = members.unionByName(sets.withColumn("u", F.lit(0).cast("long")))
    found = found.unionByName(linked_in_groups(members, percent, FEW))

    few = open_rows.where(F.col("k") <= FEW)
    left, right = (few.select("sig", *[F.col(c).alias(f"{s}_{c}") for c in ("cid", "n", "need", "part", "leader")]) for s in "lr")
    n, m = F.col("l_n"), F.col("r_n")
    rest = left.join(right, "sig").where(
        (F.col("l_cid") < F.col("r_cid")) & (F.col("l_part") != F.col("r_part")) & (F.col("l_leader") != F.col("r_leader"))
        & (100 * F.least(n, m) >= percent * F.greatest(n, m))
    )
    rest = rest.groupBy(F.col("l_cid").alias("a"), F.col("r_cid").alias("b")).agg(
        F.count(F.lit(1)).alias("f"), F.min(F.greatest("l_need", "r_need")).alias("need")
    )
    rest = stored(rest.where("f >= need").select("a", "b"), "join-rest")
    more = stored(verified(docs, rest, classes, shingle, percent).where("linked").select("a", "b").distinct(), "join-more")
    parts = components(found.unionByName(more)).select(F.col("node").alias("cid"), F.col("component").alias("part"))

    of_class = classes.select("cid", "digest", "label").join(parts, "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    lowest = of_class.groupBy("part").agg(F.min("label").alias("component_id"))
    of_class = of_class.join(lowest, "part").select("digest", "component_id")
    rows = prints.select("doc_id", "row_key", "n", "digest").join(of_class, "digest", "left")
    rows = rows.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    heads = rows.where(F.col("digest").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = heads.groupBy(F.col("component_id").alias("of")).agg(F.min("row_key").alias("head"))
    out = rows.join(heads, F.col("component_id").eqNullSafe(F.col("of")), "left")
    kept = F.col("digest").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("head")))
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "component_id", F.coalesce(kept, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of ``docs`` without further copies: one row of each component, all rows without words, all columns kept."""
    judged = stored(judged, "join-judged")
    gone, _ = small_side(stored(judged.where(~F.col("kept")).select("row_key").distinct(), "join-gone"))
    twice = judged.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("row_key").count().where("count > 1").select("row_key")
    twice, _ = small_side(stored(twice, "join-twice"))
    rows = docs.select(whole_row(docs), F.xxhash64("doc_id", "text").alias("row_key"))
    rows = rows.join(gone, "row_key", "left_anti")
    single = rows.join(twice, "row_key", "left_anti").select("row.*")
    repeated = rows.join(twice, "row_key").groupBy("row_key").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(repeated)
