"""Target-distribution importance resampling over hashed n-grams whose CRCs come from running CRCs of the text."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import in_order, stored

POLYNOMIAL = 0xEDB88320
#: Words are runs of ASCII letters and digits and of all bytes above ASCII; A-Z become a-z, everything else a blank.
_FOLD = bytes(ord(chr(c).lower()) if chr(c) in string.ascii_letters + string.digits else 32 for c in range(128)) + bytes(range(128, 256))


@cache
def shift_tables() -> np.ndarray:
    """``[k, place, byte]``: a CRC with ``byte`` at ``place``, after 2**k zero bytes. Each table is the one before applied twice."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    place = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    tables = [(place >> 8) ^ step[place & 255]]
    while len(tables) < 40:
        tables.append(_applied(tables[-1], tables[-1]))
    return np.array(tables)


def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved over ``n`` zero bytes each, one table for each bit of ``n``."""
    out, k = crc.copy(), 0
    while (n >> k).any():
        at = np.flatnonzero(n >> k & 1)
        out[at] = _applied(shift_tables()[k], out[at])
        k += 1
    return out


def running_crcs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One scan of the normalised texts, one blank between words.

    Returns the number of words of each text and, of each word, its place, the CRC before and the CRC after it. CRCs run on over
    all texts, since a substring's CRC does not depend on where the scan began.
    """
    counts, before, after, sizes = [], [], [], []
    crc = 0
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
        counts.append(len(words))
        for word in words:
            before.append(crc)
            crc = crc32(word, crc)
            after.append(crc)
            crc = crc32(b" ", crc)
        sizes += map(len, words)
    lengths = np.array(sizes, dtype=np.int64)
    start = np.cumsum(lengths + 1) - lengths - 1
    return np.array(counts, dtype=np.int64), np.stack([start, start + lengths]), np.array(before, np.uint32), np.array(after, np.uint32)


def feature_crcs(texts: list[str | None], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of all runs of 1 to ``most`` words: words of each text, text number and CRC of each feature.

    The CRC of a run is the one after it with the shifted one before it cancelled.
    """
    counts, place, before, after = running_crcs(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    rows, crcs = [], []
    for n in range(1, most + 1):
        first = np.arange(max(0, len(owner) - n + 1))
        first = first[owner[first] == owner[first + n - 1]]
        last = first + n - 1
        rows.append(owner[first])
        crcs.append(after[last] ^ shifted(before[first], place[1, last] - place[0, first]))
    return counts, np.concatenate(rows), np.concatenate(crcs)


def hashed(docs: DataFrame, most: int, buckets: int, label: str) -> DataFrame:
    """Stored ``id, n_words, n_features, data`` (buckets of the features, packed), a row for each document."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["text"].str.len().fillna(0).cumsum().to_numpy()
            for _, part in batch.groupby(np.asarray(sizes // 2_000_000, dtype=np.int64), sort=False):  # bounds the arrays
                counts, rows, crcs = feature_crcs([t if isinstance(t, str) else None for t in part["text"]], most)
                order = np.argsort(rows, kind="stable")
                features = np.bincount(rows, minlength=len(part))
                packed = (crcs[order] % np.uint32(buckets)).astype(kind)
                ends = np.cumsum(features)
                data = [packed[e - n : e].tobytes() for e, n in zip(ends, features)]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n_words": counts, "n_features": features, "data": data})

    return stored(docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(run, "id STRING, n_words LONG, n_features LONG, data BINARY"), label)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; a task sends its sums."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch["data"]:
                sums += np.bincount(np.frombuffer(data, kind), minlength=buckets) if len(data) > 8 * buckets else 0
            short = b"".join(d for d in batch["data"] if len(d) <= 8 * buckets)
            sums += np.bincount(np.frombuffer(short, kind), minlength=buckets)
        seen = np.flatnonzero(sums)
        yield pd.DataFrame({"bucket": seen, "n": sums[seen]})

    counts = features.select("data").mapInPandas(run, "bucket LONG, n LONG").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)  # at most ``buckets`` rows
    out[counts["bucket"].to_numpy(dtype=np.int64)] = counts["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray, scale: int) -> np.ndarray:
    """Scaled log ratio of the shares of both, each bucket counted once more than seen."""
    size, total, wanted = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(scale * math.log(float(t + 1) * float(total + size) / (float(s + 1) * float(wanted + size))))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], dtype=np.int64)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, most: int = 1, buckets: int = 10_000,
    scale: int = 1000, seed: int = 2024,
) -> DataFrame:
    """Draw ``percent`` of the documents of ``least`` words or more towards the texts of ``target``, without replacement.

    ``doc_id, n_features, weight, score, rank`` of every row. The features are runs of 1 to ``most`` words, counted over all
    documents and all target texts. The weight is the mean gain of a document's features, the score adds a Gumbel draw from
    the digest of seed and id, so the highest scores are a sample in proportion to the weights. Rank is null if not drawn.

    Null and empty texts have no features and weigh 0. A null id draws with an empty one. Rows that tie in score and id follow
    each other by weight and features; further ties are equal rows. Without target texts, gains say how rare a bucket is. An
    empty table gives no rows. Columns other than ``doc_id, text`` (``text`` in the target) are not looked at.
    """
    features = hashed(docs, most, buckets, "resample-features")
    goal = hashed(target.select(F.lit(0).alias("doc_id"), "text"), most, buckets, "resample-target")
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(goal, buckets), scale)
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["n_features"].to_numpy(dtype=np.int64)
            sums = np.array([gains[np.frombuffer(d, kind)].sum() for d in batch["data"]], dtype=np.int64)
            yield batch[["id", "n_words", "n_features"]].assign(weight=np.where(n > 0, sums // np.maximum(n, 1), 0))

    rows = features.mapInPandas(weigh, "id STRING, n_words LONG, n_features LONG, weight LONG")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-float(scale) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    kind_of_id = docs.schema["doc_id"].dataType
    scored = stored(rows.select(F.col("id").cast(kind_of_id).alias("doc_id"), "n_words", "n_features", "weight",
                                (F.col("weight") + gumbel).cast("long").alias("score")), "resample-scores")
    enough = F.col("n_words") >= least
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    ranked = in_order(scored.where(enough), [], order, "resample-order")
    drawn = F.expr(f"n * {int(percent)} div 100") > F.col("pos")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(drawn, F.col("pos") + 1).alias("rank")).unionByName(
        scored.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank"))
    )
