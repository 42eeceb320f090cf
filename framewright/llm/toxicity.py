"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import small_side, stored, whole_row

SIZES = (4, 5, 6)
#: Bytes of text that are hashed together.
SLICE = 250_000
_FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    """``weights`` by hashed n-gram, zero for those not selected; a score is the logistic of their sum."""

    weights: np.ndarray
    bias: float


def _parts(texts: list[str | None], most: int) -> Iterator[tuple[int, bytes]]:
    """(text number, folded bytes) with blanks around; a long text in parts that overlap by the longest n-gram less one."""
    keep = max(SIZES) - 1
    for i, text in enumerate(texts):
        data = b"  " + (text or "").encode("utf-8", "surrogatepass").translate(_FOLD) + b"  "
        for at in range(0, max(1, len(data) - keep), most):
            yield i, data[at : at + most + keep]


def ngram_ids(texts: list[str | None], wanted: np.ndarray, most: int = SLICE) -> list[np.ndarray]:
    """Sorted distinct hashed n-grams of each text, of those for which ``wanted`` (of 2**bits places) is true.

    Texts are UTF-8 bytes, ASCII letters in lower case and all other ASCII one blank; n-grams with two blanks in a row are left
    out. About ``most`` bytes are hashed together, so memory does not depend on the length of a text.
    """
    found: list[list[np.ndarray]] = [[] for _ in texts]
    ready, size = [], 0
    for part in _parts(texts, most):
        ready.append(part)
        size += len(part[1])
        if size >= most:
            _hashed(ready, wanted, found)
            ready, size = [], 0
    if ready:
        _hashed(ready, wanted, found)
    return [f[0] if len(f) == 1 else np.unique(np.concatenate(f)) for f in found]


def _hashed(parts: list[tuple[int, bytes]], wanted: np.ndarray, found: list[list[np.ndarray]]) -> None:
    """Append the distinct hashes of some parts to those found of their texts."""
    bits = len(wanted).bit_length() - 1
    buf = np.frombuffer(b"".join(d for _, d in parts), np.uint8)
    ends = np.cumsum([len(d) for _, d in parts], dtype=np.int64)
    blank = buf == 32
    cut = np.zeros(len(buf) + 1, np.int32)  # pairs of blanks, and ends of parts, that start before a place
    cut[np.flatnonzero(blank[:-1] & blank[1:]) + 1] = 1
    cut[ends] = 1
    cut = np.cumsum(cut, dtype=np.int32)
    pieces = []
    rolling = np.zeros(len(buf), np.uint32)
    for n in range(1, max(SIZES) + 1):
        k = len(buf) - n + 1
        if k <= 0:
            break
        rolling = rolling[:k] * np.uint32(0x01000193) + buf[n - 1 :] + np.uint32(1)
        if n not in SIZES:
            continue
        h = rolling ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        h = (h >> np.uint32(32 - bits)).astype(np.int32)
        at = np.flatnonzero(wanted[h] & (cut[:k] == cut[n - 1 : n - 1 + k]))
        pieces.append((h[at], np.append(0, np.searchsorted(at, ends))))
    for j, (i, _) in enumerate(parts):  # sorting the few thousand hashes of a text is faster than those of all together
        ids = np.sort(np.concatenate([h[edge[j] : edge[j + 1]] for h, edge in pieces])) if pieces else np.empty(0, np.int32)
        found[i].append(ids[np.append(True, ids[1:] != ids[:-1])] if len(ids) else ids)


def _slices(batch: pd.DataFrame, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with at most about ``most`` characters, at least one row."""
    sizes = batch["text"].str.len().fillna(0).to_numpy()
    first, total = 0, 0.0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0.0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def fit_linear(
    rows: np.ndarray, cols: np.ndarray, y: np.ndarray, scale: np.ndarray, l2: float, steps: int, times: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features times ``scale``, a row counting ``times``, classes weighted to even shares; Nesterov steps."""
    n, d = len(y), len(scale)
    value = scale[cols]
    times = np.ones(n) if times is None else times
    each = np.where(y == 1, 0.5 / times[y == 1].sum(), 0.5 / times[y != 1].sum()) * times

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=value * w[cols], minlength=n) + w[d]

    def backward(g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cols, weights=value * g[rows], minlength=d), g.sum())

    top, curve = np.ones(d + 1), 1.0
    for _ in range(30):  # largest eigenvalue, for the step width
        top = backward(each * forward(top / np.linalg.norm(top)))
        curve = float(np.linalg.norm(top)) or 1.0
    rate = 1 / (0.25 * 1.1 * curve + l2)
    w = ahead = np.zeros(d + 1)
    momentum = 1.0
    for _ in range(steps):
        grad = backward(each * (1 / (1 + np.exp(-forward(ahead))) - y))
        grad[:d] += l2 * ahead[:d]
        last, w = w, ahead - rate * grad
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = w + (momentum - 1) / after * (w - last)
        momentum = after
    return w[:d], float(w[d])


def calibration(
    rows: np.ndarray, cols: np.ndarray, y: np.ndarray, scale: np.ndarray, l2: float, steps: int, times: np.ndarray, fold: np.ndarray
) -> tuple[float, float]:
    """Slope and shift of the logits by which rows left out of a fit are judged best; an optimistic fit gives them too flat logits.

    Each ``fold`` (0, 1, ...) is scored by a fit on the others. No change if a fit lacks a class.
    """
    logits = np.zeros(len(y))
    for f in np.unique(fold):
        used = fold != f
        if len(np.unique(y[used])) < 2:
            return 1.0, 0.0
        place, of = np.cumsum(used) - 1, used[rows]
        w, bias = fit_linear(place[rows[of]], cols[of], y[used], scale, l2, steps, times[used])
        logits[~used] = (np.bincount(rows, weights=(w * scale)[cols], minlength=len(y)) + bias)[~used]
    each = np.where(y == 1, 0.5 / times[y == 1].sum(), 0.5 / times[y != 1].sum()) * times
    x, line = np.stack([logits, np.ones(len(y))], axis=1), np.array([1.0, 0.0])

    def loss(line: np.ndarray) -> float:
        return float(each @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ line))) + 5e-5 * ((line - [1, 0]) ** 2).sum()

    for _ in range(30):  # Newton steps, halved until they help; a little weight on the unchanged line
        p = 1 / (1 + np.exp(-np.clip(x @ line, -500, 500)))
        slope = x.T @ (each * (p - y)) + 1e-4 * (line - [1, 0])
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), slope)
        while np.abs(step).max() > 1e-6 and loss(line - step) > loss(line):
            step = step / 2
        line = line - step
    return (float(line[0]), float(line[1])) if line[0] > 0 else (1.0, 0.0)


def train(
    texts: DataFrame, sample: int = 4_000, least_z: float = 3.0, least_ratio: float = 0.7, alpha: float = 1.0, l2: float = 3e-4, steps: int = 300,
    bits: int = 20, folds: int = 4
) -> Model:
    """Model from ``text, toxic`` (0/1) rows.

    The n-gram counts of both classes, hence the log-count ratios, are taken over all rows, each task sending its sums. N-grams
    whose shares in the classes differ by ``least_z`` standard errors, and by a log ratio of ``least_ratio`` (a factor of two), are kept, as many as
    there are, and scaled by their ratio: a few rows of one class are enough for a rare one, and common ones that hardly differ are left out. The linear weights are fitted on at most ``sample`` different texts of a class, those of the smallest
    hashes, each counting as often as it occurs; that bound is the only sampling. Logits are
    calibrated on ``folds`` parts left out in turn (1: not). N-grams are hashed to ``bits`` bits. With one class or none the
    score is constant: the share of toxic rows, 0 without rows.
    """
    dim = 1 << bits
    everything = np.ones(dim, bool)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, docs = np.zeros((2, dim), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for i, j in _slices(batch):
                part = batch.iloc[i:j]
                y = part["toxic"].to_numpy(dtype=np.int64)
                for c, ids in zip(y.tolist(), ngram_ids(part["text"].tolist(), everything)):
                    sums[c, ids] += 1
                    docs[c] += 1
        seen = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"id": np.append(seen, -1), "neg": np.append(sums[0, seen], docs[0]), "pos": np.append(sums[1, seen], docs[1])})

    texts = texts.where(F.col("toxic").isin(0, 1)).select("text", F.col("toxic").cast("int").alias("toxic"))
    counts = texts.mapInPandas(count, "id INT, neg LONG, pos LONG").groupBy("id").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counts = stored(counts, "toxic-counts")
    n = next(((float(r["neg"]), float(r["pos"])) for r in counts.where("id = -1").take(1)), (0.0, 0.0))
    share = n[1] / sum(n) if sum(n) else 0.0
    constant = Model(np.zeros(dim, np.float32), float(np.log(max(share, 1e-12)) - np.log(max(1 - share, 1e-12))))
    if min(n) == 0:
        return constant
    q, p = (F.col("neg") + alpha) / (n[0] + 2 * alpha), (F.col("pos") + alpha) / (n[1] + 2 * alpha)
    both = (F.col("neg") + F.col("pos") + 2 * alpha) / (sum(n) + 4 * alpha)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]) + 1e-12)
    table = counts.where((F.col("id") >= 0) & (F.abs(z) >= least_z) & (F.abs(F.log(p / q)) >= least_ratio)).select("id", "neg", "pos").toPandas().sort_values("id")  # at most 2 ** bits rows
    ids = table["id"].to_numpy()
    if not len(ids):
        return constant
    ratio = np.log((table["pos"].to_numpy() + alpha) / (n[1] + 2 * alpha)) - np.log((table["neg"].to_numpy() + alpha) / (n[0] + 2 * alpha))
    wanted = np.zeros(dim, bool)
    wanted[ids] = True
    place = np.zeros(dim, np.int32)
    place[ids] = np.arange(len(ids))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j in _slices(batch):
                part = batch.iloc[i:j]
                lists = ngram_ids(part["text"].tolist(), wanted)
                yield part[["toxic", "h", "times"]].assign(ids=[place[x].astype("<i4").tobytes() for x in lists])

    def few(toxic: int) -> DataFrame:
        h = F.xxhash64(F.lit("fit"), "text")
        near = F.pmod(h, F.lit(1 << 20)) < int(min(1.0, 2 * sample / n[toxic]) * (1 << 20) + 1)
        equal = texts.where((F.col("toxic") == toxic) & near).groupBy("toxic", "text").agg(F.count(F.lit(1)).alias("times"))
        equal = equal.withColumn("h", F.pmod(F.xxhash64(F.lit("fit"), "text"), F.lit(1 << 20)) * (1 << 20) + F.pmod(F.hash("text"), F.lit(1 << 20)))
        return equal.mapInPandas(pick, "toxic INT, h LONG, times LONG, ids BINARY").orderBy("h", "ids").limit(sample)

    data = few(0).unionByName(few(1)).toPandas()  # short lists, bounded rows
    if data["toxic"].nunique() < 2:
        return constant
    data = data.sort_values(["toxic", "h", "ids"], kind="stable")
    lengths = data["ids"].map(len).to_numpy() // 4
    rows = np.repeat(np.arange(len(data), dtype=np.int32), lengths)
    cols = np.frombuffer(b"".join(data["ids"]), "<i4")
    y, times = data["toxic"].to_numpy(dtype=float), data["times"].to_numpy(dtype=float)
    w, bias = fit_linear(rows, cols, y, ratio, l2, steps, times)
    slope, shift = calibration(rows, cols, y, ratio, l2, steps, times, np.arange(len(y)) % folds) if folds > 1 else (1.0, 0.0)
    weights = np.zeros(dim, np.float32)
    weights[ids] = w * ratio * slope
    return Model(weights, bias * slope + shift)


def score_column(model: Model, text: Column) -> Column:
    """Score between 0 and 1; the same text always has the same score."""
    weights, bias, wanted = model.weights.astype(float), model.bias, model.weights != 0

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        batch = pd.DataFrame({"text": text})
        out = np.full(len(batch), bias)
        for i, j in _slices(batch):
            out[i:j] += [weights[ids].sum() for ids in ngram_ids(batch["text"].iloc[i:j].tolist(), wanted)]
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return score(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of the labelled documents that may be learned from. Conflicting labels count as toxic."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks, _ = small_side(stored(marks.where(~held_out(F.col("doc_id"))), "toxic-labels"))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(marks, "doc_id").select("text", "toxic")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """One row per document row: ``doc_id, held_out, score, predicted``.

    Learns from labelled rows whose crc32 of the id is not 1 modulo 3. Null and empty texts get the
    score of a text without features. A null id is not held out and never learned from. Repeated rows
    give repeated results. Columns other than ``doc_id, text`` and ``doc_id, toxic`` are not looked at.
    """
    model = train(labelled(docs, labels), **fit)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, all columns kept."""
    model = train(labelled(docs, labels), **fit)
    rows = docs.select(whole_row(docs), score_column(model, F.col("text")).alias("score"))
    return rows.where(F.col("score") < threshold).select("row.*")
