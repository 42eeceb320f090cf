"""Quality rules: counts of words, symbols and repetition, and a band of character n-gram perplexity for each language.

The language model is modified Kneser-Ney: Spark counts n-grams over all texts and turns the counts into probabilities by joins;
a model in use is sorted arrays of hashes with their values beside them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import small_side, stored
from framewright.session import scratch_path

ORDER = 5
PAD = "\n"
SYMBOLS = b"#*$%&|<>"
#: A model is sent to all tasks whole up to this many bytes (12 an entry); beyond it each task gets the entries its texts ask for.
MODEL_BYTES = 96_000_000
_BITS = 12


# ---- n-grams of texts -------------------------------------------------------------------------------------------------


def pieces(texts: list[str | None], order: int, most: int = 1 << 19) -> Iterator[list[tuple[int, str]]]:
    """(text number, part of the padded text) in lists of about ``most`` characters; parts of a long text overlap by ``order - 1``."""
    ready, size = [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        stream = PAD * (order - 1) + text + PAD
        for at in range(0, len(stream) - order + 1, most):
            ready.append((row, stream[at : at + most + order - 1]))
            size += len(ready[-1][1])
            if size >= most:
                yield ready
                ready, size = [], 0
    if ready:
        yield ready


def _halved(parts: list[tuple[int, str]], order: int) -> tuple[list, list]:
    if len(parts) > 1:
        return parts[: len(parts) // 2], parts[len(parts) // 2 :]
    (row, text), = parts
    middle = len(text) // 2
    return [(row, text[: middle + order - 1])], [(row, text[middle:])]


def packed(parts: list[tuple[int, str]], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number and key of every n-gram, and the code points that a key's digits stand for.

    A key has ``_BITS`` bits a character, by the characters that occur. Parts with more of them are cut in two; a part of
    2**_BITS characters cannot have more.
    """
    codes = np.frombuffer("".join(p for _, p in parts).encode("utf-32-le", "surrogatepass"), "<u4")
    table = np.zeros(0x110000, np.uint64)
    table[codes] = 1
    alphabet = np.flatnonzero(table)
    if len(alphabet) > 1 << _BITS:
        for half in _halved(parts, order):
            yield from packed(half, order)
        return
    table[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    ids, lengths = table[codes], np.array([len(p) for _, p in parts])
    keys = np.zeros(len(codes) - order + 1, np.uint64)
    for k in range(order):
        keys = (keys << np.uint64(_BITS)) | ids[k : k + len(keys)]
    rows = np.repeat([r for r, _ in parts], lengths)[: len(keys)]
    inside = np.ones(len(codes), bool)
    for k in range(1, order):
        inside[np.cumsum(lengths) - k] = False
    inside = inside[: len(keys)]
    yield rows[inside], keys[inside], alphabet


def spelled(keys: np.ndarray, alphabet: np.ndarray, order: int) -> np.ndarray:
    """Code points of keys, a row for each."""
    places = np.arange(order - 1, -1, -1, dtype=np.uint64) * np.uint64(_BITS)
    return alphabet[(keys[:, None] >> places) & np.uint64((1 << _BITS) - 1)]


def hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points."""
    h = np.full(len(codes), codes.shape[1] + 1, np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _by_lang(batch: pd.DataFrame) -> Iterator[tuple[str | None, pd.DataFrame]]:
    for lang, part in batch.groupby("lang", dropna=False, sort=False):
        yield (lang if isinstance(lang, str) else None), part


def _texts(part: pd.DataFrame) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in part["text"]]


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """``part, lang, gram, n`` of all texts; ``part`` is the split of the input. A task adds up slices of about half a million characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            for lang, part in _by_lang(batch):
                for parts in pieces(_texts(part), order):
                    for _, keys, alphabet in packed(parts, order):
                        keys, n = distinct(keys)
                        text = spelled(keys, alphabet, order).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                        grams = [text[i : i + order] for i in range(0, len(text), order)]
                        yield pd.DataFrame({"part": at, "lang": lang, "gram": grams, "n": n})

    return docs.select("doc_id", "lang", "text").mapInPandas(run, "part INT, lang STRING, gram STRING, n LONG")


# ---- model ------------------------------------------------------------------------------------------------------------


def _discounts(level: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3``: Chen and Goodman's closed form; half of a count's place where a count of counts is missing."""
    n = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double") for k in (1, 2, 3, 4)]
    of = level.groupBy("lang").agg(*[x.alias(f"n{k + 1}") for k, x in enumerate(n)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    whole = F.least("n1", "n2", "n3", "n4") > 0
    return of.select("lang", *[
        F.when(whole, F.greatest(F.lit(0.0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))).otherwise(k / 2.0).alias(f"d{k}")
        for k in (1, 2, 3)
    ])


def _on(left: DataFrame, right: DataFrame, **names: str) -> Column:
    on = left["lang"].eqNullSafe(right["lang"])
    for a, b in names.items():
        on = on & (left[a] == right[b])
    return on


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, slot, gram, value`` from ``lang, gram, c``, the counts of n-grams of ``order`` characters.

    ``slot`` n holds log probabilities of n-grams, slot ``-100 - n`` the log weight that a context of n characters leaves to shorter ones. Orders below the
    highest count the different characters before them. All levels interpolate; below one character stands the even
    share of the characters seen and one unseen. Tables are as large as the n-grams seen and are joined by n-gram.
    """
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        shorter = levels[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        levels[n] = stored(shorter, f"grams-{n}")
    seen = levels[1].groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    lower = seen.select("lang", F.lit("").alias("gram"), (1.0 / (F.col("v") + 1)).alias("p"))
    out = lower.select("lang", F.lit(0).alias("slot"), "gram", F.log("p").alias("value"))
    for n in range(1, order + 1):
        steps, _ = small_side(stored(_discounts(levels[n]), f"discounts-{n}"))
        level = levels[n].join(steps.withColumnRenamed("lang", "l"), levels[n]["lang"].eqNullSafe(F.col("l"))).drop("l")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.select(
            "lang", "gram", F.substring("gram", 1, n - 1).alias("context"), F.substring("gram", 2, n - 1).alias("tail"),
            F.col("c").cast("double").alias("c"), F.least(F.lit(3), "c").alias("k"), off.alias("off"), "d1", "d2", "d3",
        )
        k = [F.sum(F.when(F.col("k") == i, 1).otherwise(0)) for i in (1, 2, 3)]
        contexts = level.groupBy("lang", "context").agg(
            F.sum("c").alias("total"),
            ((k[0] * F.first("d1") + k[1] * F.first("d2") + k[2] * F.first("d3")) / F.sum("c")).alias("left"),
        )
        contexts = stored(contexts, f"contexts-{n}")
        both = level.join(contexts.withColumnRenamed("lang", "l"), level["lang"].eqNullSafe(F.col("l")) & (level["context"] == contexts["context"]))
        both = both.select(level["lang"], level["gram"], "tail", ((F.col("c") - F.col("off")) / F.col("total")).alias("own"), "left")
        below = lower.select(F.col("lang").alias("l"), F.col("gram").alias("g"), "p")
        lower = both.join(below, both["lang"].eqNullSafe(F.col("l")) & (both["tail"] == F.col("g"))).select(
            "lang", "gram", (F.col("own") + F.col("left") * F.col("p")).alias("p")
        )
        lower = stored(lower, f"probabilities-{n}")
        out = out.unionByName(lower.select("lang", F.lit(n).alias("slot"), "gram", F.log("p").alias("value")))
        out = out.unionByName(contexts.where("left > 0").select(
            "lang", F.lit(1 - n - 100).alias("slot"), F.col("context").alias("gram"), F.log("left").alias("value")
        ))
    return out


@dataclass
class Model:
    """``arrays[lang, slot]``: sorted hashes and the value of each."""

    order: int
    arrays: dict[tuple[str | None, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def find(self, lang: str | None, slot: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its value or 0."""
        known, values = self.arrays.get((lang, slot), (np.empty(0, np.uint64), np.empty(0, np.float32)))
        if not len(known):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        there = known[at] == wanted
        return there, np.where(there, values[at], 0).astype(float)

    def log_probabilities(self, lang: str | None, codes: np.ndarray) -> np.ndarray:
        """Of the last character of each row after the others: the longest n-gram known, less what its missing contexts leave."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for n in range(self.order, -1, -1):
            there, values = self.find(lang, n, hashes(codes[open_, self.order - n :]))
            out[open_] += values
            open_ = open_[~there]
            if not len(open_):
                break
            if n:
                out[open_] += self.find(lang, 1 - n - 100, hashes(codes[open_, self.order - n : -1]))[1]
        return out


def hashed_rows(model: DataFrame) -> DataFrame:
    """``lang, slot, hash, value`` of the model's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for slot, part in batch.groupby("slot", sort=False):
                n = slot if slot >= 0 else -slot - 100
                codes = np.frombuffer("".join(part["gram"]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), n)
                yield part.drop(columns="gram").assign(hash=hashes(codes).view(np.int64))

    rest = [f"{f.name} {f.dataType.simpleString()}" for f in model.schema if f.name != "gram"]
    return model.mapInPandas(run, ", ".join([*rest, "hash LONG"]))


def loaded(model: DataFrame, order: int) -> Model:
    """The whole model in sorted arrays; for models of a checked size only."""
    kinds = "lang STRING, slot INT, hashes BINARY, entries BINARY"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (lang, slot), part in batch.groupby(["lang", "slot"], dropna=False, sort=False):
                yield pd.DataFrame({
                    "lang": [lang if isinstance(lang, str) else None], "slot": [slot], "hashes": [part["hash"].to_numpy("i8").tobytes()],
                    "entries": [part["value"].to_numpy("f4").tobytes()],
                })

    out: dict = {}
    for row in hashed_rows(model).mapInPandas(run, kinds).collect():
        out.setdefault((row["lang"], row["slot"]), []).append((np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["entries"], "<f4")))
    whole = Model(order)
    for key, found in out.items():
        known, values = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(known, kind="stable")
        whole.arrays[key] = known[by], values[by]
    return whole


# ---- scores and rules -------------------------------------------------------------------------------------------------


def cross_entropies(texts: list[str | None], lang: str | None, model: Model) -> np.ndarray:
    """Mean negative log probability of a character of each text (nats), nan without characters."""
    sums, n = np.zeros(len(texts)), np.zeros(len(texts))
    for parts in pieces(texts, model.order):
        for rows, keys, alphabet in packed(parts, model.order):
            known, _ = distinct(keys)
            values = model.log_probabilities(lang, spelled(known, alphabet, model.order))
            sums -= np.bincount(rows, weights=values[np.searchsorted(known, keys)], minlength=len(texts))
            n += np.bincount(rows, minlength=len(texts))
    return np.divide(sums, n, out=np.full(len(texts), np.nan), where=n > 0)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text has twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) >= 1 << 21:  # keep the product below 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(numbers) + ids[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.zeros(len(words), bool)
    at = np.flatnonzero(np.isin(windows, twice))
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, lines seen before, words in repeated windows."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at blanks and the five control characters after tab, no others
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    blanks = sum(text.count(c) for c in " \t\n\v\f\r")
    return len(words), len(text) - blanks, len(data) - len(data.translate(None, SYMBOLS)), again, repeated_words(words)


def _scored(docs: DataFrame, model_of: Callable[[], Model]) -> DataFrame:
    """``id`` and the counts of every row, with its cross entropy."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of()
        for batch in batches:
            for lang, part in _by_lang(batch):
                texts = _texts(part)
                counts = pd.DataFrame([base_counts(t) for t in texts], columns=names, index=part.index)
                yield counts.assign(id=part["doc_id"], lang=lang, entropy=cross_entropies(texts, lang, model))

    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    return ids.mapInPandas(run, "id STRING, lang STRING, " + ", ".join(f"{n} LONG" for n in names) + ", entropy DOUBLE")


def score(docs: DataFrame, order: int = ORDER, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """``id, lang``, the base counts and ``entropy`` of every row under the model of all rows' texts.

    The counts of a task are added up before they are shuffled. A model of up to ``model_bytes`` goes to every task; a larger one is
    joined to the n-grams of each split of the input and a task reads the part for its split, so no task holds
    more than its own texts' n-grams. The input must then be split alike both times, as files are; otherwise the scan fails.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "lang", "text")
    counted = gram_counts(docs, order)
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    model = kneser_ney(stored(total, "grams"), order)
    model = stored(model, "model")
    if model.count() * 12 <= model_bytes:
        whole = spark.sparkContext.broadcast(loaded(model, order))
        return _scored(docs, lambda: whole.value)
    return _scored(docs, _parts_of(spark, stored(gram_counts(docs, order).select("part", "lang", "gram").distinct(), "split-grams"), model, order))


def _parts_of(spark: SparkSession, asked: DataFrame, model: DataFrame, order: int) -> Callable[[], Model]:
    """Write the highest order's values that each split asks for; return what loads them in a task of that split."""
    best = model.where(F.col("slot") == order).select(F.col("lang").alias("l"), F.col("gram").alias("g"), "slot", "value")
    rows = asked.join(best, asked["lang"].eqNullSafe(F.col("l")) & (asked["gram"] == F.col("g"))).drop("l", "g")
    path = scratch_path(spark, "split-models")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed_rows(rows).repartition(parts, "part").sortWithinPartitions("part", "lang", "hash").write.partitionBy("part").parquet(path)

    def load() -> Model:
        system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        folder, out = f"{root}/part={TaskContext.get().partitionId()}", Model(order)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            table = ds.dataset(folder, filesystem=system, format="parquet").to_table(["lang", "hash", "value"]).to_pandas()
            for lang, part in _by_lang(table):
                known, values = part["hash"].to_numpy("i8").view(np.uint64), part["value"].to_numpy("f4")
                by = np.argsort(known, kind="stable")
                out.arrays[lang, order] = known[by], values[by]
        out.find = _strict(out)
        return out

    return load


def _strict(model: Model) -> Callable:
    plain = model.find

    def find(lang: str | None, slot: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there, values = plain(lang, slot, wanted)
        if not there.all():
            raise ValueError("the input was split otherwise than when it was counted; store it before")
        return there, values

    return find


def _median(rows: DataFrame, name: str) -> DataFrame:
    """Lower median of ``v`` for each language from counts of its values, of which there are some ten thousands."""
    counts = rows.groupBy("lang", "v").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("lang")
    upto = F.sum("c").over(whole.orderBy("v"))
    placed = counts.select("lang", "v", upto.alias("upto"), F.sum("c").over(whole).alias("all"))
    return placed.where(F.col("upto") * 2 >= F.col("all")).groupBy("lang").agg(F.min("v").alias(name))


def bands(scored: DataFrame, below: float, above: float, least: float) -> DataFrame:
    """``lang, lower, upper`` of the cross entropy: the median of a language's documents that pass the base rules, less ``below`` and
    plus ``above`` times their median distance from it, which counts as ``least`` nats at least. Values are cut to 0.0001 nats for this."""
    rows = scored.where(~F.col("base_failed") & F.col("entropy").isNotNull()).select("lang", F.round(F.col("entropy") * 10_000).cast("long").alias("v"))
    rows = stored(rows, "entropies")
    middle = stored(_median(rows, "middle"), "entropy-medians")
    side, _ = small_side(middle)
    away = rows.join(side.withColumnRenamed("lang", "l"), rows["lang"].eqNullSafe(F.col("l"))).select("lang", F.abs(F.col("v") - F.col("middle")).alias("v"))
    spread = stored(_median(away, "spread"), "entropy-spreads")
    width = F.greatest(F.col("spread") / 10_000, F.lit(least))
    both = middle.join(spread.withColumnRenamed("lang", "l"), middle["lang"].eqNullSafe(F.col("l")))
    centre = F.col("middle") / 10_000
    return both.select("lang", (centre - below * width).alias("lower"), (centre + above * width).alias("upper"))


def judge(
    docs: DataFrame, below: float = 6.0, above: float = 5.0, least: float = 0.01, order: int = ORDER, model_bytes: int = MODEL_BYTES
) -> DataFrame:
    """Every row's ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, entropy, kept``.

    Fewer than 50 words, or more than half of them in repeated windows of three, fail the base rules. Of the rest those are kept
    whose cross entropy (the log of the perplexity) lies in the band of their language; see ``bands``.

    A null text has no words, a null language is one of its own. Empty texts have no entropy and fail. Very long texts are cut into
    overlapping parts, nothing is left out. Repeated rows count as often as they occur and get equal results. An
    empty table gives no rows. Columns other than ``doc_id, lang, text`` are not looked at.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    entropy = F.when(~F.isnan("entropy"), F.col("entropy"))
    rows = stored(score(docs, order, model_bytes).withColumn("base_failed", failed).withColumn("entropy", entropy), "quality")
    side, _ = small_side(stored(bands(rows, below, above, least), "quality-bands"))
    rows = rows.join(side.withColumnRenamed("lang", "l"), rows["lang"].eqNullSafe(F.col("l")), "left")
    inside = F.coalesce(F.col("entropy").between(F.col("lower"), F.col("upper")), F.lit(False))
    return rows.select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "entropy", "lower", "upper", (~F.col("base_failed") & inside).alias("kept"),
    )
