"""Benchmark decontamination: exact item windows found by their rarest shingle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import lower_ascii, small_side, stored, whole_row

#: ASCII letters and digits, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shingles(words: Column, size: int, of: str = "long") -> Column:
    """Array of (pos, hash) of all shingles of ``size`` words; pos counts from 0."""
    last = F.size(words) - size
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(words, i + 1, size)).alias("hash")))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``item_id, w``: every run of ``window`` words of an item; a shorter item is one window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    at = F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, window)))
    return items.select("item_id", at.alias("w")).distinct()


def occurrences(docs: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text_key, start, len, wid``: where windows stand in texts.

    ``windows``: ``wid, w``, stored. All tokens of a window must be in the text, so one token is a
    sufficient prefix: the rarest shingle by the number of texts that hold it. Only prefix shingles are joined
    with the texts' shingles; the offset of the shingle in the window gives the one possible start
    (positional bound), the window must end within the text (length bound), and the words there are compared
    with the window's. Windows of fewer words than ``shingle`` are their own shingle.
    """
    size = F.least(F.size("w"), F.lit(shingle))
    sized = windows.withColumn("size", size)
    sizes = sorted(r["size"] for r in sized.select("size").distinct().collect())  # 1 to `shingle`
    parts = []
    for n in sizes:
        part = sized.where(F.col("size") == n).withColumn("s", F.explode(shingles(F.col("w"), n)))
        parts.append(part.select("wid", "w", "size", F.col("s.pos").alias("offset"), F.col("s.hash").alias("hash")))
    if not parts:
        return docs.select("doc_id", F.xxhash64("text").alias("text_key")).where("false").withColumns(
            {"start": F.lit(0), "len": F.lit(0), "wid": F.lit(0).cast("long")}
        )
    tokens = parts[0]
    for part in parts[1:]:
        tokens = tokens.unionByName(part)
    tokens = stored(tokens, "bench-tokens")

    row_key = F.xxhash64("doc_id", F.xxhash64("text"))

    def here(words: Column) -> Column:
        return F.concat(*[shingles(words, n) for n in sizes])

    known, _ = small_side(tokens.select("hash").distinct())
    met = docs.select(row_key.alias("row_key"), words(F.col("text")).alias("words")).select(
        "row_key", F.explode(F.transform(here(F.col("words")), lambda s: s["hash"])).alias("hash")
    )
    met = stored(met.join(known, "hash").distinct(), "bench-met")
    counts = met.groupBy("hash").count()
    rarity = stored(tokens.join(counts, "hash", "left"), "bench-rarity")
    rarest = F.min_by(F.struct("offset", "hash", "w"), F.struct(F.coalesce("count", F.lit(0)), "hash", "offset"))
    prefix = rarity.where(F.col("count") > 0).groupBy("wid").agg(rarest.alias("p"))
    complete = rarity.groupBy("wid").agg(F.min(F.coalesce("count", F.lit(0))).alias("least")).where("least > 0")
    prefix = stored(prefix.join(complete, "wid", "left_semi").select("wid", "p.*"), "bench-prefix")

    prefix, broadcast = small_side(prefix, 100_000)
    hit, fits = small_side(met.select("row_key").distinct())
    rows = docs.select("doc_id", "text", row_key.alias("row_key"))
    rows = rows.join(hit, "row_key", "left_semi") if fits else rows  # beyond that, texts would be shuffled for little
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    at = rows.select("doc_id", "text_key", "words", F.explode(here(F.col("words"))).alias("s"))
    start, length = F.col("s.pos") - F.col("offset"), F.size("w")
    if broadcast:  # the words are only looked at where a prefix shingle was met, in the same stage
        met = at.join(prefix, F.col("s.hash") == F.col("hash"))
        ours = F.slice("words", start + 1, length)
        met = met.where((start >= 0) & (start + length <= F.size("words")))
        met = met.where(ours == F.col("w"))
    else:  # the words around a shingle travel with it, never the whole text; a Bloom filter thins them first
        most = prefix.agg(F.max(F.size("w"))).first()[0]
        low = F.greatest(F.col("s.pos") - most + 1, F.lit(0))
        around = F.slice("words", low + 1, 2 * most - 1)
        at = at.select("doc_id", "text_key", "s", low.alias("low"), around.alias("around"))
        met = at.join(prefix, F.col("s.hash") == F.col("hash")).where(start >= 0)
        met = met.where(F.slice("around", start - F.col("low") + 1, length) == F.col("w"))
    return met.select("doc_id", "text_key", start.alias("start"), length.alias("len"), "wid")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, percent: int = 5) -> DataFrame:
    """One row per document row: ``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word inside any occurrence of an item window is hit; a document is contaminated if at least ``percent``
    per cent of its words are, and one is.

    Null and empty texts have no words and are clean. Null and empty items have no windows. An item without
    an id still hits words, but is not counted or listed. Repeated documents give repeated rows,
    repeated items count once. An empty benchmark finds nothing. Columns other than
    ``doc_id, text`` and ``item_id, text`` are not looked at.
    """
    items = item_windows(benchmark, window)
    windows = stored(items.select("w").distinct().withColumn("wid", F.monotonically_increasing_id()), "bench-windows")
    of = items.join(windows, "w").select("wid", "item_id").where(F.col("item_id").isNotNull()).distinct()
    found = stored(occurrences(docs, windows, shingle).distinct(), "bench-found")

    key = F.xxhash64("doc_id", "text_key").alias("key")
    found = found.select(key, "start", "len", "wid")
    by_start = Window.partitionBy("key").orderBy("start", "len", "wid")
    end = F.col("start") + F.col("len")
    before = F.coalesce(F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = found.select("key", F.greatest(end - F.greatest("start", before), F.lit(0)).alias("new"))
    hits = hits.groupBy("key").agg(F.sum("new").alias("n_hit"))
    listed = found.select("key", "wid").distinct().join(of, "wid")
    listed = listed.groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    base = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words")
    )
    both = base.withColumn("key", key).join(hits, "key", "left").join(listed, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return both.select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns kept."""
    bad = stored(judged.where("contaminated").select(F.xxhash64("doc_id", "text_key").alias("key")).distinct(), "bench-bad")
    bad, _ = small_side(bad)
    rows = docs.select(whole_row(docs), F.xxhash64("text").alias("text_key"), "doc_id")
    rows = rows.select("row", F.xxhash64("doc_id", "text_key").alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")
