"""Mixing sources to target weights: weighted sampling without replacement down to token budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import same, stored, whole_row

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of the sampling order within a source. One bucket is ranked by one task.
BUCKETS = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weights(labels: DataFrame, neutral: float = 0.5, floor: float = 0.5) -> DataFrame:
    """``doc_id, weight``: mean quality label (repeated labels) plus ``floor``, so that no document is
    out of reach. Documents without a label weigh ``neutral + floor``, see ``mix``."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.coalesce(F.avg(F.col("quality").cast("double")), F.lit(neutral)) + floor).alias("weight")
    )


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, repeat: int) -> DataFrame:
    """Budget of every source by water filling. ``sizes``: ``source, source_size``, one row per source.

    The sources in order of code points, null last, take ``weights`` in turn. Together they get
    ``share`` times all words; a source stops at ``repeat`` times its own size and the excess goes to the
    others by weight. Sorted by the level at which each stops, the ones that stop are a prefix, so the
    common level of the rest is one division. The windows see one row per source, never documents.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("_n", F.row_number().over(by_name) - 1).withColumn(
        "_w", F.element_at(turn, (F.col("_n") % len(weights) + 1).cast("int"))
    ).withColumn("_cap", F.col("source_size") * F.lit(float(repeat)))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "_n")
    everyone = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everyone) * F.lit(float(share)) - before) / rest
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn("_open", F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.col("_level")))
    common = F.first("_open", ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return rows.withColumn("_common", common).select(
        "source", "source_size", F.coalesce(F.least("_cap", F.col("_common") * F.col("_w")), "_cap").alias("target")
    )


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    repeat: int = 2,
    seed: int = 7,
    neutral: float = 1.0,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per document row: ``doc_id, text_key, size, source_size, target, epochs, part, taken``.

    Every source first gives its complete epochs (``floor(target / source_size)``). The rest of its
    budget is a weighted sample without replacement: each document draws an exponential key divided
    by its quality weight (``quality``: ``doc_id, weight``), documents are sorted by key and their sizes
    summed until the budget is reached; the document on the border gives its first ``part`` words, so a
    source meets its target to the word.

    The sorted prefix sum never gathers a source: the key is cut into ``buckets`` of equal probability
    whose sums are added up per source, and only rows within a bucket are ranked together.

    Null texts count 0 words. Null sources form a source of their own. Null ids draw one common key.
    Equal keys are ordered by id, size and text hash, so repeated rows are interchangeable. An empty table
    gives an empty result. Columns other than ``doc_id, text, source`` are not looked at.
    """
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key")
    )
    if quality is not None:
        rows = rows.join(quality.select("doc_id", "weight"), "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(neutral))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("string")))
    draw = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(2**52 + 1))
    rows = rows.withColumn("_key", -F.log(draw) / F.coalesce("weight", F.lit(neutral)))
    bucket = F.least(F.floor((1 - F.exp(-F.col("_key"))) * buckets), F.lit(buckets - 1)).cast("int")
    rows = stored(rows.withColumn("_bucket", bucket).drop("weight"), "mix-keys")

    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_in"))
    per_source = sums.groupBy("source").agg(F.sum("_in").alias("source_size"))
    targets = source_targets(per_source, weights, share, repeat)
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_in").over(earlier), F.lit(0))).drop("_in")
    starts = starts.join(targets, same(starts, targets, "source"), "left").select(
        starts["source"], "_bucket", "_start", "source_size", "target"
    )
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", "text_key")
    ranked = rows.withColumn("_upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    full = ranked.join(starts, same(ranked, starts, "source", "_bucket")).drop(starts["source"], starts["_bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    ahead = F.col("_start") + F.col("_upto") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - ahead))
    return (
        full.withColumn("epochs", epochs.cast("long"))
        .withColumn("part", part.cast("long"))
        .select(
            "doc_id", "text_key", "size", "source_size", "target", "epochs", "part",
            (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        )
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space kept."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row per complete epoch and one for the part.

    Documents without words, which no budget counts, stay once. Repeated rows of one id and text are
    numbered, and the n-th takes the n-th share of that id and text. The texts are shuffled once.
    """
    key = F.xxhash64("doc_id", "text_key").alias("key")
    share = F.struct(F.col("taken"), "size", "epochs", "part")
    shares = mixed.groupBy(key).agg(F.sort_array(F.collect_list(share), asc=False).alias("shares"))
    rows = docs.select(whole_row(docs), F.xxhash64("text").alias("text_key"), "doc_id")
    rows = rows.select("row", key).withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    both = rows.join(shares, "key").withColumn("share", F.element_at("shares", F.col("no")))
    size, epochs, part = (F.col(f"share.{x}") for x in ("size", "epochs", "part"))
    whole = F.when(size == 0, F.lit(1)).otherwise(epochs + F.when(part == size, 1).otherwise(0))
    copies = F.concat(
        F.array_repeat(F.lit(False), whole.cast("int")),
        F.array_repeat(F.lit(True), F.when((part > 0) & (part < size), 1).otherwise(0)),
    )
    both = both.withColumn("cut", F.explode(copies))
    text = F.when(F.col("cut"), first_words(F.col("row.text"), part)).otherwise(F.col("row.text")).alias("text")
    return both.select(*[text if name == "text" else F.col(f"row.`{name}`") for name in docs.columns])
