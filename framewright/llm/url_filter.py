"""URL filter: host and path lists, and association rules of URL tokens mined by FP-growth."""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import small_side, stored

#: verdict, host, path
LISTED = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
BLOCK, ALLOW = "label=block", "label=allow"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there
    up to ``?``, ``#`` or the end. Both empty for null and without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(tail, r"^[^?#]*", 0)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: labels and suffixes of the host, parts of the path, numbers as one token."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(
        F.filter(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda n: n <= F.size(labels)),
        lambda n: F.concat(F.lit("under="), F.array_join(F.slice(labels, -n, n), ".")),
    )
    parts = F.filter(F.split(F.lower(path), r"[/._-]+"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.when(F.regexp_like(x, F.lit("^[0-9]+$")), "path=#").otherwise(F.concat(F.lit("path="), x)))
    words = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))
    return F.array_distinct(F.concat(
        F.transform(words, lambda x: F.concat(F.lit("host="), x)), suffixes, parts
    ))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def mined_rules(labelled: DataFrame, support: float, confidence: float) -> tuple[DataFrame, DataFrame]:
    """``rule_id, tokens, verdict, confidence, support`` of the pruned rules from ``tokens, block``, and ``token, item``: which item of a
    rule a token stands for.

    Spark's FP-growth finds the frequent combinations of URL tokens with the label; those holding a label are
    divided by the frequency of the rest. A rule stays if it is confident and no rule of a part of its tokens
    is as confident. Combinations of any length count. Two steps before keep their number down and change no rule: a token that all
    its URLs share with one verdict is a rule of confidence 1 by itself, which no larger combination beats, and takes no further
    part; and tokens that occur in the same URLs are one item. So a long URL that is repeated a hundred times is a few items, not all
    combinations of its parts. What remains doubles with each further item that a frequent combination shares with URLs of the
    other verdict.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.where(F.size("tokens") > 0).withColumn("id", F.monotonically_increasing_id()), "url-baskets")
    n = rows.count()
    schema = "rule_id LONG, tokens ARRAY<STRING>, verdict STRING, confidence DOUBLE, support DOUBLE"
    if n == 0:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "token STRING, item STRING")
    each = rows.select("id", "block", F.explode(F.array_distinct("tokens")).alias("token"))
    tokens = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("block").alias("blocks"),
        F.bit_xor(F.xxhash64("id")).alias("one"), F.bit_xor(F.xxhash64(F.lit("two"), "id")).alias("two"),
    )
    least = max(1, math.ceil(support * n))
    tokens = stored(tokens.where(F.col("n") >= least), "url-tokens")
    pure = (F.col("blocks") == 0) | (F.col("blocks") == F.col("n"))
    mixed = tokens.where(~pure)
    heads = mixed.groupBy("n", "blocks", "one", "two").agg(F.min("token").alias("item"))
    items = stored(mixed.join(heads, ["n", "blocks", "one", "two"]).select("token", "item").unionByName(
        tokens.where(pure).select("token", F.col("token").alias("item"))), "url-items")
    alone = tokens.where(pure).select(
        F.array("token").alias("tokens"), F.when(F.col("blocks") > 0, "block").otherwise("allow").alias("verdict"), F.col("n").alias("both"), F.col("n").alias("all")
    )
    heads, _ = small_side(stored(heads.select(F.col("item").alias("token")), "url-heads"))
    baskets = each.join(heads, "token").groupBy("id").agg(F.collect_set("token").alias("items"), F.first("block").alias("block"))
    baskets = stored(baskets.select(F.concat("items", F.array(F.when(F.col("block"), BLOCK).otherwise(ALLOW))).alias("items")), "url-reduced")
    if not baskets.isEmpty():
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, baskets.count()))).fit(baskets).freqItemsets
        sets = stored(sets.select(F.array_sort("items").alias("items"), "freq"), "url-sets")
        label = F.when(F.array_contains("items", BLOCK), "block").when(F.array_contains("items", ALLOW), "allow")
        with_label = sets.withColumn("verdict", label).where("verdict IS NOT NULL").select(
            F.filter("items", lambda x: ~x.isin(BLOCK, ALLOW)).alias("tokens"), "verdict", F.col("freq").alias("both")
        ).where(F.size("tokens") > 0)
        plain = sets.select(F.col("items").alias("tokens"), F.col("freq").alias("all"))
        alone = alone.unionByName(with_label.join(plain, "tokens").select("tokens", "verdict", "both", "all"))
    rules = alone.withColumn("confidence", F.col("both") / F.col("all")).where(F.col("confidence") >= confidence)
    rules = stored(rules.select(
        F.xxhash64("tokens", "verdict").alias("rule_id"), "tokens", "verdict", "confidence", (F.col("both") / n).alias("support")), "url-rules")
    # A part of a rule's tokens: filed under its first token, looked up by all tokens of the rule, then compared.
    short = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("c"), F.get("tokens", F.lit(0)).alias("token"))
    long = rules.select("rule_id", "tokens", "verdict", "confidence", F.explode("tokens").alias("token")).where(F.size("tokens") > 1)
    beaten = long.join(short, ["token", "verdict"]).where(
        (F.size("part") < F.size("tokens")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0)
    ).select("rule_id").distinct()
    return stored(rules.join(beaten, "rule_id", "left_anti"), "url-kept"), items


def mine(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """The rules alone, see ``mined_rules``."""
    return mined_rules(labelled, support, confidence)[0]


def judge(
    pages: DataFrame,
    labels: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = LISTED,
    support: float = 0.005,
    confidence: float = 0.9,
) -> DataFrame:
    """One row per page row: ``page_id, host, path, rule, verdict, mined, confidence``.

    A listed rule decides where one fits, the longest first. Mined rules decide the rest: they are learned from
    URLs with a label, which is the list's verdict, or else that of ``labels`` (``doc_id``, 0/1 ``toxic``; the id
    of the page): toxic is block. A URL is matched by an inverted index: each mined rule is filed under its
    rarest token, looked up by the URL's tokens, and then all its tokens are compared. The most confident
    rule decides (ties: more tokens, then allow); a URL that none fits is allowed. ``mined`` is
    the deciding combination.

    Null URLs and URLs without ``://`` have empty host and path and are allowed. Conflicting
    labels of an id count as block. Equal URLs are judged once and repeated pages give repeated rows. Empty
    tables are fine. Columns other than ``page_id, url`` and ``doc_id, toxic`` are not looked at.
    """
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = listed_rule(F.col("host"), F.col("path"), rules)
    rows = urls.withColumn("listed", listed)
    tokens = url_tokens(F.col("host"), F.col("path"))
    train = rows.select("page_id", tokens.alias("tokens"), "listed")
    if labels is not None:
        marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        marks = marks.select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("mark"))
        train = train.join(marks, "page_id", "left")
    else:
        train = train.withColumn("mark", F.lit(None).cast("boolean"))
    block = F.coalesce(F.col("listed.verdict") == "block", F.col("mark"))
    mined, items = mined_rules(train.select("tokens", block.alias("block")).where("block IS NOT NULL"), support, confidence)

    open_urls = rows.where("listed IS NULL").select("host", "path").distinct()
    found = open_urls.select("host", "path", F.explode(tokens).alias("token")).join(small_side(items)[0], "token")
    open_urls = stored(found.groupBy("host", "path").agg(F.collect_set("item").alias("tokens")), "url-open")
    filed = mined.select("*", F.explode("tokens").alias("token"))
    common = filed.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    seen = open_urls.select(F.explode("tokens").alias("token"))
    seen = seen.join(small_side(common.select("token"))[0], "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    filed = filed.join(seen, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("urls", "token")).alias("token"))
    index = stored(filed.join(mined.select("rule_id", "tokens", "verdict", "confidence"), "rule_id").select(
        "token", F.col("tokens").alias("needs"), "verdict", "confidence"
    ), "url-index")
    index, _ = small_side(index, 100_000)
    met = open_urls.select("host", "path", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    met = met.where(F.size(F.array_except("needs", "tokens")) == 0)
    rank = F.struct("confidence", F.size("needs"), F.col("verdict") == "allow", F.array_join("needs", " "))
    best = met.groupBy("host", "path").agg(
        F.max_by(F.struct("verdict", F.array_join("needs", " ").alias("mined"), "confidence"), rank).alias("best")
    )
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce(F.col("listed.verdict"), F.col("best.verdict"), F.lit("allow")).alias("verdict"),
        F.when(F.col("listed").isNull(), F.col("best.mined")).alias("mined"),
        F.when(F.col("listed").isNull(), F.col("best.confidence")).alias("confidence"),
    )
