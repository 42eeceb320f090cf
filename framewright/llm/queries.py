"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import (
    decontaminate, embedding_dedup, html_extract, importance, licenses, merkle, mixing, ngram_join, perplexity, secrets, toxicity,
    training_order, url_filter,
)
from framewright.llm.common import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        LLM_QUERIES[name] = fn
        if oracle is not None:
            LLM_ORACLES[name] = oracle
        return fn

    return register


_MIX_SQL = r"""
WITH labelled AS (
  SELECT doc_id, coalesce(avg(quality), 0.5) + 0.5 AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, d.text,
    (('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370497.0 AS draw,
    coalesce(l.weight, 1.0) AS weight
  FROM documents d LEFT JOIN labelled l ON d.doc_id = l.doc_id
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w,
    row_number() OVER (ORDER BY source IS NULL, source) AS n, sum(size)::DOUBLE * 2.0 AS cap
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), common AS (
  SELECT min_by(level, (cap / w, n)) AS c FROM levels WHERE level * w < cap
), targets AS (
  SELECT source, source_size, coalesce(least(cap, c * w), cap) AS target FROM levels, common
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY -ln(s.draw) / s.weight, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - (upto - size))))::BIGINT AS taken
FROM ranked
"""


@query("op1_source_mixing", _MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.quality_weights(table(spark, sf_dir, "labels"))
    rows = mixing.mix(table(spark, sf_dir, "documents"), quality)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


#: Words of licence terms that may follow "copyright" at the start of a line.
_COPYRIGHT_TERMS = """
notice notices holder holders owner owners owned license licence licenses licences law laws statement statements interest interests disclaimer
disclaimers permission permissions right rights protection protections act acts treaty treaties condition conditions and or the on in of is are to for
as with that this which information status material infringement applies
"""


def _license_sql() -> str:
    line = "lower(l)"
    for old, new in licenses.SPELLINGS:
        line = f"replace({line}, '{old}', '{new}')"
    canonical = rf"trim(regexp_replace({line}, '[^a-z0-9\x{{80}}-\x{{200F}}\x{{2040}}-\x{{10FFFF}}]+', ' ', 'g'))"
    opens, blank = "^[^0-9A-Za-z©]*", r"[\t\n\x0B\f\r ]"
    named = rf"{opens}(©|all rights reserved|\(c\){blank}*(copyright|.*[0-9]{{4}})|copyright:?{blank}*(\(c\)|©|[0-9]{{4}}))"
    holder = rf"{opens}copyright:?{blank}+[^\t\n\x0B\f\r ]"
    terms = rf"{opens}copyright:?{blank}+({'|'.join(_COPYRIGHT_TERMS.split())})\b"
    wrapped = "array_to_string(units, ' ')"
    for old, new in licenses.SPELLINGS:
        if " " in old:
            wrapped = f"replace({wrapped}, '{old}', '{new}')"
    known: dict[str, str] = {}
    for digest, name in [*licenses.known_digests(), *licenses.LONG_TEXTS]:
        known.setdefault(digest, name)
    values = ", ".join(f"('{d}', '{n}')" for d, n in known.items())
    return rf"""
WITH known(digest, license) AS (VALUES {values}), numbered AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda l: CASE WHEN regexp_matches(lower(l), '{named}') OR regexp_matches(lower(l), '{holder}') AND NOT regexp_matches(lower(l), '{terms}')
      THEN '' ELSE {canonical} END), lambda c: c <> '') AS units,
    len(string_split(text, chr(10))) AS n_lines
  FROM documents
), whole AS (
  SELECT r, doc_id, n_lines, units, CASE WHEN units IS NOT NULL THEN sha256({wrapped}) END AS digest FROM numbered
), found AS (
  SELECT u.r, count(*) AS n_notices, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices
  FROM (SELECT r, unnest(units) AS line FROM whole WHERE n_lines > 1) u JOIN known k ON sha256(u.line) = k.digest GROUP BY u.r
)
SELECT w.doc_id, w.digest, k.license, coalesce(f.n_notices, 0)::BIGINT AS n_notices,
  CASE WHEN w.digest IS NOT NULL THEN coalesce(f.notices, '') END AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN found f ON w.r = f.r
"""


@query("op2_license_scan", _license_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_DECONTAMINATE_SQL = rf"""
WITH items AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), keyed AS (
  SELECT item_id, len(win) AS n, array_to_string(win, ' ') AS k FROM windows
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), runs AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM keyed) WHERE len(w) >= n)
), found AS (
  SELECT r, i, runs.n, item_id FROM runs JOIN keyed ON runs.k = keyed.k AND runs.n = keyed.n
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), listed AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)
"""


@query("op3_benchmark_decontamination", _DECONTAMINATE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.drop("text_key")


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op6_training_order")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialize_order(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op9_embedding_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_join.near_copies(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id")


@query("op11_quality_rules")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perplexity.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: CRC-32 by its table of 256 remainders, made from the polynomial.
_CRC_TABLE = r"""
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) bytes(i)
  )
)"""


def _crc_sql(data: str) -> str:
    """CRC-32 of the UTF-8 bytes of a string; the table ``crc_table`` must be in the FROM clause."""
    hexed = f"hex(encode({data}))"
    numbers = f"list_transform(range(0, strlen({data})), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({numbers}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLD_STEP = """
  SELECT f.r, f.tree, f.lvl + 1, f.pos // 8, (f.n + 7) // 8,
    sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.folded ELSE u.digest END, '' ORDER BY u.pos)),
    f.proof || coalesce(string_agg(CASE WHEN u.pos <> f.pos THEN u.digest END, '' ORDER BY u.pos), '')
  FROM {fold} f JOIN {up} u ON u.tree = f.tree AND u.lvl = f.lvl AND u.pos // 8 = f.pos // 8
  WHERE f.n > 1 GROUP BY f.r, f.tree, f.lvl, f.pos, f.n, f.folded, f.proof
"""
_UP_STEP = """
  SELECT tree, lvl + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM {up} WHERE n > 1 GROUP BY tree, lvl, pos // 8
"""
_MANIFEST_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE.strip()}, leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '0') AS tree, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_crc_sql("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql(_LOWER)} END AS tampered
  FROM documents, crc_table
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), up(tree, lvl, pos, n, digest) AS (
  SELECT tree, 0, pos, n, leaf FROM placed UNION ALL {_UP_STEP.format(up="up")}
), tops AS (
  SELECT tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), above(tree, lvl, pos, n, digest) AS (
  SELECT '', 0, pos, n, digest FROM tops UNION ALL {_UP_STEP.format(up="above")}
), fold(r, tree, lvl, pos, n, folded, proof) AS (
  SELECT r, tree, 0, pos, n, coalesce(tampered, leaf), '' FROM placed UNION ALL {_FOLD_STEP.format(fold="fold", up="up")}
), rest(r, tree, lvl, pos, n, folded, proof) AS (
  SELECT f.r, '', 0, t.pos, t.n, f.folded, f.proof FROM fold f JOIN tops t ON f.tree = t.name WHERE f.n = 1
  UNION ALL {_FOLD_STEP.format(fold="rest", up="above")}
)
SELECT p.doc_id, p.leaf, t.digest AS subroot, a.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = a.digest AS verified
FROM placed p JOIN tops t ON p.tree = t.name JOIN rest e ON p.r = e.r AND e.n = 1 JOIN above a ON a.n = 1
"""


@query("op12_merkle_manifest", _MANIFEST_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


_RESAMPLE_SQL = rf"""
WITH {_CRC_TABLE.strip()}, docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), tokens AS (
  SELECT r, unnest(w) AS word FROM docs UNION ALL SELECT NULL, unnest({_WORDS}) FROM benchmark
), vocabulary AS (
  SELECT word, {_crc_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM tokens), crc_table
), placed AS (
  SELECT r, bucket FROM tokens JOIN vocabulary USING (word)
), totals AS (
  SELECT count(r) AS s, count(*) - count(r) AS t FROM placed
), gains AS (
  SELECT bucket, floor(1000 * ln((count(*) - count(r) + 1)::DOUBLE * (any_value(totals.s) + 10000)::DOUBLE
      / ((count(r) + 1)::DOUBLE * (any_value(totals.t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM placed, totals GROUP BY bucket
), weights AS (
  SELECT r, count(*) AS n, sum(gain) AS total FROM placed JOIN gains USING (bucket) WHERE r IS NOT NULL GROUP BY r
), scored AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM docs d LEFT JOIN weights USING (r)
), final AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n
  FROM final
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM ranked
"""


@query("op13_importance_resampling", _RESAMPLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
