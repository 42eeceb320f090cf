"""File inventories, format detection and line-numbered text scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions by kind.
IMAGE = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp", ".gif")
VIDEO = (".mp4", ".avi", ".mov", ".mkv", ".webm", ".wmv", ".flv")
POINTCLOUD = (".las", ".laz", ".pcd", ".ply", ".xyz", ".pts", ".e57", ".bin")
ANNOTATION = (".json", ".xml", ".txt", ".csv", ".yaml", ".yml")


def plain_path(path: Column) -> Column:
    """Path without the ``file:`` scheme of local files."""
    return F.regexp_replace(path, r"^file:/+", "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def kind(ext: Column) -> Column:
    return (
        F.when(ext.isin(*IMAGE), "image")
        .when(ext.isin(*VIDEO), "video")
        .when(ext.isin(*POINTCLOUD), "pointcloud")
        .when(ext.isin(*ANNOTATION), "annotation")
        .otherwise("other")
    )


def describe(files: DataFrame) -> DataFrame:
    """Add ``extension`` and ``kind`` to a table with ``path``."""
    return files.withColumn("extension", extension(F.col("path"))).withColumn(
        "kind", kind(F.col("extension"))
    )


def inventory(spark: SparkSession, root: str, max_depth: int | None = None) -> DataFrame:
    """Files below ``root`` with size and kind; contents are never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"))
    )
    if max_depth is not None:
        base = plain_path(F.lit(root.rstrip("/")))
        below = F.substr("path", F.length(base) + 2)
        files = files.where(F.size(F.split(below, "/")) <= max_depth)
    return describe(files)


def scan_summary(files: DataFrame) -> DataFrame:
    """Counts by kind, total size and the primary type."""
    per = files.agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}_files")
          for k in ("image", "video", "pointcloud", "annotation", "other")],
    )
    i, v, p = (F.col(f"{k}_files") > 0 for k in ("image", "video", "pointcloud"))
    primary = (
        F.when(i & ~v & ~p, "images").when(v & ~i & ~p, "video").when(p & ~i & ~v, "pointcloud")
        .otherwise("mixed")
    )
    return per.withColumn("primary_type", primary)


def top_extensions(files: DataFrame, limit: int = 10) -> DataFrame:
    return (
        files.groupBy("extension").agg(F.count(F.lit(1)).alias("files"))
        .orderBy(F.desc("files"), "extension").limit(limit)
    )


def detect_formats(files: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Dataset format of each root: the first that fits of yolo, coco, voc, kitti, cvat, nuscenes,
    openlabel. ``files``: root, rel (path below the root). ``heads`` (root, rel, head) holds the
    beginning or text of yaml, json and xml files at the top of a root for the content rules.
    """
    rel = F.col("rel")
    text = files.withColumn("head", F.lit(None).cast("string")) if heads is None else files.join(
        heads, ["root", "rel"], "left"
    )
    head = F.coalesce(F.col("head"), F.lit(""))
    top = ~F.contains(rel, F.lit("/"))
    rules = {
        "yolo": (rel == "data.yaml") | (top & rel.endswith(".yaml") & head.rlike(r"(?m)^(train|val)\s*:")),
        "coco": rel.rlike(r"^annotations/[^/]+\.json$")
        | (top & rel.endswith(".json") & head.rlike(r'"images"\s*:') & head.rlike(r'"annotations"\s*:')),
        "voc": rel.rlike(r"^Annotations/[^/]+\.xml$"),
        "kitti": rel.rlike(r"^((training|testing|train|val|test)/)?label_2/"),
        "cvat": top & rel.endswith(".xml") & head.rlike(r"^\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<annotations[\s>]"),
        "nuscenes": rel.rlike(r"^v1\.0[^/]*/sample_annotation\.json$"),
        "openlabel": top & rel.endswith(".json") & head.rlike(r'"openlabel"\s*:'),
    }
    per = text.groupBy("root").agg(*[F.max(c).alias(n) for n, c in rules.items()])
    found = F.lit(None).cast("string")
    for name in reversed(list(rules)):
        found = F.when(F.col(name), name).otherwise(found)
    return per.select("root", found.alias("format"))


def numbered_lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``path, line_no, line`` of small text files: each file is one record that is cut on the
    JVM, so line numbers are exact. For large files use ``split_lines``."""
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .text(root, wholetext=True)
        .select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value"))
    )
    return raw.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def words(text: Column) -> Column:
    """Parts of a text between runs of white space. Where only single spaces part them no pattern is needed, which Spark would compile a row."""
    other = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\n", "\x0b", "\f", "\r")])
    return F.when(other, F.split(text, r"\s+")).otherwise(F.split(text, " "))


def once(value: Column) -> Column:
    """A value as the output of a generator of one row: filters above it are not moved below, where they would work it out again."""
    return F.explode(F.array(value))


def line_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``path`` of the files of ``numbered_lines``, as it stands there; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(plain_path(F.col("_metadata.file_path")).alias("path"))


def split_lines(spark: SparkSession, paths, glob: str = "*") -> DataFrame:
    """``path, offset, line`` of text files of any size, read in splits. ``offset`` orders the
    lines of a file: start of the split, then position inside it."""
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(paths)
        .select(
            plain_path(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_mid"),
            F.col("value").alias("line"),
        )
    )
    return raw.select("path", F.struct("_start", "_mid").alias("offset"), "line")


def images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images below ``root``: path, width, height, nChannels, data; all null but the path of those
    that cannot be read."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root)
    readable = F.col("image.width") > 0
    return raw.select(
        plain_path(F.col("image.origin")).alias("path"),
        *[F.when(readable, F.col(f"image.{c}")).alias(c) for c in ("width", "height", "nChannels", "data")],
    )


def unreadable_images(spark: SparkSession, root: str) -> DataFrame:
    """Finding per image that cannot be decoded."""
    return images(spark, root).where("width IS NULL").select("path", F.lit("unreadable_image").alias("issue"))


def image_dimensions(spark: SparkSession, root: str) -> DataFrame:
    return images(spark, root).select("path", "width", "height")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
