"""Point-cloud files: ASCII PCD and PLY, and float32 records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framewright.operators.cloud import normalize_intensity
from framewright.operators.ranking import with_rank
from framewright.sinks.files import open_fs
from framewright.sources.files import split_lines, words
from framewright.sources.records import listed

_PCD_WORDS = "VERSION|FIELDS|SIZE|TYPE|COUNT|WIDTH|HEIGHT|VIEWPOINT|POINTS|DATA"
_PLY_WORDS = "ply|format|comment|obj_info|element|property|end_header"


def _values(cols: dict[str, Column]) -> list[Column]:
    """Fields as numbers; what is not a number counts as 0."""
    return [F.coalesce(c.try_cast("double"), F.lit(0.0)).alias(n) for n, c in cols.items()]


def read_pcd(spark: SparkSession, root: str) -> DataFrame:
    """``path, point_idx, x, y, z, intensity`` of ASCII PCD files. Columns follow FIELDS, by
    default the first three; rows with fewer than three values go away."""
    lines = split_lines(spark, root, "*.pcd").withColumn("line", F.trim("line")).where("line <> ''")
    is_head = F.col("line").rlike(rf"^(#|({_PCD_WORDS})(\s|$))")
    names = F.split(F.regexp_extract("line", r"^FIELDS\s+(.*)$", 1), r"\s+")
    heads = lines.where(F.col("line").startswith("FIELDS")).groupBy("path").agg(
        F.first(names).alias("_fields")
    )
    rows = lines.where(~is_head).withColumn("_v", words(F.col("line"))).where(F.size("_v") >= 3)
    rows = rows.join(heads, "path", "left")

    def field(name: str, default: int | None) -> Column:
        pos = F.array_position("_fields", name)
        found = F.when(pos > 0, F.get("_v", (pos - 1).cast("int")))
        return F.coalesce(found, F.get("_v", F.lit(default))) if default is not None else found

    ranked = with_rank(rows, ["path"], [F.col("offset")], F.col("offset._start"), "point_idx")
    intensity = field("intensity", None)
    return ranked.select(
        "path", "point_idx", *_values({c: field(c, i) for i, c in enumerate("xyz")}),
        F.when(intensity.isNotNull(), F.coalesce(intensity.try_cast("double"), F.lit(0.0))).alias("intensity"),
    )


def read_ply(spark: SparkSession, root: str) -> DataFrame:
    """``path, point_idx, x, y, z`` of the vertices of ASCII PLY files."""
    lines = split_lines(spark, root, "*.ply").withColumn("line", F.trim("line")).where("line <> ''")
    is_head = F.col("line").rlike(rf"^({_PLY_WORDS})(\s|$)")
    n = F.regexp_extract("line", r"^element\s+vertex\s+(\d+)", 1)
    heads = lines.where(n != "").groupBy("path").agg(F.max(n.cast("bigint")).alias("_n"))
    rows = lines.where(~is_head)
    ranked = with_rank(rows, ["path"], [F.col("offset")], F.col("offset._start"), "point_idx")
    v = words(F.col("line"))
    return (
        ranked.join(heads, "path").where(F.col("point_idx") < F.col("_n"))
        .select("path", "point_idx", *_values({c: F.get(v, F.lit(i)) for i, c in enumerate("xyz")}))
    )


class FloatRecords(DataSource):
    """Files of little-endian float32 records (``x, y, z`` and the rest, of which the fourth is the intensity), read in byte ranges.

    Ranges begin and end between records, so a file of any size is read by as many tasks as it has ranges, and small files share a task.
    Options: ``path``, ``fields`` (4), ``rangeBytes`` (16 MB), ``glob`` suffix (``.bin``). A rest shorter than a record is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "float_records"

    def schema(self) -> str:
        return "path STRING, point_idx BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, intensity DOUBLE"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FloatReader(self.options)


class _Ranges(InputPartition):
    """Ranges ``(path, first record, number of records)`` of one task."""


class _FloatReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.fields = options["path"], int(options.get("fields", 4))
        if self.fields < 3:
            raise ValueError(f"a record has at least three fields, got {self.fields}")
        self.bytes, self.suffix = int(options.get("rangebytes", options.get("rangeBytes", 16 << 20))), options.get("glob", ".bin")

    def partitions(self) -> list[InputPartition]:
        """Listing only; no file is opened."""
        fs, base = open_fs(self.root)
        width, out, waiting, size = 4 * self.fields, [], [], 0
        step = max(1, self.bytes // width)
        for info in listed(fs, base, self.suffix):
            n = info.size // width
            for first in range(0, n, step):
                waiting.append((info.path, first, min(step, n - first)))
                size += waiting[-1][2]
                if size >= step:
                    out.append(_Ranges(waiting))
                    waiting, size = [], 0
        return [*out, _Ranges(waiting)] if waiting or not out else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.root)
        for path, first, n in partition.value:
            with fs.open_input_file(path) as f:
                for at in range(first, first + n, 100_000):
                    count = min(100_000, first + n - at)
                    f.seek(at * 4 * self.fields)
                    rec = np.frombuffer(f.read(count * 4 * self.fields), "<f4").reshape(-1, self.fields).astype(np.float64)
                    yield pa.record_batch({
                        "path": pa.array([path] * len(rec)), "point_idx": pa.array(np.arange(at, at + len(rec), dtype=np.int64)),
                        **{c: pa.array(rec[:, i]) for i, c in enumerate("xyz")},
                        "intensity": pa.array(rec[:, 3] if self.fields > 3 else np.zeros(len(rec))),
                    })


def read_float32(spark: SparkSession, root: str, fields: int = 4, range_bytes: int = 16 << 20) -> DataFrame:
    """``path, point_idx, x, y, z, intensity`` of files of little-endian float32 records; intensity
    above 1 is scaled down per file. See ``FloatRecords``."""
    spark.dataSource.register(FloatRecords)
    points = spark.read.format("float_records").option("fields", fields).option("rangeBytes", range_bytes).load(root)
    scaled = normalize_intensity(points.withColumnRenamed("path", "cloud_id"))
    return scaled.withColumnRenamed("cloud_id", "path")
