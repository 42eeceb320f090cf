"""Files written by executors, one at a time and line by line, on any shared file system."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from framewright.session import shuffles_removed

def open_fs(root: str) -> tuple[pafs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def ensure_output(root: str, overwrite: bool = False) -> None:
    """Refuse a folder that holds something, unless told to write over it."""
    fs, base = open_fs(root)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.Directory and not overwrite:
        if fs.get_file_info(pafs.FileSelector(base, recursive=False)):
            raise FileExistsError(f"output folder is not empty: {root}")
    fs.create_dir(base, recursive=True)


class _Target:
    """A file that appears under its name only when complete, so a repeated task is harmless. A ``packed`` one is a piece that never gets its name."""

    def __init__(self, fs: pafs.FileSystem, path: str, packed: bool = False) -> None:
        folder, _, name = path.rpartition("/")
        fs.create_dir(folder, recursive=True)
        self.fs, self.path, self.temp = fs, path, f"{folder}/.{name}.{uuid.uuid4().hex}{_PACKED if packed else ''}"
        self.out = fs.open_output_stream(self.temp, compression="zstd" if packed else None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def named(self) -> None:
        self.fs.move(self.temp, self.path)

    def done(self) -> None:
        self.out.close()
        self.named()


class _Lines:
    """A text file under way: lines come in runs of one section; the last one's newline is written when the file ends, to a packed piece never."""

    def __init__(self, target: _Target, part: int, newline: bytes) -> None:
        self.target, self.part, self.newline, self.lines = target, part, newline, 0
        self.first = self.last = None

    def add(self, text: memoryview, lines: int, section: str | None) -> None:
        if self.lines:
            self.target.write(b",\n" if section is not None and section == self.last else b"\n")
        else:
            self.first = section
        self.target.write(text)
        self.last, self.lines = section, self.lines + lines

    def end(self) -> None:
        self.target.write(self.newline if self.lines and not self.target.temp.endswith(_PACKED) else b"")
        self.target.out.close()


_PACKED = ".zst"
_PIECES = "rel STRING, part INT, temp STRING, lines BIGINT, first STRING, last STRING"
_NAMES = ("rel", "part", "temp", "lines", "first", "last")
_SCHEMA = pa.schema(list(zip(_NAMES, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()))))


def _changes(column: pa.Array) -> np.ndarray:
    """Positions at which a value differs from the one before, the end included."""
    return pc.run_end_encode(column).run_ends.to_numpy()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each text begins and the last one ends, and the bytes that all of them share."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    return ends, memoryview(b"" if data is None else data)


def write_lines(lines: DataFrame, root: str, order: list[str], final_newline: bool = True) -> None:
    """Write ``rel, line`` rows as text files below ``root``, lines in the given order.

    Rows may carry ``section``: consecutive lines of one non-null section are separated by commas
    (elements of a JSON list). A null line makes an empty file.

    Rows are cut into ranges of file and order, so a file of any size is sorted and written by as many tasks as it fills. What lies
    whole in a range gets its name at once; the pieces of a file that goes on in the next range are put together at the end, byte by byte.
    A range's first file may have begun before and is written packed, so that a large file does not lie on disk twice.
    Lines get their separator from Spark, so a run of lines is written as the bytes that follow each other in the Arrow batch.
    """
    spark = lines.sparkSession
    if "section" not in lines.columns:
        lines = lines.withColumn("section", F.lit(None).cast("string"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    ready = lines.repartitionByRange(ranges, "rel", *order).sortWithinPartitions("rel", *order)
    text = F.concat("line", F.when(F.col("section").isNull(), "\n").otherwise(",\n"))
    ready = ready.select("rel", "section", text.alias("line"), F.spark_partition_id().alias("part"))
    newline = b"\n" if final_newline else b""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        current, held, file = None, [], None

        def piece(rel: str, f: _Lines) -> tuple:
            return rel, f.part, f.target.temp, f.lines, f.first, f.last

        for batch in batches:
            if not len(batch):
                continue
            rels, sections, texts, parts = batch.columns
            offsets, data = _bytes_of(texts)
            at = 0
            for end in np.union1d(_changes(rels), _changes(sections)).tolist():
                rel, section = rels[at].as_py(), sections[at].as_py()
                if file is None or rel != current:
                    if file is not None:
                        file.end()
                        if held:
                            file.target.named()
                        else:
                            held.append(piece(current, file))  # the first file may have begun in the range before
                    current, file = rel, _Lines(_Target(fs, f"{base}/{rel}", packed=current is None), parts[at].as_py(), newline)
                some = end - at - texts.slice(at, end - at).null_count
                if some:
                    file.add(data[offsets[at] : offsets[end] - (1 if section is None else 2)], some, section)
                at = end
        if file is not None:
            file.end()
            held.append(piece(current, file))  # the last one may go on in the next
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, h)) for h in held], _SCHEMA)

    with shuffles_removed(spark):
        found = ready.mapInArrow(save, _PIECES).collect()  # two rows a range
    files: dict[str, list[Row]] = {}
    for row in sorted(found, key=lambda r: (r["rel"], r["part"])):
        files.setdefault(row["rel"], []).append(row)
    if not files:
        return

    def text_of(fs: pafs.FileSystem, temp: str) -> Iterator[bytes]:
        """Blocks of a piece without its last newline."""
        if temp.endswith(_PACKED):
            with fs.open_input_stream(temp, compression="zstd") as f:
                while data := f.read(8 << 20):
                    yield data
        else:
            with fs.open_input_file(temp) as f:
                left = f.size() - len(newline)
                while left > 0:
                    data = f.read(min(left, 8 << 20))
                    yield data
                    left -= len(data)

    def join(todo: Iterable[Row]) -> None:
        fs, base = open_fs(root)
        for row in todo:
            pieces = [p for p in row["pieces"] if p["lines"]] or row["pieces"][:1]
            if len(pieces) == 1 and not pieces[0]["temp"].endswith(_PACKED):
                if fs.get_file_info(pieces[0]["temp"]).type == pafs.FileType.File:  # a repeated task finds it moved
                    fs.move(pieces[0]["temp"], f"{base}/{row['rel']}")
            else:
                target, before = _Target(fs, f"{base}/{row['rel']}"), None
                for p in pieces:
                    if before is not None:
                        target.write(b",\n" if p["first"] is not None and p["first"] == before["last"] else b"\n")
                    for data in text_of(fs, p["temp"]):
                        target.write(data)
                    before = p
                target.write(newline if before["lines"] else b"")
                target.done()

    def clear(todo: Iterable[Row]) -> None:
        fs, _ = open_fs(root)
        for row in todo:
            for p in row["pieces"]:
                if fs.get_file_info(p["temp"]).type == pafs.FileType.File:
                    fs.delete_file(p["temp"])

    todo = spark.createDataFrame([(rel, pieces) for rel, pieces in files.items()], f"rel STRING, pieces ARRAY<STRUCT<{_PIECES}>>")
    todo = todo.repartition(min(len(files), ranges))
    todo.foreachPartition(join)
    todo.foreachPartition(clear)  # pieces stay until all files stand, so that a repeated task finds them


def write_records(rows: DataFrame, root: str, order: list[str], kind: str = "<f4") -> int:
    """Write ``rel`` and numbers (all columns but ``rel`` and ``order``) as files of fixed records below ``root``, in the given order.

    A task appends Arrow batches to one file after the other, so memory does not depend on the size of a file. Returns the bytes written.
    """
    values = [c for c in rows.columns if c not in ("rel", *order)]
    ready = rows.repartition("rel").sortWithinPartitions("rel", *order).select("rel", *[F.col(c).cast("double") for c in values])

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(root)
        current, target, size = None, None, 0
        for batch in batches:
            for rel, part in batch.groupby("rel", sort=False):
                if rel != current:
                    if target is not None:
                        target.done()
                    current, target = rel, _Target(fs, f"{base}/{rel}")
                data = part[values].to_numpy().astype(kind).tobytes()
                target.write(data)
                size += len(data)
        if target is not None:
            target.done()
        yield pd.DataFrame({"bytes": [size]})

    return ready.mapInPandas(save, "bytes BIGINT").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def write_blobs(files: DataFrame, root: str) -> None:
    """Write ``rel, data`` rows as binary files below ``root``."""

    def save(rows: Iterable[Row]) -> None:
        fs, base = open_fs(root)
        for row in rows:
            target = _Target(fs, f"{base}/{row['rel']}")
            target.write(bytes(row["data"]))
            target.done()

    files.select("rel", "data").foreachPartition(save)
