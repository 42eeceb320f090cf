"""Formats by name, and conversion from one to another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from framewright.model import Dataset
from framewright.operators.ranking import dense_ids
from framewright.session import passing

READERS: dict[str, Callable[..., Dataset]] = {}
WRITERS: dict[str, Callable[..., None]] = {}


def register(name: str, reader: Callable | None = None, writer: Callable | None = None) -> None:
    """Add or replace a format."""
    if reader:
        READERS[name] = reader
    if writer:
        WRITERS[name] = writer


def formats() -> list[str]:
    return sorted(READERS.keys() | WRITERS.keys())


def with_ordinals(ds: Dataset) -> Dataset:
    """Dense positions in path order, which writers number images by."""
    from pyspark.sql import functions as F

    samples = dense_ids(ds.samples.drop("ordinal"), [F.col("image_path"), F.col("sample_id")], "ordinal")
    return Dataset(samples, ds.labels, ds.classes, ds.name)


def convert(spark: SparkSession, source: str, path: str, target: str, out: str, **options) -> None:
    """Read one format and write another; nothing runs before the write."""
    if source not in READERS or target not in WRITERS:
        raise ValueError(f"unknown format: {source if source not in READERS else target}")
    with passing(spark):
        WRITERS[target](with_ordinals(READERS[source](spark, path)), out, **options)


def _builtin() -> None:
    from framewright.sinks import labels as S
    from framewright.sources import labels as R
    from framewright.sinks import scenes as scene_sinks
    from framewright.sources import scenes, yolo

    register("yolo", yolo.read_yolo, S.write_yolo)
    register("coco", R.read_coco, S.write_coco)
    register("kitti", R.read_kitti, S.write_kitti)
    register("voc", R.read_voc, S.write_voc)
    register("cvat", R.read_cvat, S.write_cvat)
    register(
        "nuscenes",
        lambda spark, path: scenes.read_nuscenes(scenes.nuscenes_tables(spark, path)),
        lambda ds, out, **kw: scene_sinks.write_nuscenes(scene_sinks.with_scene_ordinals(ds), out, **kw),
    )
    register(
        "openlabel",
        scenes.read_openlabel,
        lambda ds, out, **kw: scene_sinks.write_openlabel(scene_sinks.with_scene_ordinals(ds), out, **kw),
    )


_builtin()
