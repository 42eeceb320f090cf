"""Round trips through label and point formats, and corpus checks. Files are written by Spark from
the whole tables below the shared folder, then read back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framewright.model import Dataset
from framewright.operators import validate as V
from framewright.operators.qa import with_corners
from framewright.operators.review import file_stem
from framewright.plans import fixtures as X
from framewright.plans.fixtures import sql
from framewright.plans.registry import query
from framewright.session import finely, scratch_path
from framewright.sinks import files as W
from framewright.sinks import labels as S
from framewright.sources import calibration
from framewright.sources import files as FS
from framewright.sources import labels as R
from framewright.sources import points as P
from framewright.sources import registry, yolo

BOX = ("cx", "cy", "w", "h")


def _corpus(spark, sf, width=1280, height=720) -> Dataset:
    """One image per supplier, one box per line item of it."""
    path = F.concat(F.lit("/data/sup_"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".jpg"))
    samples = X.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("sample_id"), F.col("s_suppkey").alias("ordinal"), path.alias("image_path"),
        F.lit(width).alias("image_width"), F.lit(height).alias("image_height"),
        F.when(F.col("s_acctbal") > 0, "train").otherwise("val").alias("split"),
    )
    owner = X.spread(X.table(spark, sf, "lineitem")).select(
        F.col("l_suppkey").alias("sample_id"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("label_index"),
        F.concat("l_returnflag", "l_linestatus").alias("class_name"), X.class_id().alias("class_id"),
        F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("track_id"),
        *[_field(c) for c in (*BOX, "confidence")],
    )
    classes = X.classes(spark, sf)
    return Dataset(samples, owner, classes, "suppliers")


def _field(name):
    from framewright.model import unit

    exprs = {
        "cx": F.col("l_quantity") / 50,
        "cy": (F.col("l_extendedprice") % 1000) / 1000,
        "w": F.lit(0.02) + F.lit(9.8) * F.col("l_discount"),
        "h": F.lit(0.02) + F.lit(12.25) * F.col("l_tax"),
        "confidence": F.lit(1) - F.lit(5) * F.col("l_tax"),
    }
    return unit(exprs[name]).alias(name)


_SUP = """, own AS (SELECT l_suppkey, class_name, class_id, cx, cy, w, h, l_partkey, l_linestatus
    FROM (SELECT *, l_returnflag || l_linestatus AS class_name,
      ((CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END)
      + (CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END)) AS class_id,
      greatest(0, least(1, l_quantity / 50)) AS cx,
      greatest(0, least(1, (l_extendedprice % 1000) / 1000)) AS cy,
      greatest(0, least(1, CAST(0.02 AS DOUBLE) + CAST(9.8 AS DOUBLE) * l_discount)) AS w,
      greatest(0, least(1, CAST(0.02 AS DOUBLE) + CAST(12.25 AS DOUBLE) * l_tax)) AS h
      FROM lineitem)),
  sup AS (SELECT own.*, 'sup_' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stem,
    cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM own)"""
_PER_CLASS = """SELECT class_name, count(*) AS boxes, count(DISTINCT stem) AS images,
    round(avg(cx), 4) AS cx, round(avg(cy), 4) AS cy, round(avg(w), 4) AS w, round(avg(h), 4) AS h"""


def _images(ds: Dataset, folder) -> None:
    """Stand-ins for the image files (Spark lists no empty files)."""
    return ds.samples.select(
        F.concat(folder, F.regexp_extract("image_path", r"([^/]+)$", 1)).alias("rel"),
        F.lit("image").alias("line"), F.lit(0).alias("a"),
    )


def _per_class(labels, stem):
    return labels.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("boxes"), F.countDistinct(stem).alias("images"),
        *[F.round(F.avg(c), 4).alias(c) for c in BOX],
    )


def _yolo_root(spark, sf) -> str:
    ds = _corpus(spark, sf)
    root = scratch_path(spark, "yolo")
    S.write_yolo(ds, root)
    W.write_lines(_images(ds, F.concat("split", F.lit("/images/"))), root, ["a"])
    return root


@query(
    "read_yolo",
    sql(
        _SUP + """ SELECT stem, CASE WHEN s_acctbal > 0 THEN 'train' ELSE 'val' END AS split,
        class_name, class_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w,
        round(h, 6) AS h FROM sup JOIN supplier ON s_suppkey = l_suppkey""",
        "samples",
    ),
)
def read_yolo(spark, sf):
    ds = yolo.read_yolo(spark, _yolo_root(spark, sf))
    return ds.labels.join(ds.samples.select("sample_id", "stem", "split"), "sample_id").select(
        "stem", "split", "class_name", "class_id", *BOX
    )


@query(
    "write_yolo",
    sql(
        _SUP + """ SELECT stem, class_id || ' ' || printf('%.6f %.6f %.6f %.6f', cx, cy, w, h)
        AS line, count(*) AS n FROM sup GROUP BY 1, 2""",
        "samples",
    ),
)
def write_yolo(spark, sf):
    lines = FS.numbered_lines(spark, _yolo_root(spark, sf), "*.txt").where("line <> ''")
    return lines.groupBy(file_stem(F.col("path")).alias("stem"), "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "yolo_class_map",
    sql("SELECT class_id, class_name FROM classes", "classes"),
)
def yolo_class_map(spark, sf):
    return yolo.class_map(spark, _yolo_root(spark, sf))


@query(
    "write_detections_yolo",
    sql(
        _SUP + """, firsts AS (SELECT class_name, min((l_suppkey, k)) AS at_ FROM (SELECT l_suppkey,
          l_returnflag || l_linestatus AS class_name, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS k
          FROM lineitem) GROUP BY 1),
        ids AS (SELECT class_name, row_number() OVER (ORDER BY at_, class_name) - 1 AS class_id
          FROM firsts)
        SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') || '_' || stem AS stem, ids.class_id,
        sup.class_name, count(*) AS boxes FROM sup JOIN ids USING (class_name) GROUP BY 1, 2, 3""",
        "samples",
    ),
)
def write_detections_yolo(spark, sf):
    root = scratch_path(spark, "detections")
    S.write_detections_yolo(_corpus(spark, sf), root)
    classes = yolo.class_map(spark, root)
    labels = yolo.parse_lines(FS.numbered_lines(spark, root, "*.txt"), classes)
    return labels.groupBy(file_stem(F.col("path")).alias("stem"), "class_id", "class_name").agg(
        F.count(F.lit(1)).alias("boxes")
    )


@query(
    "read_yolo_scored",
    sql(
        _SUP + """, fit AS (SELECT stem, class_name, greatest(0, x1) AS x, greatest(0, y1) AS y,
          least(w, 1 - greatest(0, x1)) AS width, least(h, 1 - greatest(0, y1)) AS height FROM sup)
        SELECT class_name, count(*) AS boxes, round(avg(x), 4) AS x, round(avg(y), 4) AS y,
        round(avg(width), 4) AS width, round(avg(height), 4) AS height FROM fit
        WHERE width > 0 AND height > 0 GROUP BY 1""",
        "samples",
    ),
)
def read_yolo_scored(spark, sf):
    root = _yolo_root(spark, sf)
    got = yolo.parse_scored(FS.numbered_lines(spark, root, "*.txt"), yolo.class_maps(spark, root), FS.line_files(spark, root, "*.txt"))
    return got.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("boxes"),
        *[F.round(F.avg(c), 4).alias(c) for c in ("x", "y", "width", "height")],
    )


@query(
    "yolo_label_match",
    """SELECT 'img_' || o_orderkey AS stem, CASE o_orderstatus WHEN 'O' THEN '/d/labels/img_' ||
    o_orderkey || '.txt' WHEN 'F' THEN '/d/images/img_' || o_orderkey || '.txt' END AS label_path
    FROM orders""",
)
def yolo_label_match(spark, sf):
    o = X.table(spark, sf, "orders")
    name = F.concat(F.lit("img_"), F.col("o_orderkey"))
    images = o.select(F.concat(F.lit("/d/images/"), name, F.lit(".jpg")).alias("path"))
    folder = F.when(F.col("o_orderstatus") == "O", "/d/labels/").otherwise("/d/images/")
    files = o.where("o_orderstatus <> 'P'").select(F.concat(folder, name, F.lit(".txt")).alias("path"))
    return yolo.match_labels(images, files).select(
        file_stem(F.col("path")).alias("stem"), "label_path"
    )


@query(
    "read_coco",
    sql(
        _SUP + """ SELECT stem, class_name, class_id, round(cx, 6) AS cx, round(cy, 6) AS cy,
        round(w, 6) AS w, round(h, 6) AS h FROM sup""",
        "samples",
    ),
)
def read_coco(spark, sf):
    root = scratch_path(spark, "coco")
    ds = _corpus(spark, sf)
    S.write_coco(ds, root, shards=S.coco_shards(ds))
    ds = R.read_coco(spark, root)  # whole documents, more of them for more boxes; ``convert`` reads the line layout
    return ds.labels.join(ds.samples.select("sample_id", "image_path"), "sample_id").select(
        file_stem(F.col("image_path")).alias("stem"), "class_name", "class_id",
        *[F.round(c, 6).alias(c) for c in BOX],
    )


@query(
    "write_coco",
    sql(
        _SUP + """ SELECT l_suppkey + 1 AS image_id, class_id + 1 AS category_id, count(*) AS boxes,
        round(sum(w * 1280 * (h * 720)), 3) AS area FROM sup GROUP BY 1, 2""",
        "samples",
    ),
)
def write_coco(spark, sf):
    root = scratch_path(spark, "coco")
    S.write_coco(_corpus(spark, sf), root)
    _, anns, _ = R.coco_tables(spark, root, "lines")
    return anns.groupBy("image_id", "category_id").agg(
        F.count(F.lit(1)).alias("boxes"), F.round(F.sum("area"), 3).alias("area")
    )


def _rich(spark, sf) -> Dataset:
    """The corpus with polygons on whole pixels and named values."""
    ds = _corpus(spark, sf)
    x, y = F.floor(F.col("cx") * 1270), F.floor(F.col("cy") * 710)
    triangle = F.array(x / 1280, y / 720, (x + 5) / 1280, y / 720, x / 1280, (y + 7) / 720)
    polygon = F.col("label_index") % 3 == 0
    labels = ds.labels.withColumns({
        "points": F.when(polygon, triangle), "shape_type": F.when(polygon, "polygon").otherwise("box"),
        "segments": F.when(polygon, F.array(triangle)), "area": F.when(polygon, 17.5),
        "rle": F.when(F.col("label_index") % 3 == 1, F.concat(F.lit('{"size":[720,1280],"counts":['), F.col("label_index"), F.lit("]}"))),
        "iscrowd": F.col("label_index") % 3 == 1, "occluded": F.col("label_index") % 2 == 0,
        "attributes": F.create_map(F.lit("kind"), F.concat(F.lit("<"), "class_name", F.lit('> & "more"')), F.lit("z_order"), (F.col("label_index") % 5).cast("string")),
    })
    return Dataset(ds.samples, labels, ds.classes, ds.name)


_RICH = """, own AS (SELECT l_suppkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS k, l_returnflag || l_linestatus AS class_name,
    floor(greatest(0, least(1, l_quantity / 50)) * 1270) AS x, floor(greatest(0, least(1, (l_extendedprice % 1000) / 1000)) * 710) AS y FROM lineitem) """


@query(
    "coco_fields",
    "WITH one AS (SELECT 1)" + _RICH + """SELECT l_suppkey AS sample, class_name, k % 3 = 1 AS iscrowd, CASE WHEN k % 3 = 0 THEN 17.5 END AS area,
    CASE WHEN k % 3 = 1 THEN '{"size":[720,1280],"counts":[' || k || ']}' END AS rle,
    CASE WHEN k % 3 = 0 THEN concat_ws(',', x::BIGINT, y::BIGINT, (x + 5)::BIGINT, y::BIGINT, x::BIGINT, (y + 7)::BIGINT) END AS polygon, count(*) AS boxes
    FROM own GROUP BY ALL""",
)
def coco_fields(spark, sf):
    root = scratch_path(spark, "coco")
    S.write_coco(_rich(spark, sf), root, shards=4)
    ds = R.read_coco(spark, root, layout="lines")
    rows = ds.labels.join(ds.samples.select("sample_id", "image_path"), "sample_id")
    flat = F.transform(F.get("segments", F.lit(0)), lambda v, i: F.round(v * F.when(i % 2 == 0, 1280).otherwise(720)).cast("bigint").cast("string"))
    return rows.select(
        F.regexp_extract("image_path", r"sup_(\d+)", 1).cast("bigint").alias("sample"), "class_name", "iscrowd",
        F.when(F.col("segments").isNotNull(), F.col("area")).alias("area"), "rle", F.array_join(flat, ",").alias("polygon"),
    ).groupBy("sample", "class_name", "iscrowd", "area", "rle", "polygon").agg(F.count(F.lit(1)).alias("boxes"))


@query(
    "cvat_fields",
    "WITH one AS (SELECT 1)" + _RICH + """SELECT l_suppkey AS sample, class_name, CASE WHEN k % 3 = 0 THEN 'polygon' ELSE 'box' END AS shape_type,
    k % 2 = 0 AS occluded, '<' || class_name || '> & "more"' AS kind, (k % 5)::VARCHAR AS z_order,
    CASE WHEN k % 3 = 0 THEN concat_ws(',', x::BIGINT, y::BIGINT, (x + 5)::BIGINT, y::BIGINT, x::BIGINT, (y + 7)::BIGINT) END AS polygon, count(*) AS shapes
    FROM own GROUP BY ALL""",
)
def cvat_fields(spark, sf):
    root = scratch_path(spark, "cvat")
    S.write_cvat(_rich(spark, sf), root)
    ds = R.read_cvat(spark, f"{root}/annotations.xml")
    rows = ds.labels.join(ds.samples.select("sample_id", "ordinal"), "sample_id")
    flat = F.transform("points", lambda v, i: F.round(v * F.when(i % 2 == 0, 1280).otherwise(720)).cast("bigint").cast("string"))
    return rows.select(
        F.col("ordinal").alias("sample"), "class_name", "shape_type", "occluded", F.col("attributes")["kind"].alias("kind"),
        F.col("attributes")["z_order"].alias("z_order"), F.array_join(flat, ",").alias("polygon"),
    ).groupBy("sample", "class_name", "shape_type", "occluded", "kind", "z_order", "polygon").agg(F.count(F.lit(1)).alias("shapes"))


def _kitti_root(spark, sf) -> str:
    ds = _corpus(spark, sf, 1242, 375)
    root = scratch_path(spark, "kitti")
    S.write_kitti(ds, root)
    numbered = ds.samples.withColumn(
        "image_path", F.concat(F.lpad(F.col("ordinal").cast("string"), 6, "0"), F.lit(".png"))
    )
    W.write_lines(_images(Dataset(numbered, ds.labels), F.lit("training/image_2/")), root, ["a"])
    return root


_KITTI = (
    _SUP + """, px AS (SELECT stem, class_name, greatest(0, least(1, cx)) AS cx,
      greatest(0, least(1, cy)) AS cy, w, h FROM sup) """
)


@query("read_kitti", sql(_KITTI + _PER_CLASS + " FROM px GROUP BY 1", "samples"))
def read_kitti(spark, sf):
    ds = R.read_kitti(spark, _kitti_root(spark, sf))
    return _per_class(ds.labels, "sample_id")


@query(
    "write_kitti",
    sql(
        _SUP + """ SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stem, class_name,
        count(*) AS lines FROM sup GROUP BY 1, 2""",
        "samples",
    ),
)
def write_kitti(spark, sf):
    lines = FS.numbered_lines(spark, _kitti_root(spark, sf), "*.txt").where("line <> ''")
    parts = F.split("line", " ")
    return lines.where(F.size(parts) == 15).groupBy(
        file_stem(F.col("path")).alias("stem"), F.get(parts, F.lit(0)).alias("class_name")
    ).agg(F.count(F.lit(1)).alias("lines"))


_VOC = """, vox AS (SELECT stem, class_name,
    greatest(1, least(1280, CAST(round_even(greatest(0, least(1, x1)) * 1280 + 1, 0) AS INT))) AS xmin,
    greatest(1, least(720, CAST(round_even(greatest(0, least(1, y1)) * 720 + 1, 0) AS INT))) AS ymin,
    greatest(1, least(1280, CAST(round_even(greatest(0, least(1, x2)) * 1280, 0) AS INT))) AS xm,
    greatest(1, least(720, CAST(round_even(greatest(0, least(1, y2)) * 720, 0) AS INT))) AS ym
    FROM sup), boxes AS (SELECT stem, class_name, xmin, ymin, greatest(xmin, xm) AS xmax,
    greatest(ymin, ym) AS ymax FROM vox)"""


def _voc(spark, sf):
    root = scratch_path(spark, "voc")
    S.write_voc(_corpus(spark, sf), root)
    return R.read_voc(spark, root, kept=True)


@query(
    "read_voc",
    sql(
        _SUP + _VOC + """ SELECT stem, class_name, xmin, ymin, xmax, ymax, count(*) AS n FROM boxes
        GROUP BY ALL""",
        "samples",
    ),
)
def read_voc(spark, sf):
    labels = with_corners(_voc(spark, sf).labels)
    px = {
        "xmin": F.col("x1") * 1280 + 1, "ymin": F.col("y1") * 720 + 1, "xmax": F.col("x2") * 1280,
        "ymax": F.col("y2") * 720,
    }
    boxes = labels.select(F.col("sample_id").alias("stem"), "class_name", *[F.round(e).cast("int").alias(n) for n, e in px.items()])
    return finely(boxes, *boxes.columns).groupBy(*boxes.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "write_voc",
    sql(
        _SUP + _VOC + """ SELECT CASE WHEN s_acctbal > 0 THEN 'train' ELSE 'val' END AS split, class_name,
        count(*) AS boxes, CAST(sum(xmax - xmin) AS BIGINT) AS width, CAST(sum(ymax - ymin) AS BIGINT) AS height
        FROM boxes JOIN supplier ON stem = 'sup_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') GROUP BY 1, 2""",
        "samples",
    ),
)
def write_voc(spark, sf):
    """The written files and split lists, read back."""
    root = scratch_path(spark, "voc-out")
    S.write_voc(_corpus(spark, sf), root)
    ds = R.read_voc(spark, root, class_names=(), kept=True)
    split = FS.split_lines(spark, f"{root}/ImageSets/Main").select(
        F.trim("line").alias("sample_id"), file_stem(F.col("path")).alias("split")
    )
    labels = ds.labels.join(ds.samples.select("sample_id", "image_width", "image_height"), "sample_id")
    px = labels.join(split, "sample_id").withColumns({
        "bw": F.round(F.col("w") * F.col("image_width")).cast("bigint") - 1,
        "bh": F.round(F.col("h") * F.col("image_height")).cast("bigint") - 1,
    })
    return px.groupBy("split", "class_name").agg(
        F.count(F.lit(1)).alias("boxes"), F.sum("bw").alias("width"), F.sum("bh").alias("height")
    )


@query(
    "voc_split_scan",
    """SELECT 'sup_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS sample_id FROM supplier""",
)
def voc_split_scan(spark, sf):
    """The files of every split list, each list read for itself."""
    root = scratch_path(spark, "voc")
    S.write_voc(_corpus(spark, sf), root)
    lists = [R.read_voc(spark, root, split).samples.select("sample_id") for split in ("train", "val")]
    return lists[0].unionByName(lists[1])


def _cvat(spark, sf) -> Dataset:
    root = scratch_path(spark, "cvat")
    S.write_cvat(_corpus(spark, sf), root)
    return R.read_cvat(spark, f"{root}/annotations.xml")


@query(
    "read_cvat",
    sql(_SUP + ", px AS (SELECT stem, class_name, cx, cy, w, h FROM sup) " + _PER_CLASS
        + " FROM px GROUP BY 1", "samples"),
)
def read_cvat(spark, sf):
    # A label inside a track takes the name of the shape, which the writer states.
    return _per_class(_cvat(spark, sf).labels, "sample_id")


@query(
    "write_cvat",
    """SELECT l_partkey AS track_id, count(*) AS shapes, count(DISTINCT l_suppkey) AS frames,
    min(l_suppkey) AS first_frame FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""",
)
def write_cvat(spark, sf):
    ds = _cvat(spark, sf)
    labels = ds.labels.where("track_id IS NOT NULL").join(ds.samples.select("sample_id", "ordinal"), "sample_id")
    return labels.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("shapes"), F.countDistinct("ordinal").alias("frames"),
        F.min("ordinal").alias("first_frame"),
    )


@query(
    "convert",
    sql(
        _SUP + """ SELECT stem, class_name, count(*) AS boxes FROM sup GROUP BY 1, 2""", "samples"
    ),
)
def convert(spark, sf):
    a, b = scratch_path(spark, "from-cvat"), scratch_path(spark, "to-coco")
    S.write_cvat(_corpus(spark, sf), a)
    registry.convert(spark, "cvat", f"{a}/annotations.xml", "coco", b)
    ds = R.read_coco(spark, b, layout="lines")
    return ds.labels.join(ds.samples.select("sample_id", "image_path"), "sample_id").groupBy(
        file_stem(F.col("image_path")).alias("stem"), "class_name"
    ).agg(F.count(F.lit(1)).alias("boxes"))


@query("format_registry", "SELECT unnest(['coco', 'cvat', 'kitti', 'voc', 'yolo']) AS format, "
       "(SELECT count(*) FROM lineitem) AS convertible_labels")
def format_registry(spark, sf):
    rows = X.table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("convertible_labels"))
    names = F.array(*[F.lit(n) for n in registry.formats() if n in registry.WRITERS])
    return rows.select(F.explode(names).alias("format"), "convertible_labels").where(
        F.col("format").isin("coco", "cvat", "kitti", "voc", "yolo")
    )


# ---- files ----------------------------------------------------------------------------------


def _tree(spark, sf):
    """A file tree named after the parts: kind by type, folder by brand."""
    ext = (
        F.when(F.col("p_type") == "ECONOMY", ".jpg").when(F.col("p_type") == "STANDARD", ".PNG")
        .when(F.col("p_size") > 40, ".json").when(F.col("p_size") > 30, ".pcd")
        .when(F.col("p_size") > 20, ".mp4").otherwise(".dat")
    )
    return X.table(spark, sf, "part").select(
        F.concat(F.lit("/d/"), "p_brand", F.lit("/f"), F.col("p_partkey"), ext).alias("path"),
        F.col("p_size").cast("bigint").alias("size"),
    )


_TREE = """WITH tree AS (SELECT p_partkey, p_size, CASE WHEN p_type = 'ECONOMY' THEN '.jpg' WHEN
    p_type = 'STANDARD' THEN '.png' WHEN p_size > 40 THEN '.json' WHEN p_size > 30 THEN '.pcd'
    WHEN p_size > 20 THEN '.mp4' ELSE '.dat' END AS extension FROM part),
  kinds AS (SELECT *, CASE extension WHEN '.jpg' THEN 'image' WHEN '.png' THEN 'image' WHEN '.json'
    THEN 'annotation' WHEN '.pcd' THEN 'pointcloud' WHEN '.mp4' THEN 'video' ELSE 'other' END
    AS kind FROM tree)"""


@query(
    "file_inventory",
    """SELECT 'sup_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stem, unnest(['.jpg', '.txt'])
    AS extension, unnest(['image', 'annotation']) AS kind FROM supplier
    UNION ALL SELECT 'data', '.yaml', 'annotation'""",
)
def file_inventory(spark, sf):
    return FS.inventory(spark, _yolo_root(spark, sf)).select(
        file_stem(F.col("path")).alias("stem"), "extension", "kind"
    )


@query(
    "scan_summary",
    _TREE + """ SELECT count(*) AS total_files, CAST(sum(p_size) AS BIGINT) AS total_size,
    count(*) FILTER (kind = 'image') AS image_files, count(*) FILTER (kind = 'video') AS video_files,
    count(*) FILTER (kind = 'pointcloud') AS pointcloud_files,
    count(*) FILTER (kind = 'annotation') AS annotation_files,
    count(*) FILTER (kind = 'other') AS other_files, 'mixed' AS primary_type FROM kinds""",
)
def scan_summary(spark, sf):
    return FS.scan_summary(FS.describe(_tree(spark, sf)))


@query(
    "scan_extensions",
    _TREE + """ SELECT extension, count(*) AS files FROM kinds GROUP BY 1 ORDER BY 2 DESC, 1
    LIMIT 10""",
)
def scan_extensions(spark, sf):
    return FS.top_extensions(FS.describe(_tree(spark, sf)))


@query(
    "detect_format",
    """SELECT 'root_' || n_nationkey AS root, ['yolo', 'coco', 'voc', 'kitti', 'nuscenes']
    [n_regionkey + 1] AS format FROM nation JOIN (SELECT DISTINCT s_nationkey FROM supplier)
    ON s_nationkey = n_nationkey""",
)
def detect_format(spark, sf):
    rel = (
        F.when(F.col("n_regionkey") == 0, "data.yaml")
        .when(F.col("n_regionkey") == 1, F.concat(F.lit("annotations/s"), "s_suppkey", F.lit(".json")))
        .when(F.col("n_regionkey") == 2, F.concat(F.lit("Annotations/s"), "s_suppkey", F.lit(".xml")))
        .when(F.col("n_regionkey") == 3, F.concat(F.lit("training/label_2/"), "s_suppkey", F.lit(".txt")))
        .otherwise("v1.0-mini/sample_annotation.json")
    )
    rows = X.table(spark, sf, "supplier").join(
        X.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    files = rows.select(F.concat(F.lit("root_"), "n_nationkey").alias("root"), rel.alias("rel"))
    return FS.detect_formats(files)


def _png(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gray PNG bytes of square images given as level lists."""

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    for b in batches:
        data = []
        for levels, w in zip(b["levels"], b["w"]):
            img = np.asarray(levels, np.uint8).reshape(-1, w)
            raw = b"".join(b"\0" + row.tobytes() for row in img)
            head = struct.pack(">IIBBBBB", w, len(img), 8, 0, 0, 0, 0)
            data.append(
                b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
            )
        yield pd.DataFrame({"rel": b["rel"], "data": data})


@query(
    "image_dimensions",
    """SELECT 'v' || vec_id AS stem, CASE WHEN label < 5 THEN 8 ELSE 16 END AS width,
    CASE WHEN label < 5 THEN 8 ELSE 4 END AS height FROM embeddings""",
)
def image_dimensions(spark, sf):
    root = scratch_path(spark, "png")
    level = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + x * 256))).cast("int"))
    rows = X.table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), "vec_id", F.lit(".png")).alias("rel"), level.alias("levels"),
        F.when(F.col("label") < 5, 8).otherwise(16).alias("w"),
    )
    W.write_blobs(rows.mapInPandas(_png, "rel STRING, data BINARY"), root)
    return FS.image_dimensions(spark, root).select(file_stem(F.col("path")).alias("stem"), "width", "height")


# ---- point files ----------------------------------------------------------------------------

_POINTS = """SELECT cloud_id, count(*) AS points, round(sum(x), 3) AS x, round(sum(y), 3) AS y,
    round(sum(z), 3) AS z FROM points GROUP BY 1"""


def _sums(df, cloud):
    return df.groupBy(cloud.cast("bigint").alias("cloud_id")).agg(
        F.count(F.lit(1)).alias("points"), *[F.round(F.sum(c), 3).alias(c) for c in "xyz"]
    )


def _cloud_of(path):
    return F.regexp_extract(path, r"cloud_(\d+)\.", 1)


@query("read_points_ascii", sql(_POINTS, "points"))
def read_points_ascii(spark, sf):
    root = scratch_path(spark, "pcd")
    S.write_points(X.points(spark, sf), root, "pcd")
    return _sums(P.read_pcd(spark, root), _cloud_of(F.col("path")))


@query(
    "read_points_kitti_bin",
    sql(
        """, narrow AS (SELECT cloud_id, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z,
        intensity::FLOAT::DOUBLE AS i, max(intensity::FLOAT::DOUBLE) OVER (PARTITION BY cloud_id) AS top FROM points)
        SELECT cloud_id, count(*) AS points, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(sum(z), 3) AS z,
        round(sum(CASE WHEN top > 1 THEN i / top ELSE i END), 3) AS intensity FROM narrow GROUP BY 1""",
        "points",
    ),
)
def read_points_kitti_bin(spark, sf):
    root = scratch_path(spark, "kitti-bin")
    S.write_float32(X.points(spark, sf), root)
    got = P.read_float32(spark, root)
    return got.groupBy(_cloud_of(F.col("path")).cast("bigint").alias("cloud_id")).agg(
        F.count(F.lit(1)).alias("points"), *[F.round(F.sum(c), 3).alias(c) for c in ("x", "y", "z", "intensity")]
    )


@query("write_points", sql(_POINTS, "points"))
def write_points(spark, sf):
    root = scratch_path(spark, "ply")
    S.write_points(X.points(spark, sf), root, "ply")
    return _sums(P.read_ply(spark, root), _cloud_of(F.col("path")))


@query(
    "calib_kitti",
    """SELECT s_suppkey AS key, round(700 + s_acctbal / 100, 6) AS fx, round(s_acctbal / 50, 6) AS cx,
    round(s_nationkey / 10, 6) AS t00, round(-0.5 * s_nationkey, 6) AS tx FROM supplier""",
)
def calib_kitti(spark, sf):
    s = X.table(spark, sf, "supplier")
    fx, cx = 700 + F.col("s_acctbal") / 100, F.col("s_acctbal") / 50
    line = F.concat_ws(
        "\n",
        F.concat_ws(" ", F.lit("P2:"), fx, F.lit("0"), cx, F.lit("0 0"), fx, cx, F.lit("0 0 0 1 0")),
        F.lit("R0_rect: 1 0 0 0 1 0 0 0 1"),
        F.concat_ws(
            " ", F.lit("Tr_velo_to_cam:"), F.col("s_nationkey") / 10, F.lit("-1 0"), -0.5 * F.col("s_nationkey"),
            F.lit("0 0 -1 -0.1 1 0 0 -0.3"),
        ),
    )
    lines = s.select(F.col("s_suppkey").alias("path"), F.explode(F.split(line, "\n")).alias("line"))
    return calibration.kitti(lines).select(
        "key", F.round(F.get("k", F.lit(0)), 6).alias("fx"), F.round(F.get("k", F.lit(2)), 6).alias("cx"),
        F.round(F.get("t", F.lit(0)), 6).alias("t00"), F.round(F.get("t", F.lit(3)), 6).alias("tx"),
    )


@query(
    "calib_json",
    """SELECT s_suppkey AS key, round(500 + s_acctbal / 100, 6) AS fx, 16 AS t_cells,
    1280 AS width FROM supplier""",
)
def calib_json(spark, sf):
    fx = (500 + F.col("s_acctbal") / 100).cast("string")
    doc = F.concat(
        F.lit('{"K": [['), fx, F.lit(', 0, 320], [0, '), fx,
        F.lit(', 240], [0, 0, 1]], "width": 1280, "height": 720, "T_cam_lidar": [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]}'),
    )
    docs = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), doc.alias("value"))
    return calibration.from_json(docs).select(
        "key", F.round(F.get("k", F.lit(0)), 6).alias("fx"), F.size("t").alias("t_cells"), "width"
    )


@query(
    "calib_nuscenes",
    """SELECT s_suppkey AS key, round(800 + s_nationkey / 4, 6) AS fx, 1600 AS width,
    900 AS height FROM supplier""",
)
def calib_nuscenes(spark, sf):
    fx = 800 + F.col("s_nationkey") / 4
    k = F.array(
        F.array(fx, F.lit(0.0), F.lit(800.0)), F.array(F.lit(0.0), fx, F.lit(450.0)),
        F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)),
    )
    rows = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("token"), k.alias("camera_intrinsic"))
    return calibration.nuscenes(rows).select(
        "key", F.round(F.get("k", F.lit(0)), 6).alias("fx"), "width", "height"
    )


# ---- corpus checks --------------------------------------------------------------------------


def _image_files(spark, sf):
    return X.on_disk(spark, sf)


def _stem_files(spark, sf, ext):
    """A file for every order that has line items."""
    return X.table(spark, sf, "lineitem").select(
        F.concat(F.lit("/labels/img_"), F.col("l_orderkey"), F.lit(ext)).alias("path")
    ).distinct()


_ORPHANS = """SELECT DISTINCT 'img_' || l_orderkey AS stem FROM lineitem WHERE l_orderkey NOT IN
    (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""
_UNLABELED = """SELECT 'img_' || o_orderkey AS stem FROM orders WHERE o_orderstatus <> 'P'
    AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""
_PAIRING = f"""SELECT stem, 'missing_image' AS finding FROM ({_ORPHANS}) UNION ALL
    SELECT stem, 'missing_label' FROM ({_UNLABELED})"""


@query("yolo_orphan_labels", _ORPHANS)
def yolo_orphan_labels(spark, sf):
    found = V.stem_pairing(_image_files(spark, sf), _stem_files(spark, sf, ".txt"))
    return found.where("finding = 'missing_image'").select("stem")


@query("yolo_missing_labels", _UNLABELED)
def yolo_missing_labels(spark, sf):
    found = V.stem_pairing(_image_files(spark, sf), _stem_files(spark, sf, ".txt"))
    return found.where("finding = 'missing_label'").select("stem")


@query(
    "yolo_bad_lines",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'bad_number' WHEN l_discount = 0 THEN
    'too_few_fields' WHEN l_quantity / 45 > 1 THEN 'out_of_range' END AS finding, count(*) AS n
    FROM lineitem WHERE l_tax = 0 OR l_discount = 0 OR l_quantity / 45 > 1 GROUP BY ALL""",
)
def yolo_bad_lines(spark, sf):
    q = F.col("l_quantity") / 45
    line = F.when(F.col("l_tax") == 0, F.lit("0 0.5 x 0.1 0.1")).when(
        F.col("l_discount") == 0, F.lit("0 0.5 0.5")
    ).otherwise(F.concat_ws(" ", F.lit("1"), q.cast("string"), F.lit("0.5 0.1 0.1")))
    lines = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    return V.yolo_lines(lines).groupBy("l_orderkey", "l_linenumber", "finding").agg(
        F.count(F.lit(1)).alias("n")
    )


def _coco_tables(spark, sf):
    """Filled orders as images; line items as annotations, some with a short box."""
    images = X.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    four = F.array("l_quantity", "l_quantity", "l_tax", "l_discount")
    bbox = F.when(F.col("l_discount") == 0, F.array("l_quantity")).otherwise(four)
    anns = X.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("image_id"), X.class_id().cast("bigint").alias("category_id"),
        bbox.alias("bbox"),
    )
    cats = X.table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("id"))
    return images, anns, cats


@query(
    "coco_orphan_annotations",
    """SELECT l_orderkey AS image_id, count(*) AS annotations FROM lineitem WHERE l_orderkey NOT IN
    (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""",
)
def coco_orphan_annotations(spark, sf):
    images, anns, _ = _coco_tables(spark, sf)
    return V.orphans(anns, "image_id", images, "id").groupBy("image_id").agg(
        F.count(F.lit(1)).alias("annotations")
    )


@query(
    "coco_integrity",
    """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id,
      CAST((CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END) +
      (CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) AS BIGINT) AS category_id, l_discount FROM lineitem)
    SELECT 'duplicate_annotation' AS finding, id, count(*) AS n FROM a GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'unknown_image', image_id, count(*) FROM a WHERE image_id NOT IN
      (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 2
    UNION ALL SELECT 'unknown_category', category_id, count(*) FROM a WHERE category_id NOT IN
      (SELECT r_regionkey FROM region) GROUP BY 2
    UNION ALL SELECT 'bbox_arity', id, count(*) FROM a WHERE l_discount = 0 GROUP BY 2""",
)
def coco_integrity(spark, sf):
    return V.coco_integrity(*_coco_tables(spark, sf))


@query("kitti_pairing", _PAIRING)
def kitti_pairing(spark, sf):
    return V.stem_pairing(_image_files(spark, sf), _stem_files(spark, sf, ".txt"))


@query("voc_pairing", _PAIRING)
def voc_pairing(spark, sf):
    return V.stem_pairing(_image_files(spark, sf), _stem_files(spark, sf, ".xml"))


@query("cvat_missing_images", _ORPHANS)
def cvat_missing_images(spark, sf):
    named = _stem_files(spark, sf, ".jpg").select(file_stem(F.col("path")).alias("stem"))
    disk = _image_files(spark, sf).select(file_stem(F.col("path")).alias("stem"))
    return V.orphans(named, "stem", disk, "stem")
