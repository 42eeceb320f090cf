"""Writers of label formats. Every format becomes a table of file, order and line; files are then
written in parallel. Nothing is assembled on the driver or in one row.

All take samples with ``sample_id, ordinal, image_path, image_width, image_height`` and labels as in
``framewright.model``; ``ordinal`` is the 0-based position of a sample.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.boxes import center_to_corners
from framewright.model import Dataset, unit
from framewright.operators.dataset import infer_classes
from framewright.operators.ranking import dense_ids
from framewright.operators.review import file_name, file_stem
from framewright.session import passing, stored
from framewright.sinks.files import ensure_output, write_lines, write_records

_ORDER = ["part", "a", "b", "c"]
#: Attributes of a CVAT shape that are attributes of its element.
CVAT_OWN = ("source", "z_order", "group_id", "rotation", "keyframe")


def _classes(ds: Dataset) -> DataFrame:
    return ds.classes if ds.classes is not None else infer_classes(ds)


def _rows(df: DataFrame, rel: Column, part: int, line: Column, a=None, b=None, c=0, section=None):
    zero = F.lit(0).cast("bigint")
    return df.select(
        rel.alias("rel"), F.lit(part).alias("part"),
        (zero if a is None else a).cast("bigint").alias("a"),
        (zero if b is None else b).cast("bigint").alias("b"), F.lit(c).alias("c"),
        F.lit(section).cast("string").alias("section"), line.alias("line"),
    )


def _write(parts: list[DataFrame], root: str, overwrite: bool) -> None:
    ensure_output(root, overwrite)
    write_lines(reduce(DataFrame.unionByName, parts), root, _ORDER)


def _joined(ds: Dataset, *cols: str) -> DataFrame:
    return ds.labels.join(ds.samples.select("sample_id", *cols), "sample_id")


def _distinct_stems(samples: DataFrame) -> DataFrame:
    """Add ``stem``: the image's, with the ordinal behind it when an earlier image has the same."""
    first = samples.groupBy(file_stem(F.col("image_path")).alias("stem")).agg(
        F.min("ordinal").alias("_first")
    )
    named = samples.withColumn("stem", file_stem(F.col("image_path"))).join(first, "stem")
    return named.withColumn(
        "stem",
        F.when(F.col("ordinal") == F.col("_first"), F.col("stem")).otherwise(
            F.concat_ws("_", "stem", F.col("ordinal").cast("string"))
        ),
    ).drop("_first")


def yolo_line(labels: DataFrame) -> Column:
    box = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h")
    if "polygon" not in labels.columns:
        return box
    flat = F.array_join(F.transform("polygon", lambda v: F.format_string("%.6f", v)), " ")
    usable = (F.size("polygon") >= 6) & (F.size("polygon") % 2 == 0)
    return F.when(usable, F.concat_ws(" ", F.col("class_id").cast("string"), flat)).otherwise(box)


def write_yolo(ds: Dataset, root: str, overwrite: bool = False) -> None:
    """``<split>/labels/<stem>.txt`` per image (empty without labels) and data.yaml."""
    samples = _distinct_stems(ds.samples)
    split = F.coalesce(F.col("split"), F.lit("train")) if "split" in samples.columns else F.lit("train")
    samples = samples.withColumn("_rel", F.concat_ws("/", split, F.lit("labels"), F.concat("stem", F.lit(".txt"))))
    labels = ds.labels.join(samples.select("sample_id", "_rel"), "sample_id")
    head = _rows(samples, F.col("_rel"), 0, F.lit(None).cast("string"))
    body = _rows(labels, F.col("_rel"), 1, yolo_line(labels), F.col("label_index"))
    yaml = F.lit("data.yaml")
    names = _classes(ds)
    quoted = F.concat(F.lit("  "), F.col("class_id").cast("string"), F.lit(": '"), "class_name", F.lit("'"))
    conf = _rows(names, yaml, 1, quoted, F.col("class_id"))
    one = names.limit(1)
    top = _rows(one, yaml, 0, F.lit("train: train/images\nval: val/images\nnames:"))
    _write([head, body, conf, top], root, overwrite)


def detections_yolo_rows(ds: Dataset) -> tuple[DataFrame, DataFrame]:
    """Labels with ids by first appearance in image order, and the class list that gives them.

    Names are trimmed, blank ones become ``object``, boxes are clamped.
    """
    name = F.trim("class_name")
    labels = _joined(ds, "ordinal", "image_path").withColumn(
        "class_name", F.when(name == "", "object").otherwise(name)
    )
    first = labels.groupBy("class_name").agg(F.min(F.struct("ordinal", "label_index")).alias("_at"))
    classes = dense_ids(first, [F.col("_at")], "class_id").select(
        F.col("class_id").cast("int").alias("class_id"), "class_name"
    )
    boxes = {c: unit(F.col(c)) for c in ("cx", "cy", "w", "h")}
    return labels.drop("class_id").join(classes, "class_name").withColumns(boxes), classes


def write_detections_yolo(ds: Dataset, root: str, overwrite: bool = False) -> None:
    """Detections as ``train/labels/<5-digit ordinal>_<stem>.txt``."""
    labels, classes = detections_yolo_rows(ds)
    stem = F.concat_ws("_", F.lpad(F.col("ordinal").cast("string"), 5, "0"), file_stem(F.col("image_path")))
    rel = F.concat(F.lit("train/labels/"), stem, F.lit(".txt"))
    head = _rows(ds.samples, rel, 0, F.lit(None).cast("string"))
    body = _rows(labels, rel, 1, yolo_line(labels), F.col("label_index"))
    item = F.concat(F.lit("- "), "class_name")
    conf = _rows(classes, F.lit("data.yaml"), 1, item, F.col("class_id"))
    top = _rows(classes.limit(1), F.lit("data.yaml"), 0, F.lit("train: train/images\nval: train/images\nnames:"))
    _write([head, body, conf, top], root, overwrite)


def _shard(key: Column, shards: int, template: str) -> Column:
    number = F.pmod(F.xxhash64(key), F.lit(shards))
    return F.format_string(template, number)


def coco_segmentation(labels: DataFrame, width: Column, height: Column) -> Column:
    """JSON of a label's mask: ``rle`` as it is, else the ``segments``, else the one ``polygon``, else an empty list.

    Polygons of three points or more count; one whose values all lie between 0 and 1 is in shares of the image.
    """
    out = F.lit("[]")

    def pixels(polygon: Column) -> Column:
        shares = F.forall(polygon, lambda v: v.between(0, 1))
        return F.transform(polygon, lambda v, i: F.when(shares, v * F.when(i % 2 == 0, width).otherwise(height)).otherwise(v))

    def listed(polygons: Column) -> Column:
        whole = F.filter(polygons, lambda p: (F.size(p) >= 6) & (F.size(p) % 2 == 0))
        return F.when(F.size(whole) > 0, F.to_json(F.transform(whole, pixels)))

    if "polygon" in labels.columns:
        out = F.coalesce(listed(F.array(F.col("polygon").cast("array<double>"))), out)
    if "segments" in labels.columns:
        out = F.coalesce(listed(F.col("segments")), out)
    return F.coalesce(F.col("rle"), out) if "rle" in labels.columns else out


def coco_shards(ds: Dataset, least: int = 4, boxes: int = 100_000) -> int:
    """Number of whole documents that hold some ``boxes`` labels each, as one task parses a document."""
    return max(least, -(-ds.labels.count() // boxes))


def write_coco(ds: Dataset, root: str, split: str = "train", shards: int = 1, overwrite: bool = False) -> None:
    """``annotations/instances_<split>[_NNNNN].json``: dense 1-based ids over all shards, one
    object per line. More shards write in parallel; each is a complete document."""
    with passing(ds.labels.sparkSession):
        _coco(ds, root, split, shards, overwrite)


def _coco(ds: Dataset, root: str, split: str, shards: int, overwrite: bool) -> None:
    name = f"annotations/instances_{split}" + ("_%05d.json" if shards > 1 else ".json")

    def rel(col: str) -> Column:
        return _shard(F.col(col), shards, name) if shards > 1 else F.lit(name)

    classes = _classes(ds)
    images = dense_ids(ds.samples, [F.col("ordinal"), F.col("sample_id")], "image_id", start=1)
    W, H = F.col("image_width"), F.col("image_height")
    labels = ds.labels.where("class_id >= 0").join(
        images.select("sample_id", "image_id", "image_width", "image_height"), "sample_id"
    ).join(classes.select("class_id"), "class_id", "left_semi")
    anns = dense_ids(labels, [F.col("image_id"), F.col("label_index")], "id", start=1)
    w, h = F.col("w") * W, F.col("h") * H
    bbox = F.array((F.col("cx") - F.col("w") / 2) * W, (F.col("cy") - F.col("h") / 2) * H, w, h)
    crowd = F.col("iscrowd").cast("int") if "iscrowd" in ds.labels.columns else F.lit(0)
    area = F.coalesce(F.col("area"), w * h) if "area" in ds.labels.columns else w * h
    ann = F.to_json(
        F.struct(
            "id", "image_id", (F.col("class_id") + 1).alias("category_id"), bbox.alias("bbox"),
            area.alias("area"), F.coalesce(crowd, F.lit(0)).alias("iscrowd"),
        )
    )
    ann = F.concat(F.substring(ann, 1, F.length(ann) - 1), F.lit(',"segmentation":'), coco_segmentation(labels, W, H), F.lit("}"))
    img = F.to_json(
        F.struct(
            F.col("image_id").alias("id"), file_name(F.col("image_path")).alias("file_name"),
            W.alias("width"), H.alias("height"),
        )
    )
    used = images.select(rel("image_id").alias("rel")).distinct()
    files = used.withColumn("_one", F.lit(1))
    cats = classes.withColumn("_one", F.lit(1)).join(files, "_one")
    cat = F.to_json(
        F.struct(
            (F.col("class_id") + 1).alias("id"), F.col("class_name").alias("name"),
            F.lit("object").alias("supercategory"),
        )
    )
    info = f'{{"info": {{"description": "Exported from {ds.name}", "version": "1.0"}}, "licenses": [],'
    r = F.col("rel")
    parts = [
        _rows(files, r, 0, F.lit(info + '\n"categories": [')),
        _rows(cats, r, 1, cat, F.col("class_id"), section="categories"),
        _rows(files, r, 2, F.lit('],\n"images": [')),
        _rows(images, rel("image_id"), 3, img, F.col("image_id"), section="images"),
        _rows(files, r, 4, F.lit('],\n"annotations": [')),
        _rows(anns, rel("image_id"), 5, ann, F.col("id"), section="annotations"),
        _rows(files, r, 6, F.lit("]}")),
    ]
    _write(parts, root, overwrite)


def kitti_line(labels: DataFrame) -> Column:
    """Fifteen fields; 3D values come from columns of the same name, else the format's defaults."""

    def value(name: str, default: float) -> Column:
        has = name in labels.columns
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if has else F.lit(default)

    W, H = F.col("image_width"), F.col("image_height")
    x1, y1, x2, y2 = center_to_corners(*(F.col(c) for c in ("cx", "cy", "w", "h")))
    occluded = F.least(F.lit(3), F.greatest(F.lit(0), value("occluded", 0.0).cast("int")))
    name = F.when(F.col("class_name") != "", F.col("class_name")).otherwise(
        F.concat(F.lit("class_"), F.col("class_id"))
    )
    return F.format_string(
        "%s %.2f %d %.2f %.2f %.2f %.2f %.2f %.2f %.2f %.2f %.2f %.2f %.2f %.2f",
        name, value("truncated", 0.0), occluded, value("alpha", -10.0), x1 * W, y1 * H, x2 * W, y2 * H,
        value("height_3d", -1.0), value("width_3d", -1.0), value("length_3d", -1.0),
        value("loc_x", -1000.0), value("loc_y", -1000.0), value("loc_z", -1000.0),
        value("rotation_y", -10.0),
    )


def write_kitti(ds: Dataset, root: str, split: str = "training", overwrite: bool = False) -> None:
    """``<split>/label_2/<6-digit ordinal>.txt`` per image."""
    rel = F.concat(F.lit(f"{split}/label_2/"), F.lpad(F.col("ordinal").cast("string"), 6, "0"), F.lit(".txt"))
    labels = _joined(ds, "ordinal", "image_width", "image_height")
    parts = [
        _rows(ds.samples, rel, 0, F.lit(None).cast("string")),
        _rows(labels, rel, 1, kitti_line(labels), F.col("label_index")),
    ]
    _write(parts, root, overwrite)


def _xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def voc_pixels(labels: DataFrame) -> dict[str, Column]:
    """1-based inclusive pixel corners inside the image, maximum not below minimum."""
    W, H = F.col("image_width"), F.col("image_height")
    x1, y1, x2, y2 = (unit(c) for c in center_to_corners(*(F.col(c) for c in ("cx", "cy", "w", "h"))))

    def hold(v: Column, size: Column) -> Column:
        return F.least(size, F.greatest(F.lit(1), F.bround(v, 0).cast("int")))

    low = {"xmin": hold(x1 * W + 1, W), "ymin": hold(y1 * H + 1, H)}
    return {
        **low,
        "xmax": F.greatest(hold(x2 * W, W), low["xmin"]),
        "ymax": F.greatest(hold(y2 * H, H), low["ymin"]),
    }


def write_voc(ds: Dataset, root: str, split: str = "train", overwrite: bool = False) -> None:
    """``Annotations/<stem>.xml`` per image and ``ImageSets/Main/<split>.txt`` for the split of each sample;
    ``split`` is that of samples without one."""
    samples = _distinct_stems(ds.samples)
    own = F.coalesce(F.nullif(F.col("split"), F.lit("")), F.lit(split)) if "split" in samples.columns else F.lit(split)
    listed = F.concat(F.lit("ImageSets/Main/"), own, F.lit(".txt"))
    rel = F.concat(F.lit("Annotations/"), F.col("stem"), F.lit(".xml"))
    labels = ds.labels.join(
        samples.select("sample_id", "stem", "image_width", "image_height"), "sample_id"
    )

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name).cast("int"), F.lit(0)) if name in labels.columns else F.lit(0)

    labels = labels.withColumns(voc_pixels(labels))
    obj = F.format_string(
        "  <object><name>%s</name><pose>Unspecified</pose><truncated>%d</truncated>"
        "<difficult>%d</difficult><occluded>%d</occluded><bndbox><xmin>%d</xmin><ymin>%d</ymin>"
        "<xmax>%d</xmax><ymax>%d</ymax></bndbox></object>",
        _xml(F.col("class_name")), flag("truncated"), flag("difficult"), flag("occluded"),
        "xmin", "ymin", "xmax", "ymax",
    )
    head = F.format_string(
        "<annotation>\n  <folder>images</folder><filename>%s</filename>\n  <size><width>%d</width>"
        "<height>%d</height><depth>3</depth></size>",
        _xml(file_name(F.col("image_path"))), "image_width", "image_height",
    )
    parts = [
        _rows(samples, rel, 0, head),
        _rows(labels, rel, 1, obj, F.col("label_index")),
        _rows(samples, rel, 2, F.lit("</annotation>")),
        _rows(samples, listed, 0, F.col("stem"), F.col("ordinal")),
    ]
    _write(parts, root, overwrite)


def _cvat_shape(labels: DataFrame, extra: Column | None = None) -> Column:
    """Element of a label: a box, or the ``shape_type`` of labels with ``points``, with its ``attributes`` inside."""
    W, H = F.col("image_width"), F.col("image_height")
    x1, y1, x2, y2 = center_to_corners(*(F.col(c) for c in ("cx", "cy", "w", "h")))
    corners = F.format_string('xtl="%.4f" ytl="%.4f" xbr="%.4f" ybr="%.4f"', x1 * W, y1 * H, x2 * W, y2 * H)
    tag, place = F.lit("box"), corners
    if {"points", "shape_type"} <= set(labels.columns):
        shares = F.forall("points", lambda v: v.between(0, 1))
        flat = F.transform("points", lambda v, i: F.format_string(
            "%.2f", F.when(shares, v * F.when(i % 2 == 0, W).otherwise(H)).otherwise(v)))
        x, y = F.filter(flat, lambda v, i: i % 2 == 0), F.filter(flat, lambda v, i: i % 2 == 1)
        points = F.array_join(F.zip_with(x, y, lambda a, b: F.concat_ws(",", a, b)), ";")
        usable = (F.size("points") >= 2) & F.col("shape_type").isin("polygon", "polyline", "points", "cuboid")
        tag = F.when(usable, F.col("shape_type")).otherwise(tag)
        place = F.when(usable, F.concat(F.lit('points="'), points, F.lit('"'))).otherwise(place)
    inside = F.lit("")
    if "attributes" in labels.columns:
        own = F.array(*[F.lit(k) for k in CVAT_OWN])
        entries = F.map_entries("attributes")
        set_ = F.filter(entries, lambda e: F.array_contains(own, e["key"]) & e["value"].isNotNull())
        place = F.concat(place, F.coalesce(F.array_join(F.transform(
            set_, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _xml(e["value"]), F.lit('"'))), ""), F.lit("")))
        free = F.filter(entries, lambda e: ~F.array_contains(own, e["key"]) & e["value"].isNotNull())
        inside = F.coalesce(F.array_join(F.transform(F.array_sort(free), lambda e: F.concat(
            F.lit('<attribute name="'), _xml(e["key"]), F.lit('">'), _xml(e["value"]), F.lit("</attribute>"))), ""), inside)
    hidden = F.coalesce(F.col("occluded").cast("int"), F.lit(0)) if "occluded" in labels.columns else F.lit(0)
    start = F.concat(F.lit("    <"), tag, F.lit("") if extra is None else extra, F.lit(' label="'), _xml(F.col("class_name")))
    return F.concat(start, F.lit('" occluded="'), F.when(hidden > 0, "1").otherwise("0"), F.lit('" '), place, F.lit(">"), inside, F.lit("</"), tag, F.lit(">"))


def track_table(labels: DataFrame) -> DataFrame:
    """``track_id, out_id, track_class``: negative ids become small numbers by first appearance,
    and the first label names the track."""
    per = labels.where("track_id IS NOT NULL").groupBy("track_id").agg(
        F.min(F.struct("ordinal", "label_index")).alias("_at")
    )
    negative = dense_ids(per.where("track_id < 0"), [F.col("_at")], "out_id").select("track_id", "out_id")
    ids = per.select("track_id").join(negative, "track_id", "left").select(
        "track_id", F.coalesce("out_id", "track_id").alias("out_id")
    )
    first = labels.join(ids, "track_id").groupBy("out_id").agg(
        F.min_by("class_name", F.struct("ordinal", "label_index")).alias("track_class")
    )
    return ids.join(first, "out_id")


def write_cvat(ds: Dataset, root: str, overwrite: bool = False) -> None:
    """``annotations.xml``: shapes by image, and labels with a track id by track and frame."""
    with passing(ds.labels.sparkSession):
        _cvat(ds, root, overwrite)


def _cvat(ds: Dataset, root: str, overwrite: bool) -> None:
    rel = F.lit("annotations.xml")
    labels = _joined(ds, "ordinal", "image_width", "image_height")
    tracked = "track_id" in labels.columns
    plain = labels.where("track_id IS NULL") if tracked else labels
    img = F.format_string(
        '  <image id="%d" name="%s" width="%d" height="%d">', "ordinal",
        _xml(file_name(F.col("image_path"))), "image_width", "image_height",
    )
    classes = _classes(ds)
    label = F.concat(F.lit("    <label><name>"), _xml(F.col("class_name")), F.lit("</name></label>"))
    one = classes.limit(1)
    parts = [
        _rows(one, rel, 0, F.lit('<?xml version="1.0" encoding="utf-8"?>\n<annotations>\n  <version>1.1</version>\n  <meta><task><labels>')),
        _rows(classes, rel, 1, label, F.col("class_id")),
        _rows(one, rel, 2, F.lit("  </labels></task></meta>")),
        _rows(ds.samples, rel, 3, img, F.col("ordinal"), c=0),
        _rows(plain, rel, 3, _cvat_shape(plain), F.col("ordinal"), F.col("label_index"), c=1),
        _rows(ds.samples, rel, 3, F.lit("  </image>"), F.col("ordinal"), F.lit((1 << 63) - 1), c=2),
        _rows(one, rel, 5, F.lit("</annotations>")),
    ]
    # Opening and closing lines sort around the shapes by their second key.
    parts[3] = parts[3].withColumn("b", F.lit(-1).cast("bigint"))
    if tracked:
        tracks = track_table(labels)
        heads = tracks.groupBy("out_id").agg(F.first("track_class").alias("track_class"))
        shapes = labels.join(tracks, "track_id")
        box = _cvat_shape(shapes, F.format_string(' frame="%d" outside="0"', "ordinal"))
        open_ = F.format_string('  <track id="%d" label="%s">', "out_id", _xml(F.col("track_class")))
        parts += [
            _rows(heads, rel, 4, open_, F.col("out_id"), F.lit(-1)),
            _rows(shapes, rel, 4, box, F.col("out_id"), F.col("ordinal"), c=1),
            _rows(heads, rel, 4, F.lit("  </track>"), F.col("out_id"), F.lit((1 << 63) - 1), c=2),
        ]
    _write(parts, root, overwrite)


def write_points(points: DataFrame, root: str, layout: str = "ply", overwrite: bool = False) -> None:
    """One ASCII file per cloud in point order, PLY or PCD, with intensity and rgb when present."""
    extra = [c for c in ("intensity", "rgb") if c in points.columns]
    rel = F.concat(F.lit("cloud_"), F.col("cloud_id"), F.lit(f".{layout}"))
    counts = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("string")
    xyz = [F.format_string("%.6f", c) for c in ("x", "y", "z")]
    if layout == "ply":
        props = "".join(f"property float {c}\n" for c in ("x", "y", "z"))
        cols = list(xyz)
        if "rgb" in extra:
            props += "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
            rgb = F.col("rgb")
            cols += [F.shiftright(rgb, s).bitwiseAND(255).cast("string") for s in (16, 8)]
            cols.append(rgb.bitwiseAND(255).cast("string"))
        if "intensity" in extra:
            props += "property float intensity\n"
            cols.append(F.format_string("%.6f", "intensity"))
        head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), n, F.lit(f"\n{props}end_header"))
    elif layout == "pcd":
        names = ["x", "y", "z", *extra]
        k = len(names)
        kinds = " ".join("U" if c == "rgb" else "F" for c in names)
        head = F.concat(
            F.lit(
                f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(names)}\nSIZE {' '.join(['4'] * k)}\n"
                f"TYPE {kinds}\nCOUNT {' '.join(['1'] * k)}\nWIDTH "
            ),
            n, F.lit("\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS "), n, F.lit("\nDATA ascii"),
        )
        cols = [*xyz, *[F.col(c).cast("string") if c == "rgb" else F.format_string("%.6f", c) for c in extra]]
    else:
        raise ValueError(f"unknown layout: {layout}")
    parts = [
        _rows(counts, rel, 0, head),
        _rows(points, rel, 1, F.concat_ws(" ", *cols), F.col("point_idx")),
    ]
    _write(parts, root, overwrite)


def write_float32(points: DataFrame, root: str, overwrite: bool = False) -> None:
    """One file of float32 records ``x, y, z, intensity`` per cloud, in point order; no intensity is 0."""
    ensure_output(root, overwrite)
    intensity = F.col("intensity") if "intensity" in points.columns else F.lit(0.0)
    rel = F.concat(F.lit("cloud_"), F.col("cloud_id"), F.lit(".bin"))
    write_records(points.select(rel.alias("rel"), "point_idx", "x", "y", "z", intensity.alias("intensity")), root, ["point_idx"])
