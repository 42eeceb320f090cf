"""Queries over samples, labels and classes: filters, statistics, checks, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import boxes as B
from framewright.model import Dataset
from framewright.operators import dataset as D
from framewright.operators import qa, report, split
from framewright.plans import fixtures as X
from framewright.plans.fixtures import sql
from framewright.plans.registry import query
from framewright.session import materialize, scratch_path
from framewright.sinks.report import write_report_tables as write_tables

BOX = ("cx", "cy", "w", "h")
_IOU = (
    "CASE WHEN least(a.x2,b.x2) > greatest(a.x1,b.x1) AND least(a.y2,b.y2) > greatest(a.y1,b.y1) "
    "THEN (least(a.x2,b.x2) - greatest(a.x1,b.x1)) * (least(a.y2,b.y2) - greatest(a.y1,b.y1)) / "
    "((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - (least(a.x2,b.x2) - "
    "greatest(a.x1,b.x1)) * (least(a.y2,b.y2) - greatest(a.y1,b.y1))) ELSE 0 END"
)
_PAIRS = f""", pairs AS (SELECT a.sample_id, a.label_index AS i, b.label_index AS j,
  a.class_name AS class_i, a.class_id AS id_i, b.class_id AS id_j, {_IOU} AS iou
  FROM corners a JOIN corners b ON a.sample_id = b.sample_id AND a.label_index < b.label_index)"""


def _r(col, digits: int = 9):
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits)


# ---- geometry -------------------------------------------------------------------------------


@query(
    "bbox_convert",
    sql(
        """SELECT a.sample_id, label_index, round(x1, 9) AS x1, round(y1, 9) AS y1,
        round(x2, 9) AS x2, round(y2, 9) AS y2,
        round(x1 * image_width, 6) AS px1, round(y1 * image_height, 6) AS py1,
        round(a.w * image_width, 6) AS pw, round(a.h * image_height, 6) AS ph,
        round(cx * image_width, 6) AS pcx, round(cy * image_height, 6) AS pcy
        FROM corners a JOIN samples s ON a.sample_id = s.sample_id""",
        "samples",
        "corners",
    ),
)
def bbox_convert(spark, sf):
    df = X.annotations(spark, sf).join(
        X.samples(spark, sf).select("sample_id", "image_width", "image_height"), "sample_id"
    )
    box = tuple(F.col(c) for c in BOX)
    W, H = F.col("image_width"), F.col("image_height")
    x1, y1, x2, y2 = B.to_layout(box, "xyxy")
    px1, py1, pw, ph = B.scale(B.to_layout(box, "xywh"), W, H)
    pcx, pcy, _, _ = B.scale(box, W, H)
    out = dict(x1=x1, y1=y1, x2=x2, y2=y2)
    px = dict(px1=px1, py1=py1, pw=pw, ph=ph, pcx=pcx, pcy=pcy)
    return df.select(
        "sample_id", "label_index",
        *[_r(e).alias(n) for n, e in out.items()], *[_r(e, 6).alias(n) for n, e in px.items()],
    )


@query(
    "bbox_clamp",
    """SELECT l_orderkey AS sample_id, count(*) AS boxes,
    round(sum(least(1, greatest(0, l_quantity / 40))), 6) AS sum_x,
    round(sum(least(1, greatest(0, (l_extendedprice - 20000) / 50000))), 6) AS sum_y
    FROM lineitem GROUP BY 1""",
)
def bbox_clamp(spark, sf):
    x1 = (F.col("l_extendedprice") - 20000) / 50000
    box = B.from_layout((F.col("l_quantity") / 40, x1, F.lit(0.1), F.lit(0.1)), "cxcywh")
    return X.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.count(F.lit(1)).alias("boxes"),
        _r(F.sum(box[0]), 6).alias("sum_x"),
        _r(F.sum(box[1]), 6).alias("sum_y"),
    )


@query(
    "bbox_area",
    sql("SELECT sample_id, label_index, round(w * h, 9) AS area FROM annotations", "annotations"),
)
def bbox_area(spark, sf):
    return X.annotations(spark, sf).select(
        "sample_id", "label_index", _r(F.col("w") * F.col("h")).alias("area")
    )


@query(
    "bbox_to_pixels_int",
    sql(
        """SELECT a.sample_id, label_index,
        greatest(0, least(CAST(trunc(x1 * image_width) AS INTEGER), image_width - 1)) AS x1,
        greatest(0, least(CAST(trunc(y1 * image_height) AS INTEGER), image_height - 1)) AS y1,
        greatest(0, least(CAST(trunc(x2 * image_width) AS INTEGER), image_width - 1)) AS x2,
        greatest(0, least(CAST(trunc(y2 * image_height) AS INTEGER), image_height - 1)) AS y2
        FROM corners a JOIN samples s ON a.sample_id = s.sample_id""",
        "samples",
        "corners",
    ),
)
def bbox_to_pixels_int(spark, sf):
    df = X.annotations(spark, sf).join(
        X.samples(spark, sf).select("sample_id", "image_width", "image_height"), "sample_id"
    )
    out = B.pixel_corners(*(F.col(c) for c in BOX), F.col("image_width"), F.col("image_height"))
    return df.select(
        "sample_id", "label_index", *[e.alias(n) for n, e in zip(("x1", "y1", "x2", "y2"), out)]
    )


@query(
    "bbox_expand",
    sql(
        """SELECT sample_id, label_index,
        round(greatest(0, (x1 + x2) / 2 * 640 - (x2 - x1) / 2 * 640 * 1.2), 6) AS x1,
        round(greatest(0, (y1 + y2) / 2 * 480 - (y2 - y1) / 2 * 480 * 1.2), 6) AS y1,
        round(least(640, (x1 + x2) / 2 * 640 + (x2 - x1) / 2 * 640 * 1.2), 6) AS x2,
        round(least(480, (y1 + y2) / 2 * 480 + (y2 - y1) / 2 * 480 * 1.2), 6) AS y2
        FROM corners""",
        "corners",
    ),
)
def bbox_expand(spark, sf):
    box = B.scale(
        B.center_to_corners(*(F.col(c) for c in BOX)), F.lit(640), F.lit(480)
    )
    out = B.expand(box, F.lit(1.2), F.lit(640), F.lit(480))
    return X.annotations(spark, sf).select(
        "sample_id", "label_index",
        *[_r(e, 6).alias(n) for n, e in zip(("x1", "y1", "x2", "y2"), out)],
    )


@query(
    "polygon_bbox",
    sql(
        """SELECT sample_id, label_index, round(x1, 9) AS min_x, round(y1, 9) AS min_y,
        round(x2, 9) AS max_x, round(y2, 9) AS max_y FROM corners""",
        "corners",
    ),
)
def polygon_bbox(spark, sf):
    df = qa.with_corners(X.annotations(spark, sf))
    flat = F.array("x1", "cy", "cx", "y1", "x2", "cy", "cx", "y2")  # a diamond
    out = B.polygon_box(flat)
    names = ("min_x", "min_y", "max_x", "max_y")
    return df.select("sample_id", "label_index", *[_r(e).alias(n) for n, e in zip(names, out)])


@query(
    "polygon_scale",
    sql(
        """SELECT sample_id, label_index,
        round(CASE WHEN x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1 THEN x1 * 640 ELSE x1 END, 6)
          AS px,
        round(CASE WHEN x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1 THEN y2 * 480 ELSE y2 END, 6)
          AS py FROM corners""",
        "corners",
    ),
)
def polygon_scale(spark, sf):
    df = qa.with_corners(X.annotations(spark, sf))
    flat = B.polygon_to_pixels(F.array("x1", "y1", "x2", "y2"), F.lit(640), F.lit(480))
    return df.select(
        "sample_id", "label_index", _r(F.get(flat, F.lit(0)), 6).alias("px"),
        _r(F.get(flat, F.lit(3)), 6).alias("py"),
    )


@query(
    "plate_aspect_filter",
    sql(
        """SELECT sample_id, label_index, w / h BETWEEN 3.0 AND 5.5 AS eu,
        w / h BETWEEN 1.8 AND 2.5 AS us, w / h BETWEEN 2.5 AND 4.0 AS china
        FROM annotations WHERE h > 0 AND w / h BETWEEN 1.5 AND 6.0""",
        "annotations",
    ),
)
def plate_aspect_filter(spark, sf):
    w, h = F.col("w"), F.col("h")
    return X.annotations(spark, sf).where(B.plate_aspect_ok(w, h)).select(
        "sample_id", "label_index",
        *[B.plate_aspect_ok(w, h, region).alias(region) for region in ("eu", "us", "china")],
    )


@query(
    "eye_distance",
    sql(
        """SELECT sample_id, label_index,
        CASE WHEN class_id <> 0 THEN round(sqrt(pow((x2 - x1) * 640, 2) +
          pow((cy - y1) * 480, 2)), 6) END AS distance FROM corners""",
        "corners",
    ),
)
def eye_distance(spark, sf):
    df = qa.with_corners(X.annotations(spark, sf))
    a = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    b = F.struct(F.col("x2").alias("x"), F.col("cy").alias("y"))
    marks = F.when(F.col("class_id") == 0, F.array(a)).otherwise(F.array(a, b))
    return df.select(
        "sample_id", "label_index",
        _r(B.point_distance(marks, F.lit(640), F.lit(480)), 6).alias("distance"),
    )


@query(
    "stem_normalize",
    """SELECT l_orderkey AS sample_id, l_linenumber AS line, count(*) AS n,
    l_linenumber || '_img' || l_orderkey AS normalized FROM lineitem GROUP BY ALL""",
)
def stem_normalize(spark, sf):
    raw = F.concat(
        F.lpad(F.col("l_linenumber").cast("string"), 5, "0"), F.lit("_"), F.col("l_linenumber"),
        F.lit("_img"), F.col("l_orderkey"),
    )
    return X.table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("line"),
        B.clean_stem(raw).alias("normalized"),
    ).agg(F.count(F.lit(1)).alias("n"))


# ---- dataset algebra ------------------------------------------------------------------------


@query(
    "filter_by_class",
    sql(
        """SELECT s.sample_id, count(*) AS kept FROM samples s JOIN annotations a
        ON a.sample_id = s.sample_id WHERE class_name IN ('AF', 'RO') GROUP BY 1""",
        "samples",
        "annotations",
    ),
)
def filter_by_class(spark, sf):
    ds = D.filter_by_class(X.dataset(spark, sf), ["AF", "RO"])
    per = ds.labels.groupBy("sample_id").agg(F.count(F.lit(1)).alias("kept"))
    return ds.samples.select("sample_id").join(per, "sample_id")


@query(
    "filter_by_confidence",
    sql(
        """SELECT s.sample_id, count(a.sample_id) AS kept FROM samples s LEFT JOIN annotations a
        ON a.sample_id = s.sample_id AND confidence >= 0.8 GROUP BY 1""",
        "samples",
        "annotations",
    ),
)
def filter_by_confidence(spark, sf):
    ds = D.filter_by_confidence(X.dataset(spark, sf), 0.8)
    per = ds.labels.groupBy("sample_id").agg(F.count(F.lit(1)).alias("kept"))
    return ds.samples.select("sample_id").join(per, "sample_id", "left").na.fill(0, ["kept"])


@query(
    "detections_filter",
    sql(
        """SELECT sample_id, label_index, class_name, round(confidence, 9) AS confidence
        FROM annotations WHERE confidence >= 0.7 AND class_name IN ('AF', 'NO')""",
        "annotations",
    ),
)
def detections_filter(spark, sf):
    return X.annotations(spark, sf).where(
        (F.col("confidence") >= 0.7) & F.col("class_name").isin(D.normalize_names([" AF", "NO", ""]))
    ).select("sample_id", "label_index", "class_name", _r("confidence").alias("confidence"))


@query(
    "class_filter_normalize",
    """SELECT c_custkey, array_to_string(list_transform(list_filter(list_sort(list_distinct(
    [trim(' ' || c_mktsegment), 'BUILDING', ''])), lambda x: x <> ''), lambda x: x), ',') AS names
    FROM customer""",
)
def class_filter_normalize(spark, sf):
    raw = F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit("BUILDING"), F.lit(" "))
    clean = F.array_distinct(F.filter(F.transform(raw, lambda v: F.trim(v)), lambda v: v != ""))
    return X.table(spark, sf, "customer").select(
        "c_custkey", F.array_join(F.array_sort(clean), ",").alias("names")
    )


@query(
    "class_index",
    sql(
        """SELECT p_partkey, c.class_id FROM part JOIN classes c
        ON lower(trim(' ' || CASE WHEN p_size > 25 THEN 'aF' ELSE 'rO' END)) = lower(c.class_name)""",
        "classes",
    ),
)
def class_index(spark, sf):
    named = X.table(spark, sf, "part").select(
        "p_partkey",
        F.lower(
            F.trim(F.concat(F.lit(" "), F.when(F.col("p_size") > 25, "aF").otherwise("rO")))
        ).alias("name"),
    )
    classes = X.classes(spark, sf).select("class_id", F.lower("class_name").alias("name"))
    return named.join(classes, "name").select("p_partkey", "class_id")


@query(
    "unlabeled_samples",
    sql(
        """SELECT sample_id, image_path FROM samples WHERE sample_id NOT IN
        (SELECT sample_id FROM annotations)""",
        "samples",
        "annotations",
    ),
)
def unlabeled_samples(spark, sf):
    return D.unlabeled_samples(X.dataset(spark, sf)).select("sample_id", "image_path")


@query(
    "missing_images",
    sql(
        "SELECT sample_id FROM samples WHERE image_path NOT IN (SELECT path FROM on_disk)",
        "samples",
        "on_disk",
    ),
)
def missing_images(spark, sf):
    return D.missing_images(X.dataset(spark, sf), X.on_disk(spark, sf)).select("sample_id")


@query(
    "class_distribution",
    sql("SELECT class_name, count(*) AS label_count FROM annotations GROUP BY 1", "annotations"),
)
def class_distribution(spark, sf):
    return D.class_distribution(X.annotations(spark, sf))


@query(
    "samples_per_class",
    sql(
        """SELECT class_name, count(DISTINCT sample_id) AS sample_count FROM annotations
        GROUP BY 1""",
        "annotations",
    ),
)
def samples_per_class(spark, sf):
    return D.samples_per_class(X.annotations(spark, sf))


@query(
    "class_details",
    sql(
        """SELECT class_name, count(*) AS label_count, count(DISTINCT sample_id) AS sample_count,
        round(count(*) / count(DISTINCT sample_id), 9) AS avg_per_sample
        FROM annotations GROUP BY 1""",
        "annotations",
    ),
)
def class_details(spark, sf):
    return D.class_details(X.annotations(spark, sf)).withColumn(
        "avg_per_sample", _r("avg_per_sample")
    )


@query(
    "infer_class_names",
    sql(
        """SELECT class_id, arg_min(class_name, (ordinal, label_index)) AS class_name
        FROM annotations JOIN samples USING (sample_id) GROUP BY 1""",
        "samples",
        "annotations",
    ),
)
def infer_class_names(spark, sf):
    return D.infer_classes(X.dataset(spark, sf))


@query(
    "resolve_class_names",
    sql(
        """, last_seen AS (SELECT class_id, arg_max(class_name, (ordinal, label_index)) AS seen
          FROM annotations JOIN samples USING (sample_id) GROUP BY 1),
        declared AS (SELECT class_id * 2 AS class_id,
          CASE WHEN class_id < 2 THEN 'class_' || class_id * 2 ELSE class_name END AS class_name
          FROM classes),
        ids AS (SELECT unnest(generate_series(0, (SELECT max(class_id) FROM declared))) AS class_id)
        SELECT CAST(ids.class_id AS INTEGER) AS class_id,
          coalesce(nullif(declared.class_name, 'class_' || ids.class_id),
          seen, 'class_' || ids.class_id) AS class_name
        FROM ids LEFT JOIN declared USING (class_id) LEFT JOIN last_seen USING (class_id)""",
        "samples",
        "annotations",
        "classes",
    ),
)
def resolve_class_names(spark, sf):
    ds = X.dataset(spark, sf)
    twice = F.col("class_id") * 2
    name = F.when(F.col("class_id") < 2, F.concat(F.lit("class_"), twice)).otherwise(
        F.col("class_name")
    )
    declared = ds.classes.select(twice.alias("class_id"), name.alias("class_name"))
    return D.resolve_classes(Dataset(ds.samples, ds.labels, declared))


@query(
    "dataset_stats",
    sql(
        """SELECT (SELECT count(*) FROM samples) AS num_samples,
        (SELECT count(*) FROM annotations) AS num_labels,
        (SELECT count(*) FROM classes) AS num_classes,
        (SELECT count(*) FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM annotations))
          AS unlabeled_count,
        round((SELECT count(*) FROM annotations) / (SELECT count(*) FROM samples), 9)
          AS avg_labels_per_sample""",
        "samples",
        "annotations",
        "classes",
    ),
)
def dataset_stats(spark, sf):
    return D.dataset_stats(X.dataset(spark, sf)).withColumn(
        "avg_labels_per_sample", _r("avg_labels_per_sample")
    )


def _second(spark, sf) -> Dataset:
    """A second dataset over suppliers and their line items, with names of its own."""
    labels = X.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sample_id"),
        F.col("l_orderkey").alias("label_index"),
        F.col("l_linestatus").alias("class_name"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("class_id"),
    )
    samples = X.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("sample_id"), F.col("s_suppkey").alias("ordinal"),
        F.col("s_name").alias("image_path"),
    )
    classes = X.table(spark, sf, "region").where("r_regionkey < 3").select(
        F.col("r_regionkey").alias("class_id"),
        F.when(F.col("r_regionkey") == 0, "O").when(F.col("r_regionkey") == 1, "F")
        .otherwise("AF").alias("class_name"),
    )
    return Dataset(samples, labels, classes, "suppliers")


@query(
    "merge",
    sql(
        """, names AS (SELECT class_name, min((side, class_id)) AS seen_at FROM (
          SELECT class_name, 0 AS side, class_id FROM classes UNION ALL
          SELECT CASE r_regionkey WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'AF' END, 1, r_regionkey
          FROM region WHERE r_regionkey < 3) GROUP BY 1),
        merged AS (SELECT class_name, row_number() OVER (ORDER BY seen_at) - 1 AS class_id FROM names),
        united AS (SELECT 0 AS source, class_name, class_id FROM annotations UNION ALL
          SELECT 1, l_linestatus, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END FROM lineitem)
        SELECT source, u.class_name, u.class_id AS own_id, m.class_id AS merged_id,
        count(*) AS label_count FROM united u JOIN merged m USING (class_name) GROUP BY 1, 2, 3, 4""",
        "annotations",
        "classes",
    ),
)
def merge(spark, sf):
    a = X.dataset(spark, sf)
    m = D.merge(Dataset(a.samples, a.labels, a.classes, a.name), _second(spark, sf))
    return (
        m.labels.select("source", "class_name", F.col("class_id").alias("own_id"))
        .groupBy("source", "class_name", "own_id")
        .agg(F.count(F.lit(1)).alias("label_count"))
        .join(m.classes.select("class_name", F.col("class_id").alias("merged_id")), "class_name")
    )


@query(
    "subset",
    sql(
        """SELECT s.sample_id, count(a.sample_id) AS labels FROM samples s
        LEFT JOIN annotations a USING (sample_id)
        WHERE ordinal IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""",
        "samples",
        "annotations",
    ),
)
def subset(spark, sf):
    wanted = X.table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("ordinal")
    )
    ds = D.subset(X.dataset(spark, sf), wanted)
    per = ds.labels.groupBy("sample_id").agg(F.count(F.lit(1)).alias("labels"))
    return ds.samples.select("sample_id").join(per, "sample_id", "left").na.fill(0, ["labels"])


@query(
    "requested_class_check",
    sql(
        """SELECT unnest(['AF', 'truck', 'RO', 'bus']) AS class_name EXCEPT
        SELECT class_name FROM classes""",
        "classes",
    ),
)
def requested_class_check(spark, sf):
    return D.missing_classes(X.classes(spark, sf), ["AF", "truck", "RO", "bus"])


@query(
    "path_distinct",
    """SELECT url AS path, min(page_id) AS first_id FROM pages GROUP BY 1""",
)
def path_distinct(spark, sf):
    return X.table(spark, sf, "pages").groupBy(F.col("url").alias("path")).agg(
        F.min("page_id").alias("first_id")
    )


def _draw_sql(tag: str) -> str:
    return f"('0x' || substr(md5(sample_id || ':' || copy || ':7{tag}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"


@query(
    "augment_boxes",
    sql(
        f""", copies AS (SELECT a.*, copy FROM annotations a, (SELECT unnest([0, 1, 2]) AS copy)),
        drawn AS (SELECT *, CASE WHEN {_draw_sql("flip")} < 0.5 AND copy > 0 THEN 1 - cx ELSE cx END AS fx,
          CASE WHEN copy > 0 THEN ({_draw_sql("dx")} * 2 - 1) * 0.1::DOUBLE ELSE 0 END AS dx,
          CASE WHEN copy > 0 THEN ({_draw_sql("dy")} * 2 - 1) * 0.1::DOUBLE ELSE 0 END AS dy FROM copies),
        cut AS (SELECT *, greatest(0, fx + dx - w / 2) AS x1, least(1, fx + dx + w / 2) AS x2,
          greatest(0, cy + dy - h / 2) AS y1, least(1, cy + dy + h / 2) AS y2 FROM drawn)
        SELECT copy, class_name, count(*) AS boxes, round(avg(CASE WHEN copy = 0 THEN cx ELSE (x1 + x2) / 2 END), 6) AS mean_cx,
        round(min(CASE WHEN copy = 0 THEN w * h ELSE (x2 - x1) * (y2 - y1) END), 9) AS min_area FROM cut
        WHERE copy = 0 OR (x2 > x1 AND y2 > y1 AND (x2 - x1) * (y2 - y1) >= 0.01 * w * h) GROUP BY 1, 2""",
        "annotations",
    ),
)
def augment_boxes(spark, sf):
    ds = D.augment_boxes(X.dataset(spark, sf), copies=2, seed=7)
    return ds.labels.groupBy("copy", "class_name").agg(
        F.count(F.lit(1)).alias("boxes"), _r(F.avg("cx"), 6).alias("mean_cx"),
        _r(F.min(F.col("w") * F.col("h")), 9).alias("min_area"),
    )


# ---- label quality --------------------------------------------------------------------------


@query(
    "label_pairs",
    sql(
        _PAIRS + " SELECT sample_id, i, j, round(iou, 9) AS iou FROM pairs WHERE iou >= 0.3",
        "corners",
    ),
)
def label_pairs(spark, sf):
    from framewright.functions.joins import self_iou_join

    slim = qa.with_corners(X.annotations(spark, sf)).select(
        "sample_id", "label_index", "x1", "y1", "x2", "y2"
    )
    return self_iou_join(slim, ["sample_id"], "label_index", 0.3).select(
        "sample_id", F.col("l.label_index").alias("i"), F.col("r.label_index").alias("j"),
        _r("iou").alias("iou"),
    )


@query(
    "bbox_iou",
    sql(
        _PAIRS + """ SELECT id_i AS class_a, id_j AS class_b, count(*) AS pairs,
        round(avg(iou), 6) AS mean_iou, round(max(iou), 9) AS max_iou FROM pairs
        WHERE iou >= 0.1 GROUP BY 1, 2""",
        "corners",
    ),
)
def bbox_iou(spark, sf):
    from framewright.functions.joins import self_iou_join

    slim = qa.with_corners(X.annotations(spark, sf)).select(
        "sample_id", "label_index", "class_id", "x1", "y1", "x2", "y2"
    )
    pairs = self_iou_join(slim, ["sample_id"], "label_index", 0.1)
    return pairs.groupBy(
        F.col("l.class_id").alias("class_a"), F.col("r.class_id").alias("class_b")
    ).agg(
        F.count(F.lit(1)).alias("pairs"), _r(F.avg("iou"), 6).alias("mean_iou"),
        _r(F.max("iou")).alias("max_iou"),
    )


def _plain(issues, *cols):
    return issues.select(*cols)


@query(
    "qa_missing_labels",
    sql(
        """SELECT 'missing_labels' AS issue_type, 'warning' AS severity, sample_id FROM samples
        WHERE sample_id NOT IN (SELECT sample_id FROM annotations)""",
        "samples",
        "annotations",
    ),
)
def qa_missing_labels(spark, sf):
    return _plain(qa.missing_labels(X.dataset(spark, sf)), "issue_type", "severity", "sample_id")


@query(
    "qa_missing_images",
    sql(
        """SELECT 'missing_image' AS issue_type, 'error' AS severity, sample_id FROM samples
        WHERE image_path NOT IN (SELECT path FROM on_disk)""",
        "samples",
        "on_disk",
    ),
)
def qa_missing_images(spark, sf):
    issues = qa.missing_images(X.dataset(spark, sf), X.on_disk(spark, sf))
    return _plain(issues, "issue_type", "severity", "sample_id")


@query(
    "qa_overlap",
    sql(
        _PAIRS + """ SELECT sample_id, i AS label_index, j AS other_index, round(iou, 9) AS measure
        FROM pairs WHERE iou > 0.8""",
        "corners",
    ),
)
def qa_overlap(spark, sf):
    return qa.overlapping(X.dataset(spark, sf)).select(
        "sample_id", "label_index", "other_index", _r("measure").alias("measure")
    )


@query(
    "qa_pair_counts",
    sql(
        f""", sup AS (SELECT l_suppkey AS sample_id, l_orderkey AS label_index, class_id, {X.KEY_SQL} AS k, x1, y1, x2, y2
          FROM corners c JOIN lineitem l ON l.l_orderkey = c.sample_id AND {X.KEY_SQL} = c.label_index),
        hits AS (SELECT a.sample_id, a.label_index AS i, a.k AS ik, b.label_index AS j, b.k AS jk, a.class_id = b.class_id AS same, """
        + _IOU + """ AS iou FROM sup a JOIN sup b ON a.sample_id = b.sample_id AND (a.label_index, a.k) < (b.label_index, b.k)),
        kinds AS (SELECT *, 'overlapping_boxes' AS issue_type FROM hits WHERE iou > 0.6
          UNION ALL SELECT *, 'duplicate_label' FROM hits WHERE same AND iou > 0.95),
        ends AS (SELECT issue_type, sample_id, count(DISTINCT (i, ik)) AS boxes FROM (SELECT issue_type, sample_id, i, ik FROM kinds
          UNION ALL SELECT issue_type, sample_id, j, jk FROM kinds) GROUP BY 1, 2)
        SELECT issue_type, sample_id, count(*) AS pairs, any_value(boxes) AS boxes, round(max(iou), 9) AS max_iou
        FROM kinds JOIN ends USING (issue_type, sample_id) GROUP BY 1, 2""",
        "corners",
    ),
)
def qa_pair_counts(spark, sf):
    labels = X.annotations(spark, sf, image="l_suppkey", index=F.col("l_orderkey"))
    found = qa.pair_counts(Dataset(X.samples(spark, sf), labels), 0.6)
    return found.select("issue_type", "sample_id", "pairs", "boxes", _r("max_iou").alias("max_iou"))


@query(
    "qa_duplicate_label",
    sql(
        f""", sup AS (SELECT l_suppkey AS sample_id, l_orderkey AS label_index, class_name, class_id,
          x1, y1, x2, y2 FROM corners c JOIN lineitem l ON l.l_orderkey = c.sample_id
          AND {X.KEY_SQL} = c.label_index)
        SELECT a.sample_id, a.label_index, b.label_index AS other_index, a.class_name
        FROM sup a JOIN sup b ON a.sample_id = b.sample_id AND a.class_id = b.class_id
        AND a.label_index < b.label_index WHERE """ + _IOU + " > 0.95",
        "corners",
    ),
)
def qa_duplicate_label(spark, sf):
    # Boxes of a supplier share one image here: groups large enough to hold near-equal boxes.
    labels = X.annotations(spark, sf, image="l_suppkey", index=F.col("l_orderkey"))
    return qa.duplicate_labels(Dataset(X.samples(spark, sf), labels)).select(
        "sample_id", "label_index", "other_index", "class_name"
    )


@query(
    "qa_out_of_bounds",
    sql(
        """SELECT sample_id, label_index, class_name FROM corners
        WHERE NOT (x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1)""",
        "corners",
    ),
)
def qa_out_of_bounds(spark, sf):
    return qa.out_of_bounds(X.annotations(spark, sf)).select(
        "sample_id", "label_index", "class_name"
    )


@query(
    "qa_tiny",
    sql(
        """SELECT sample_id, label_index, round(w * h, 9) AS measure FROM annotations
        WHERE w * h < 0.001""",
        "annotations",
    ),
)
def qa_tiny(spark, sf):
    return qa.tiny_boxes(X.annotations(spark, sf)).select(
        "sample_id", "label_index", _r("measure").alias("measure")
    )


@query(
    "qa_huge",
    sql(
        """SELECT sample_id, label_index, round(w * h, 9) AS measure FROM annotations
        WHERE w * h > 0.9""",
        "annotations",
    ),
)
def qa_huge(spark, sf):
    return qa.huge_boxes(X.annotations(spark, sf)).select(
        "sample_id", "label_index", _r("measure").alias("measure")
    )


_IMBALANCE = """SELECT c.class_name, CASE WHEN count(a.class_name) = 0 THEN NULL ELSE
  round((SELECT max(n) FROM (SELECT count(*) AS n FROM annotations GROUP BY class_name))
  / count(a.class_name), 9) END AS measure FROM classes c LEFT JOIN annotations a
  ON a.class_name = c.class_name GROUP BY 1 HAVING count(a.class_name) = 0 OR
  (SELECT max(n) FROM (SELECT count(*) AS n FROM annotations GROUP BY class_name))
  / count(a.class_name) > 1.005"""


@query("qa_imbalance", sql(_IMBALANCE, "classes", "annotations"))
def qa_imbalance(spark, sf):
    issues = qa.class_imbalance(X.dataset(spark, sf), 1.005)
    finite = F.when(F.col("measure") < float("inf"), _r("measure"))  # unused class: no ratio
    return issues.select("class_name", finite.alias("measure"))


_ISSUES = _PAIRS + f""", issues AS (
  SELECT 'missing_labels' AS issue_type, 'warning' AS severity, sample_id, NULL AS label_index,
    NULL AS other_index, NULL AS class_name FROM samples
    WHERE sample_id NOT IN (SELECT sample_id FROM annotations)
  UNION ALL SELECT 'missing_image', 'error', sample_id, NULL, NULL, NULL FROM samples
    WHERE image_path NOT IN (SELECT path FROM on_disk)
  UNION ALL SELECT 'overlapping_boxes', 'warning', sample_id, i, j, class_i FROM pairs
    WHERE iou > 0.8
  UNION ALL SELECT 'out_of_bounds', 'warning', sample_id, label_index, NULL, class_name FROM corners
    WHERE NOT (x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1)
  UNION ALL SELECT 'tiny_box', 'warning', sample_id, label_index, NULL, class_name FROM corners
    WHERE w * h < 0.001
  UNION ALL SELECT 'huge_box', 'info', sample_id, label_index, NULL, class_name FROM corners
    WHERE w * h > 0.9
  UNION ALL SELECT 'class_imbalance', 'warning', NULL, NULL, NULL, class_name
    FROM (SELECT c.class_name FROM classes c LEFT JOIN annotations a ON a.class_name = c.class_name
    GROUP BY 1 HAVING count(a.class_name) = 0)
  UNION ALL SELECT 'duplicate_label', 'warning', sample_id, i, j, class_i FROM pairs
    WHERE iou > 0.95 AND id_i = id_j)"""
_VIEWS = ("samples", "on_disk", "classes", "corners")


def _issues(spark, sf):
    return qa.run(X.dataset(spark, sf), X.on_disk(spark, sf))


@query(
    "qa_run",
    sql(
        _ISSUES + """ SELECT issue_type, severity, sample_id, label_index, other_index, class_name
        FROM issues""",
        *_VIEWS,
    ),
)
def qa_run(spark, sf):
    return _issues(spark, sf).drop("measure")


@query(
    "issue_summary",
    sql(
        _ISSUES + """, firsts AS (SELECT issue_type, string_agg(image_path, '|' ORDER BY rn) AS p
          FROM (SELECT *, row_number() OVER (PARTITION BY issue_type ORDER BY sample_id) AS rn
            FROM (SELECT DISTINCT issue_type, sample_id FROM issues WHERE sample_id IS NOT NULL))
          JOIN samples USING (sample_id) WHERE rn <= 5 GROUP BY 1)
        SELECT issue_type, count(*) AS issue_count, any_value(severity) AS severity,
        coalesce(any_value(p), '') AS sample_paths
        FROM issues LEFT JOIN firsts USING (issue_type) GROUP BY 1""",
        *_VIEWS,
    ),
)
def issue_summary(spark, sf):
    return report.issue_summary(materialize(_issues(spark, sf)), X.samples(spark, sf))


@query(
    "report_severity_totals",
    sql(
        _ISSUES + """ SELECT count(*) AS total_issues,
        count(*) FILTER (severity = 'error') AS errors,
        count(*) FILTER (severity = 'warning') AS warnings,
        count(*) FILTER (severity = 'info') AS infos FROM issues""",
        *_VIEWS,
    ),
)
def report_severity_totals(spark, sf):
    return report.severity_totals(_issues(spark, sf))


@query(
    "issues_capped",
    sql(
        _ISSUES + """ SELECT * FROM (SELECT issue_type, sample_id, label_index, other_index,
        class_name, row_number() OVER (PARTITION BY issue_type ORDER BY sample_id NULLS LAST,
          label_index NULLS FIRST, other_index NULLS FIRST, class_name NULLS FIRST) AS position,
        greatest(0, count(*) OVER (PARTITION BY issue_type) - 25) AS hidden_count FROM issues)
        WHERE position <= 25""",
        *_VIEWS,
    ),
)
def issues_capped(spark, sf):
    return report.issues_capped(materialize(_issues(spark, sf))).drop("severity", "measure")


@query(
    "gallery_rank",
    sql(
        _ISSUES + """, per AS (SELECT sample_id, min(CASE severity WHEN 'error' THEN 0
            WHEN 'warning' THEN 1 ELSE 2 END) AS r, count(*) AS n
          FROM issues WHERE sample_id IS NOT NULL GROUP BY 1),
        top AS (SELECT per.*, image_path, row_number() OVER (ORDER BY r, n DESC, image_path)
          AS gallery_position FROM per JOIN samples USING (sample_id)
          ORDER BY r, n DESC, image_path LIMIT 12)
        SELECT gallery_position, image_path, ['error', 'warning', 'info'][r + 1] AS worst_severity,
        n AS issue_count, issue_position, issue_type, label_index FROM (SELECT *, row_number()
          OVER (PARTITION BY sample_id ORDER BY issue_type, label_index NULLS FIRST,
          other_index NULLS FIRST) AS issue_position FROM issues JOIN top USING (sample_id))
        WHERE issue_position <= 5""",
        *_VIEWS,
    ),
)
def gallery_rank(spark, sf):
    return report.gallery_rank(materialize(_issues(spark, sf)), X.samples(spark, sf))


@query(
    "write_report_tables",
    sql(
        """, used AS (SELECT class_name, count(*) AS label_count,
          count(DISTINCT sample_id) AS sample_count FROM annotations GROUP BY 1)
        SELECT c.class_id, c.class_name, coalesce(label_count, 0) AS label_count,
        coalesce(sample_count, 0) AS sample_count,
        round(coalesce(label_count / sample_count, 0), 9) AS avg_per_sample
        FROM classes c LEFT JOIN used u ON u.class_name = c.class_name""",
        "classes",
        "annotations",
    ),
)
def write_report_tables(spark, sf):
    """The class table of the four written ones, read back."""
    root = scratch_path(spark, "report")
    ds = Dataset(X.samples(spark, sf), X.annotations(spark, sf), X.classes(spark, sf), "report")
    write_tables(ds, materialize(_issues(spark, sf)), root)
    return spark.read.parquet(f"{root}/classes").withColumn("avg_per_sample", _r("avg_per_sample"))


# ---- splits ---------------------------------------------------------------------------------

_RATIOS = {"train": 0.8, "val": 0.15, "test": 0.05}
_ALLOC = """ratios AS (SELECT * FROM (VALUES ('train', 0, CAST(0.8 AS DOUBLE)),
    ('val', 1, CAST(0.15 AS DOUBLE)), ('test', 2, CAST(0.05 AS DOUBLE))) t(split, pos, ratio)),
  want AS (SELECT g, n, split, pos, n * (ratio / (SELECT sum(ratio) FROM ratios)) AS e
    FROM sizes, ratios),
  counts AS (SELECT g, split, pos, floor(e) + CASE WHEN row_number() OVER (PARTITION BY g
    ORDER BY e - floor(e) DESC, pos) <= n - sum(floor(e)) OVER (PARTITION BY g) THEN 1 ELSE 0 END
    AS c FROM want),
  edges AS (SELECT g, split, sum(c) OVER (PARTITION BY g ORDER BY pos) AS hi,
    sum(c) OVER (PARTITION BY g ORDER BY pos) - c AS lo FROM counts)"""


@query(
    "split_random",
    sql(
        f""", ranked AS (SELECT sample_id, 0 AS g, row_number() OVER (ORDER BY
            md5(sample_id || ':42')) - 1 AS r FROM samples),
        sizes AS (SELECT 0 AS g, count(*) AS n FROM samples), {_ALLOC}
        SELECT sample_id, split AS assigned FROM ranked JOIN edges ON ranked.g = edges.g
        AND r >= lo AND r < hi""",
        "samples",
    ),
)
def split_random(spark, sf):
    return split.split_random(X.samples(spark, sf), _RATIOS, 42).select("sample_id", "assigned")


@query(
    "split_stratified",
    sql(
        f""", strata AS (SELECT s.sample_id, coalesce(arg_min(class_name, label_index),
            '__unlabeled__') AS g FROM samples s LEFT JOIN annotations a USING (sample_id)
            GROUP BY 1),
        ranked AS (SELECT sample_id, g, row_number() OVER (PARTITION BY g ORDER BY
            md5(sample_id || ':42')) - 1 AS r FROM strata),
        sizes AS (SELECT g, count(*) AS n FROM strata GROUP BY 1), {_ALLOC}
        SELECT sample_id, ranked.g AS stratum, split AS assigned FROM ranked JOIN edges
        ON ranked.g = edges.g AND r >= lo AND r < hi""",
        "samples",
        "annotations",
    ),
)
def split_stratified(spark, sf):
    return split.split_stratified(X.dataset(spark, sf), _RATIOS, 42)


@query(
    "split_yolo_ratio",
    sql(
        """, ranked AS (SELECT sample_id, row_number() OVER (ORDER BY md5(sample_id || ':1')) - 1
          AS r, count(*) OVER () AS n FROM samples)
        SELECT sample_id, CASE WHEN r < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
        WHEN r < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'val'
        ELSE 'test' END AS assigned FROM ranked""",
        "samples",
    ),
)
def split_yolo_ratio(spark, sf):
    ratios = {"train": 7, "val": 2, "test": 1}
    return split.split_random(X.samples(spark, sf), ratios, 1, rule="floor").select(
        "sample_id", "assigned"
    )


@query(
    "kfold",
    sql(
        """, ranked AS (SELECT sample_id, row_number() OVER (ORDER BY md5(sample_id || ':3')) - 1
          AS r, count(*) OVER () AS n FROM samples)
        SELECT sample_id, CAST(CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1)
        ELSE n % 7 + (r - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold
        FROM ranked""",
        "samples",
    ),
)
def kfold(spark, sf):
    return split.kfold(X.samples(spark, sf), 7, 3).select("sample_id", "fold")


@query(
    "split_by_metadata",
    sql("SELECT sample_id, coalesce(split, 'train') AS assigned FROM samples", "samples"),
)
def split_by_metadata(spark, sf):
    return split.split_by_metadata(X.samples(spark, sf)).select("sample_id", "assigned")


@query(
    "split_report",
    sql(
        """, given AS (SELECT sample_id, coalesce(split, 'train') AS assigned FROM samples),
        sizes AS (SELECT assigned, count(*) AS sample_count FROM given GROUP BY 1),
        per AS (SELECT assigned, class_name, count(*) AS class_labels FROM given
          JOIN annotations USING (sample_id) GROUP BY 1, 2)
        SELECT assigned, sample_count, class_name, class_labels,
        round(sample_count / (SELECT sum(sample_count) FROM sizes), 9) AS actual_ratio,
        CAST(sum(class_labels) OVER (PARTITION BY assigned) AS BIGINT) AS label_count
        FROM sizes JOIN per USING (assigned)""",
        "samples",
        "annotations",
    ),
)
def split_report(spark, sf):
    assigned = split.split_by_metadata(X.samples(spark, sf))
    return split.split_report(assigned, X.annotations(spark, sf)).withColumn(
        "actual_ratio", _r("actual_ratio")
    )
