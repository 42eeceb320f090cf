"""Projection, fusion and time alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import geometry3d as G
from framewright.operators import fusion, sync
from framewright.plans import fixtures as X
from framewright.plans.fixtures import sql
from framewright.plans.registry import query

K = (X.FX, 0.0, X.CX, 0.0, X.FY, X.CY, 0.0, 0.0, 1.0)
T = (0.0, -1.0, 0.0, 25.0, 0.0, 0.0, -1.0, 4.0, 1.0, 0.0, 0.0, 0.5)  # x ahead, y left, z up
_U = "(500 * ((25 - y / 2) / (x + 0.5)) + 320)"
_V = "(500 * ((4 - z) / (x + 0.5)) + 240)"


def _r(c, d=6):
    return F.round(c, d).alias(c)


@query(
    "transform_points",
    sql(
        """SELECT cloud_id, point_idx, round(25 - y / 2, 6) AS tx, round(4 - z, 6) AS ty,
        round(x + 0.5, 6) AS tz FROM points""",
        "points",
    ),
)
def transform_points(spark, sf):
    pts = X.points(spark, sf).withColumn("y", F.col("y") / 2)
    out = G.transform(F.col("x"), F.col("y"), F.col("z"), T)
    return pts.select(
        "cloud_id", "point_idx", *[F.round(e, 6).alias(n) for n, e in zip(("tx", "ty", "tz"), out)]
    )


def _projected(spark, sf):
    pts = X.points(spark, sf).withColumn("y", F.col("y") / 2)
    return G.project(pts, K, X.CAM_W, X.CAM_H, T)


@query(
    "project_points",
    sql(
        f"""SELECT cloud_id, point_idx, round({_U}, 6) AS u, round({_V}, 6) AS v,
        round(x + 0.5, 6) AS depth, {_U} >= 0 AND {_U} < 640 AND {_V} >= 0 AND {_V} < 480 AS valid
        FROM points""",
        "points",
    ),
)
def project_points(spark, sf):
    return _projected(spark, sf).select(
        "cloud_id", "point_idx", _r("u"), _r("v"), _r("depth"), "valid"
    )


@query(
    "coord_convert",
    sql(
        """SELECT cloud_id, point_idx, round(y, 6) AS kx, round(-x, 6) AS ky, round(z, 6) AS kz,
        round(-y, 6) AS nx, round(x, 6) AS ny FROM points""",
        "points",
    ),
)
def coord_convert(spark, sf):
    xyz = (F.col("x"), F.col("y"), F.col("z"))
    kx, ky, kz = G.convert_axes(*xyz, "nuscenes", "kitti")
    nx, ny, _ = G.convert_axes(*xyz, "kitti", "nuscenes")
    out = dict(kx=kx, ky=ky, kz=kz, nx=nx, ny=ny)
    return X.points(spark, sf).select(
        "cloud_id", "point_idx", *[F.round(e, 6).alias(n) for n, e in out.items()]
    )


@query(
    "box3d_volume",
    sql("SELECT frame_id, det_id, round(l * w * h, 6) AS volume FROM boxes3d", "boxes3d"),
)
def box3d_volume(spark, sf):
    return X.boxes3d(spark, sf).select(
        "frame_id", "det_id", F.round(F.col("l") * F.col("w") * F.col("h"), 6).alias("volume")
    )


_CORNERS = """, signs AS (SELECT * FROM (VALUES (0, 1, 1, -1), (1, 1, -1, -1), (2, 1, -1, 1),
    (3, 1, 1, 1), (4, -1, 1, -1), (5, -1, -1, -1), (6, -1, -1, 1), (7, -1, 1, 1))
    t(corner, sl, sw, sh)),
  corners3 AS (SELECT frame_id, det_id, corner,
    x + sl * l / 2 * cos(yaw) - sw * w / 2 * sin(yaw) AS cx,
    y + sl * l / 2 * sin(yaw) + sw * w / 2 * cos(yaw) AS cy, z + sh * h / 2 AS cz
    FROM boxes3d, signs)"""
_PROJECTED = _CORNERS + """, proj AS (SELECT frame_id, det_id,
    greatest(0, least(640, min(500 * cx / cz + 320))) AS x1,
    greatest(0, least(480, min(500 * cy / cz + 240))) AS y1,
    greatest(0, least(640, max(500 * cx / cz + 320))) AS x2,
    greatest(0, least(480, max(500 * cy / cz + 240))) AS y2
    FROM corners3 WHERE cz > 0 GROUP BY 1, 2),
  shown AS (SELECT * FROM proj WHERE x2 > x1 AND y2 > y1)"""


@query(
    "box3d_corners",
    sql(
        _CORNERS + """ SELECT frame_id, det_id, corner, round(cx, 6) AS cx, round(cy, 6) AS cy,
        round(cz, 6) AS cz FROM corners3""",
        "boxes3d",
    ),
)
def box3d_corners(spark, sf):
    cols = [F.col(c) for c in ("x", "y", "z", "l", "w", "h", "yaw")]
    rows = X.boxes3d(spark, sf).select(
        "frame_id", "det_id", F.posexplode(G.box_corners(*cols)).alias("corner", "c")
    )
    return rows.select(
        "frame_id", "det_id", "corner", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"),
        F.round("c.z", 6).alias("cz"),
    )


@query(
    "box3d_project",
    sql(
        _PROJECTED + """ SELECT b.frame_id, b.det_id, round(x1, 6) AS x1, round(y1, 6) AS y1,
        round(x2, 6) AS x2, round(y2, 6) AS y2 FROM boxes3d b LEFT JOIN shown USING
        (frame_id, det_id)""",
        "boxes3d",
    ),
)
def box3d_project(spark, sf):
    out = G.project_boxes(X.boxes3d(spark, sf), K, X.CAM_W, X.CAM_H)
    return out.select("frame_id", "det_id", *[_r(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "projection_summary",
    sql(
        _PROJECTED + """ SELECT class_name, count(*) AS boxes, count(x1) AS visible
        FROM boxes3d b LEFT JOIN shown USING (frame_id, det_id) GROUP BY 1""",
        "boxes3d",
    ),
)
def projection_summary(spark, sf):
    out = G.project_boxes(X.boxes3d(spark, sf), K, X.CAM_W, X.CAM_H)
    return out.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("boxes"), F.count("x1").alias("visible")
    )


@query(
    "detection3d_summary",
    sql(
        """SELECT class_name, count(*) AS boxes, round(avg(confidence), 6) AS mean_confidence,
        round(max(z), 3) AS far FROM boxes3d GROUP BY 1""",
        "boxes3d",
    ),
)
def detection3d_summary(spark, sf):
    return X.boxes3d(spark, sf).groupBy("class_name").agg(
        F.count(F.lit(1)).alias("boxes"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.max("z"), 3).alias("far"),
    )


@query(
    "quat_from_yaw",
    sql(
        """SELECT frame_id, det_id, round(cos(yaw / 2), 9) AS qw, round(sin(yaw / 2), 9) AS qz
        FROM boxes3d""",
        "boxes3d",
    ),
)
def quat_from_yaw(spark, sf):
    q = G.yaw_quaternion(F.col("yaw"))
    return X.boxes3d(spark, sf).select(
        "frame_id", "det_id", F.round(F.get(q, F.lit(0)), 9).alias("qw"),
        F.round(F.get(q, F.lit(3)), 9).alias("qz"),
    )


_IOU = (
    "CASE WHEN least(a.x2,b.x2) > greatest(a.x1,b.x1) AND least(a.y2,b.y2) > greatest(a.y1,b.y1) "
    "THEN (least(a.x2,b.x2) - greatest(a.x1,b.x1)) * (least(a.y2,b.y2) - greatest(a.y1,b.y1)) / "
    "((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - (least(a.x2,b.x2) - "
    "greatest(a.x1,b.x1)) * (least(a.y2,b.y2) - greatest(a.y1,b.y1))) ELSE 0 END"
)
_DETS = _PROJECTED + f""", dets AS (SELECT sample_id AS frame_id, label_index AS i, class_id,
    class_name, confidence,
    CAST(greatest(0, least(CAST(trunc(x1 * 640) AS INTEGER), 639)) AS DOUBLE) AS x1,
    CAST(greatest(0, least(CAST(trunc(y1 * 480) AS INTEGER), 479)) AS DOUBLE) AS y1,
    CAST(greatest(0, least(CAST(trunc(x2 * 640) AS INTEGER), 639)) AS DOUBLE) AS x2,
    CAST(greatest(0, least(CAST(trunc(y2 * 480) AS INTEGER), 479)) AS DOUBLE) AS y2 FROM corners),
  cand AS (SELECT a.frame_id, a.i, b.det_id AS j, {_IOU} AS iou FROM dets a JOIN shown b
    ON a.frame_id = b.frame_id WHERE {_IOU} >= 0.3)"""
# Greedy pass as a recursion: one pick per frame and step, the first pair whose ends are free.
_GREEDY = """, ordered AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY iou DESC, i, j)
    AS p FROM cand),
  lists AS (SELECT frame_id, list((i, j) ORDER BY p) AS todo FROM ordered GROUP BY 1),
  picks AS (SELECT frame_id, todo[1][1] AS i, todo[1][2] AS j,
    list_filter(todo, lambda t: t[1] <> todo[1][1] AND t[2] <> todo[1][2]) AS todo FROM lists
    UNION ALL SELECT frame_id, todo[1][1], todo[1][2],
    list_filter(todo, lambda t: t[1] <> todo[1][1] AND t[2] <> todo[1][2]) FROM picks
    WHERE len(todo) > 0),
  matched AS (SELECT p.frame_id, p.i, p.j, iou FROM picks p JOIN cand c ON c.frame_id = p.frame_id
    AND c.i = p.i AND c.j = p.j)"""


def _boxes2d(spark, sf):
    from framewright.functions.boxes import pixel_corners

    px = pixel_corners(
        *(F.col(c) for c in ("cx", "cy", "w", "h")), F.lit(X.CAM_W), F.lit(X.CAM_H)
    )
    return X.annotations(spark, sf).select(
        F.col("sample_id").alias("frame_id"), F.col("label_index").alias("i"), "class_id",
        "class_name", "confidence",
        *[e.cast("double").alias(c) for c, e in zip(("x1", "y1", "x2", "y2"), px)],
    )


def _boxes3d(spark, sf):
    out = G.project_boxes(X.boxes3d(spark, sf), K, X.CAM_W, X.CAM_H)
    return out.select(
        "frame_id", F.col("det_id").alias("j"), "class_id", "class_name", "confidence",
        F.col("z").alias("depth"), "x1", "y1", "x2", "y2",
    )


@query(
    "fusion_candidates",
    sql(
        _DETS + " SELECT frame_id, i, j, round(iou, 6) AS iou FROM cand", "boxes3d", "corners"
    ),
)
def fusion_candidates(spark, sf):
    return fusion.candidates(_boxes2d(spark, sf), _boxes3d(spark, sf)).withColumn(
        "iou", F.round("iou", 6)
    )


@query(
    "fusion_match",
    sql(
        "/*recursive*/" + _DETS + _GREEDY + """ SELECT d.frame_id, d.i, m.j, d.class_name,
        round(m.iou, 6) AS iou, round(b.z, 6) AS depth FROM dets d LEFT JOIN matched m
        ON m.frame_id = d.frame_id AND m.i = d.i LEFT JOIN boxes3d b ON b.frame_id = m.frame_id
        AND b.det_id = m.j
        UNION ALL SELECT s.frame_id, NULL, s.det_id, b.class_name, NULL, round(b.z, 6) FROM shown s
        JOIN boxes3d b USING (frame_id, det_id)
        WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.frame_id = s.frame_id
        AND m.j = s.det_id)""",
        "boxes3d",
        "corners",
    ),
)
def fusion_match(spark, sf):
    fused = fusion.fuse(_boxes2d(spark, sf), _boxes3d(spark, sf))
    return fused.select("frame_id", "i", "j", "class_name", _r("iou"), _r("depth"))


@query(
    "fusion_summary",
    sql(
        "/*recursive*/" + _DETS + _GREEDY + """ SELECT
        (SELECT count(*) FROM dets) + (SELECT count(*) FROM shown) - (SELECT count(*) FROM matched)
          AS total, (SELECT count(*) FROM shown) AS with_3d,
        (SELECT count(*) FROM dets) - (SELECT count(*) FROM matched) AS only_2d""",
        "boxes3d",
        "corners",
    ),
)
def fusion_summary(spark, sf):
    return fusion.fusion_summary(fusion.fuse(_boxes2d(spark, sf), _boxes3d(spark, sf)))


_FRUSTUM = f""", seen AS (SELECT cloud_id, point_idx, x, y / 2 AS y, z, {_U} AS u, {_V} AS v
    FROM points WHERE {_U} >= 0 AND {_U} < 640 AND {_V} >= 0 AND {_V} < 480),
  regions AS (SELECT s_suppkey AS frame_id, n_nationkey AS box_id, n_name AS class_name,
    60.0 + n_nationkey * 9 AS x1, 40.0 + n_nationkey * 5 AS y1, 160.0 + n_nationkey * 18 AS x2,
    140.0 + n_nationkey * 13 AS y2 FROM supplier JOIN nation ON n_regionkey = s_nationkey % 5),
  inside AS (SELECT frame_id, box_id, class_name, point_idx, x, y, z FROM seen JOIN regions
    ON frame_id = cloud_id AND u BETWEEN x1 AND x2 AND v BETWEEN y1 AND y2)"""


def _regions(spark, sf):
    """Image boxes per supplier cloud: the nations of one region."""
    n = F.col("n_nationkey")
    return (
        X.table(spark, sf, "supplier")
        .withColumn("n_regionkey", (F.col("s_nationkey") % 5).cast("int"))
        .join(X.table(spark, sf, "nation"), "n_regionkey")
        .select(
            F.col("s_suppkey").alias("frame_id"), n.alias("box_id"), F.col("n_name").alias("class_name"),
            (F.lit(60.0) + n * 9).alias("x1"), (F.lit(40.0) + n * 5).alias("y1"),
            (F.lit(160.0) + n * 18).alias("x2"), (F.lit(140.0) + n * 13).alias("y2"),
        )
    )


def _inside(spark, sf):
    pts = _projected(spark, sf).withColumnRenamed("cloud_id", "frame_id")
    return fusion.frustum_points(pts, _regions(spark, sf))


@query(
    "frustum_points",
    sql(_FRUSTUM + " SELECT frame_id, box_id, point_idx FROM inside", "points"),
)
def frustum_points(spark, sf):
    return _inside(spark, sf).select("frame_id", "box_id", "point_idx")


@query(
    "lift_box",
    sql(
        _FRUSTUM + """ SELECT frame_id, box_id, class_name, count(*) AS point_count,
        round(median(x), 6) AS x, round(median(y) + 1e-9, 6) AS y, round(median(z), 6) AS z,
        round(greatest(0.5, (max(x) - min(x)) * 1.1), 6) AS l,
        round(greatest(0.5, (max(y) - min(y)) * 1.1) + 1e-9, 6) AS w,
        round(greatest(0.5, (max(z) - min(z)) * 1.1), 6) AS h,
        round(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 4) AS yaw
        FROM inside GROUP BY 1, 2, 3 HAVING count(*) >= 3""".replace("median(x)", "median(inside.x)")
        .replace("median(y)", "median(inside.y)").replace("median(z)", "median(inside.z)"),
        "points",
    ),
)
def lift_box(spark, sf):
    out = fusion.lift_boxes(_inside(spark, sf), _regions(spark, sf)).drop("confidence")
    # The offset keeps exact rounding ties on the same side in both engines.
    out = out.withColumns({c: F.col(c) + 1e-9 for c in ("y", "w")})
    return out.withColumns(
        {**{c: F.round(c, 6) for c in ("x", "y", "z", "l", "w", "h")}, "yaw": F.round("yaw", 4)}
    )


@query(
    "detections_rank",
    sql(
        """SELECT sample_id, label_index, row_number() OVER (PARTITION BY sample_id
        ORDER BY confidence DESC, label_index) AS position FROM annotations""",
        "annotations",
    ),
)
def detections_rank(spark, sf):
    return fusion.rank_detections(X.annotations(spark, sf), ["sample_id"], "label_index").select(
        "sample_id", "label_index", "position"
    )


@query(
    "preview_topk",
    sql(
        """, firsts AS (SELECT DISTINCT sample_id FROM annotations ORDER BY 1 LIMIT 6)
        SELECT sample_id, label_index, position FROM (SELECT *, row_number() OVER (PARTITION BY
        sample_id ORDER BY label_index) AS position FROM annotations
        WHERE sample_id IN (FROM firsts)) WHERE position <= 50""",
        "annotations",
    ),
)
def preview_topk(spark, sf):
    return fusion.preview(X.annotations(spark, sf)).select("sample_id", "label_index", "position")


# ---- time alignment -------------------------------------------------------------------------

_SYNC = """, c AS (SELECT * FROM messages WHERE topic = 'view'),
  im AS (SELECT * FROM messages WHERE topic = 'click'),
  ci AS (SELECT * FROM messages WHERE topic = 'purchase'),
  near AS (SELECT c.ts_us, c.idx AS cloud_idx, arg_min(im.idx, (abs(im.ts_us - c.ts_us), im.idx))
    AS image_idx, min(abs(im.ts_us - c.ts_us)) / 1000.0 AS ie FROM c, im GROUP BY 1, 2),
  info AS (SELECT c.idx AS cloud_idx, arg_min(ci.idx, (abs(ci.ts_us - c.ts_us), ci.idx))
    AS info_idx, min(abs(ci.ts_us - c.ts_us)) / 1000.0 AS ce FROM c, ci GROUP BY 1),
  frames AS (SELECT 'bag' AS bag, ts_us, cloud_idx, image_idx,
    CASE WHEN ce <= 300000 THEN info_idx END AS info_idx, greatest(ie, ce) AS sync_error_ms
    FROM near JOIN info USING (cloud_idx) WHERE ie <= 300000)"""


def _frames(spark, sf):
    return sync.sync_frames(
        X.messages(spark, sf), "view", "click", "purchase", max_error_ms=300000.0
    )


@query(
    "nearest_time_sync",
    sql(
        _SYNC + """ SELECT cloud_idx, image_idx, info_idx, round(sync_error_ms, 3) AS sync_error_ms,
        row_number() OVER (ORDER BY ts_us, cloud_idx) - 1 AS frame_index FROM frames""",
        "messages",
    ),
)
def nearest_time_sync(spark, sf):
    return sync.number_frames(_frames(spark, sf)).select(
        "cloud_idx", "image_idx", "info_idx", _r("sync_error_ms", 3), "frame_index"
    )


@query(
    "sync_error_avg",
    sql(
        _SYNC + """ SELECT bag, round(avg(sync_error_ms), 3) AS avg_sync_error_ms,
        count(*) AS frames FROM frames GROUP BY 1""",
        "messages",
    ),
)
def sync_error_avg(spark, sf):
    return sync.sync_error_avg(_frames(spark, sf)).withColumn(
        "avg_sync_error_ms", F.round("avg_sync_error_ms", 3)
    )


@query(
    "topic_stats",
    sql(
        """, span AS (SELECT min(ts_us) AS s, max(ts_us) AS e FROM messages)
        SELECT bag, topic, count(*) AS message_count, any_value(s) AS start_us,
        any_value(e) AS end_us, any_value(e - s) / 1000000.0 AS duration,
        round(count(*) / (any_value(e - s) / 1000000.0), 9) AS frequency_hz
        FROM messages, span GROUP BY 1, 2""",
        "messages",
    ),
)
def topic_stats(spark, sf):
    return sync.topic_stats(X.messages(spark, sf)).withColumn(
        "frequency_hz", F.round("frequency_hz", 9)
    )


@query(
    "topic_pick",
    sql(
        """SELECT bag, topic, count(*) AS message_count FROM messages WHERE topic IN
        ('click', 'view', 'signup') GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 1""",
        "messages",
    ),
)
def topic_pick(spark, sf):
    return sync.pick_topic(X.messages(spark, sf), ["click", "view", "signup"])
