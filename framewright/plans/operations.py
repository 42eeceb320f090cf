"""Queries over job runs, threads, the review queue, masks and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import boxes as B
from framewright.operators import masks, redact, review, runs
from framewright.plans import fixtures as X
from framewright.plans.fixtures import sql
from framewright.plans.registry import query


def _round(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- runs -----------------------------------------------------------------------------------


@query(
    "quality_metrics",
    sql(
        """SELECT run_id, round(coalesce(avg(confidence), 0), 6) AS average_confidence,
        count(*) FILTER (error) AS error_count, CAST(sum(coalesce(files_processed,
          CASE WHEN error THEN 0 ELSE 1 END)) AS BIGINT) AS total_processed,
        round(sum(coalesce(files_processed, CASE WHEN error THEN 0 ELSE 1 END)) / sum(duration), 6)
          AS processing_speed FROM steps GROUP BY 1""",
        "steps",
    ),
)
def quality_metrics(spark, sf):
    return _round(runs.quality_metrics(X.steps(spark, sf)), 6, "average_confidence", "processing_speed")


@query(
    "run_summary",
    sql(
        """, s AS (SELECT run_id, error, duration, confidence, files_processed,
          CASE tool WHEN 'click' THEN 'detect' WHEN 'view' THEN 'anonymize' WHEN 'signup'
          THEN 'segment' ELSE tool END AS tool FROM steps)
        SELECT run_id, count(*) AS total_steps, count(*) FILTER (NOT error) AS completed_steps,
        count(*) FILTER (error) AS failed_steps,
        round(count(*) FILTER (NOT error) / count(*), 6) AS success_rate,
        round(sum(duration), 4) AS total_duration,
        CAST(coalesce(sum(files_processed) FILTER (NOT error), 0) AS BIGINT) AS files_processed,
        CAST(coalesce(sum(files_processed) FILTER (tool = 'detect'), 0) AS BIGINT)
          AS items_detected,
        CAST(coalesce(sum(files_processed) FILTER (tool = 'anonymize'), 0) AS BIGINT)
          AS items_anonymized,
        CAST(coalesce(sum(files_processed) FILTER (tool = 'segment'), 0) AS BIGINT)
          AS masks_generated, round(avg(confidence), 6) AS average_confidence FROM s GROUP BY 1""",
        "steps",
    ),
)
def run_summary(spark, sf):
    got = runs.run_summary(_tooled(spark, sf))
    return _round(_round(got, 6, "success_rate", "average_confidence"), 4, "total_duration")


def _tooled(spark, sf):
    tool = F.col("tool")
    named = (
        F.when(tool == "click", "detect").when(tool == "view", "anonymize")
        .when(tool == "signup", "segment").otherwise(tool)
    )
    return X.steps(spark, sf).withColumn("tool", named)


_HISTORY = """, history AS (SELECT *, row_number() OVER r AS step, count(*) OVER (PARTITION BY run_id)
    AS total_steps, avg(error::INT) OVER last5 AS recent_error_rate,
    avg(confidence) OVER last5 AS recent_confidence, avg(confidence) OVER r AS overall_confidence
    FROM steps WINDOW r AS (PARTITION BY run_id ORDER BY step_key),
    last5 AS (PARTITION BY run_id ORDER BY step_key ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


@query(
    "recent_error_rate",
    sql(
        _HISTORY + """ SELECT run_id, step, round(recent_error_rate, 6) AS recent_error_rate,
        recent_error_rate > 0.05 AS triggered FROM history""",
        "steps",
    ),
)
def recent_error_rate(spark, sf):
    got = runs.with_history(X.steps(spark, sf))
    return got.select(
        "run_id", "step", F.round("recent_error_rate", 6).alias("recent_error_rate"),
        (F.col("recent_error_rate") > runs.ERROR_RATE).alias("triggered"),
    )


@query(
    "confidence_drop",
    sql(
        _HISTORY + """ SELECT run_id, step,
        round(overall_confidence + 1e-9, 6) AS overall_confidence,
        round(recent_confidence + 1e-9, 6) AS recent_confidence FROM history
        WHERE overall_confidence - recent_confidence > 0.15""",
        "steps",
    ),
)
def confidence_drop(spark, sf):
    got = runs.with_history(X.steps(spark, sf), chunk=16)
    drop = F.col("overall_confidence") - F.col("recent_confidence")
    got = got.where(drop > runs.CONFIDENCE_DROP)
    # The offset keeps exact rounding ties on the same side in both engines.
    got = got.withColumns({c: F.col(c) + 1e-9 for c in ("overall_confidence", "recent_confidence")})
    return _round(
        got.select("run_id", "step", "overall_confidence", "recent_confidence"), 6,
        "overall_confidence", "recent_confidence",
    )


@query(
    "milestone_cross",
    sql(
        _HISTORY + """ SELECT run_id, step, total_steps FROM history WHERE
        ((step - 1) / total_steps < 0.1 AND step / total_steps >= 0.1) OR
        ((step - 1) / total_steps < 0.25 AND step / total_steps >= 0.25) OR
        ((step - 1) / total_steps < 0.5 AND step / total_steps >= 0.5)""",
        "steps",
    ),
)
def milestone_cross(spark, sf):
    got = runs.with_history(X.steps(spark, sf))
    return got.where(runs.crosses_milestone(F.col("step"), F.col("total_steps"))).select(
        "run_id", "step", "total_steps"
    )


@query(
    "trigger_priority",
    sql(
        _HISTORY + """, cp AS (SELECT run_id, step FROM history WHERE tool = 'purchase'),
        marked AS (SELECT h.*, d.step IS NOT NULL AS done, b.step IS NOT NULL AS before
          FROM history h LEFT JOIN cp d ON d.run_id = h.run_id AND d.step = h.step
          LEFT JOIN cp b ON b.run_id = h.run_id AND b.step + 1 = h.step)
        SELECT run_id, step, CASE WHEN done THEN NULL WHEN tool = 'signup' THEN 'critical_step'
        WHEN recent_error_rate > 0.05 THEN 'error_rate'
        WHEN overall_confidence - recent_confidence > 0.15 THEN 'quality_drop'
        WHEN list_bool_or([(step - 1) / total_steps < 0.1 AND step / total_steps >= 0.1 AND NOT
            (before AND floor(total_steps * 0.1::DOUBLE) = step - 1),
          (step - 1) / total_steps < 0.25 AND step / total_steps >= 0.25 AND NOT
            (before AND floor(total_steps * 0.25::DOUBLE) = step - 1),
          (step - 1) / total_steps < 0.5 AND step / total_steps >= 0.5 AND NOT
            (before AND floor(total_steps * 0.5::DOUBLE) = step - 1)]) THEN 'percentage'
        END AS "trigger" FROM marked""",
        "steps",
    ),
)
def trigger_priority(spark, sf):
    history = runs.with_history(X.steps(spark, sf))
    taken = history.where(F.col("tool") == "purchase").select("run_id", "step")
    return runs.triggers(history, taken, critical=("signup",)).select("run_id", "step", "trigger")


@query(
    "thread_progress",
    sql(
        """SELECT run_id, count(*) AS total_steps, count(*) FILTER (NOT error) AS completed_steps,
        count(*) FILTER (error) AS failed_steps,
        round(count(*) FILTER (NOT error) / count(*) * 100, 6) AS progress_percent
        FROM steps GROUP BY 1""",
        "steps",
    ),
)
def thread_progress(spark, sf):
    return _round(runs.thread_progress(X.steps(spark, sf)), 6, "progress_percent")


@query(
    "latest_snapshot",
    sql(
        """SELECT thread_id, snapshot_id, created_at, step_index FROM (SELECT *, row_number() OVER
        (PARTITION BY thread_id ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM snapshots)
        WHERE rn = 1""",
        "snapshots",
    ),
)
def latest_snapshot(spark, sf):
    return runs.latest_snapshot(X.snapshots(spark, sf))


@query(
    "thread_stats",
    sql(
        """SELECT count(*) AS total_threads, count(*) FILTER (status = 'active') AS active_threads,
        count(*) FILTER (status = 'completed') AS completed_threads,
        count(*) FILTER (status = 'cancelled') AS cancelled_threads,
        (SELECT count(*) FROM snapshots) AS total_snapshots FROM threads""",
        "threads",
        "snapshots",
    ),
)
def thread_stats(spark, sf):
    return runs.thread_stats(X.threads(spark, sf), X.snapshots(spark, sf))


@query(
    "threads_list",
    sql(
        """SELECT thread_id, status, title, updated_at FROM threads WHERE status = 'active'
        ORDER BY updated_at DESC, thread_id LIMIT 50""",
        "threads",
    ),
)
def threads_list(spark, sf):
    return runs.list_threads(X.threads(spark, sf), "active", 50)


@query(
    "resume_status",
    sql(
        """, per AS (SELECT run_id, count(*) AS total, count(*) FILTER (NOT error) AS done,
          count(*) FILTER (error) AS failed FROM steps GROUP BY 1)
        SELECT thread_id, CASE WHEN status = 'awaiting_review' THEN 'awaiting review'
        WHEN coalesce(failed, 0) > 15 THEN 'failed' WHEN coalesce(total, 0) > 0 AND done >= total
        THEN 'completed' WHEN coalesce(total, 0) > 0 THEN 'in progress' ELSE 'ready' END AS resume
        FROM threads LEFT JOIN per ON run_id = thread_id""",
        "threads",
        "steps",
    ),
)
def resume_status(spark, sf):
    per = runs.thread_progress(X.steps(spark, sf)).withColumnRenamed("run_id", "thread_id")
    rows = X.threads(spark, sf).join(per, "thread_id", "left").na.fill(0)
    kind = runs.resume_status(
        F.col("status") == "awaiting_review", F.col("failed_steps") - 15, F.col("completed_steps"),
        F.col("total_steps"),
    )
    return rows.select("thread_id", kind.alias("resume"))


@query(
    "retention",
    sql(
        """, gone AS (SELECT thread_id FROM threads WHERE status IN ('completed', 'cancelled')
          AND updated_at < TIMESTAMP '1997-06-01')
        SELECT t.thread_id, count(s.thread_id) AS snapshots FROM threads t LEFT JOIN snapshots s
        USING (thread_id) WHERE t.thread_id NOT IN (FROM gone) GROUP BY 1""",
        "threads",
        "snapshots",
    ),
)
def retention(spark, sf):
    cutoff = F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")
    kept, snaps = runs.retention(X.threads(spark, sf), cutoff, X.snapshots(spark, sf))
    n = snaps.groupBy("thread_id").agg(F.count(F.lit(1)).alias("snapshots"))
    return kept.select("thread_id").join(n, "thread_id", "left").na.fill(0, ["snapshots"])


@query(
    "prev_next_chain",
    sql(
        """SELECT sensor, idx, coalesce(CAST(lag(idx) OVER w AS VARCHAR), '') AS prev,
        coalesce(CAST(lead(idx) OVER w AS VARCHAR), '') AS next FROM messages
        WINDOW w AS (PARTITION BY sensor ORDER BY ts_us, idx)""",
        "messages",
    ),
)
def prev_next_chain(spark, sf):
    msgs = X.messages(spark, sf).withColumn("token", F.col("idx").cast("string"))
    hour = F.floor(F.col("ts_us") / 3_600_000_000)
    got = runs.chain(msgs, ["sensor"], [F.col("ts_us"), F.col("idx")], hour, "token")
    return got.select("sensor", "idx", "prev", "next")


# ---- review ---------------------------------------------------------------------------------


def _item_annotations(spark, sf):
    return X.annotations(spark, sf).withColumnRenamed("sample_id", "item_id")


@query(
    "review_page",
    sql(
        """SELECT item_id, status, file_path FROM review_items WHERE status = 'pending'
        AND project_id = '2-HIGH' ORDER BY item_id LIMIT 50 OFFSET 100""",
        "review_items",
    ),
)
def review_page(spark, sf):
    got = review.page(
        X.review_items(spark, sf), project_id="2-HIGH", status="pending", skip=100, limit=50
    )
    return got.select("item_id", "status", "file_path")


@query(
    "review_filter",
    sql(
        """, top AS (SELECT sample_id, max(confidence) AS m, bool_or(class_name = 'AF') AS has
          FROM annotations GROUP BY 1)
        SELECT item_id, status FROM review_items LEFT JOIN top ON sample_id = item_id
        WHERE status = 'approved' AND has AND contains(lower('img_' || item_id || '.jpg'), 'g_1')
        AND (m IS NULL OR m BETWEEN 0.7 AND 0.95)""",
        "review_items",
        "annotations",
    ),
)
def review_filter(spark, sf):
    got = review.filter_items(
        X.review_items(spark, sf), _item_annotations(spark, sf), "approved", "AF", "G_1", 0.7, 0.95
    )
    return got.select("item_id", "status")


@query(
    "review_apply_edits",
    sql(
        """, latest AS (SELECT item_id, arg_max(CASE WHEN annotations_edited THEN 'modified'
            ELSE status END, (ts, edit_id)) AS st, max(ts) FILTER (status IS NOT NULL)
            AS reviewed_at, count(*) AS n FROM review_edits
            WHERE annotations_edited OR status IS NOT NULL GROUP BY 1)
        SELECT i.item_id, coalesce(st, status) AS status, reviewed_at,
        coalesce(n, 0) AS edit_count FROM review_items i LEFT JOIN latest USING (item_id)""",
        "review_items",
        "review_edits",
    ),
)
def review_apply_edits(spark, sf):
    got = review.apply_edits(X.review_items(spark, sf), X.review_edits(spark, sf))
    return got.select("item_id", "status", "reviewed_at", "edit_count")


@query(
    "review_batch",
    sql(
        """SELECT DISTINCT p_partkey AS item_id, CASE WHEN item_id IS NULL THEN 'not_found'
        ELSE 'approved' END AS result FROM (SELECT p_partkey * 10 AS p_partkey FROM part) p
        LEFT JOIN review_items ON item_id = p_partkey""",
        "review_items",
    ),
)
def review_batch(spark, sf):
    ids = X.table(spark, sf, "part").select((F.col("p_partkey") * 10).alias("item_id"))
    return review.batch_status(X.review_items(spark, sf), ids, "approved")


@query(
    "review_counts",
    sql(
        """SELECT project_id, count(*) FILTER (status = 'pending') AS pending,
        count(*) FILTER (status = 'approved') AS approved,
        count(*) FILTER (status = 'rejected') AS rejected FROM review_items GROUP BY 1""",
        "review_items",
    ),
)
def review_counts(spark, sf):
    return review.review_counts(X.review_items(spark, sf), "project_id")


# Label files: open orders keep the image's name, filled ones carry a number prefix.
_FILES = """, files AS (SELECT '/labels/img_' || o_orderkey || '.txt' AS path FROM orders
    WHERE o_orderstatus = 'O' UNION ALL SELECT '/labels/' || lpad(CAST(o_custkey AS VARCHAR), 5, '0')
    || '_img_' || o_orderkey || '.txt' FROM orders WHERE o_orderstatus IN ('F', 'O')),
  stems AS (SELECT path, regexp_extract(path, '([^/]+)\\.txt$', 1) AS stem FROM files),
  matched AS (SELECT s.sample_id, coalesce(
    (SELECT min(path) FROM stems WHERE stem = 'img_' || s.sample_id), l.path) AS annotation_path
    FROM samples s LEFT JOIN (SELECT regexp_replace(stem, '^[0-9]+_(.)', '\\1') AS st,
    min(path) AS path FROM stems GROUP BY 1) l ON l.st = 'img_' || s.sample_id)"""


def _label_files(spark, sf):
    o = X.table(spark, sf, "orders")
    stem = F.concat(F.lit("img_"), F.col("o_orderkey"), F.lit(".txt"))
    plain = o.where("o_orderstatus = 'O'").select(F.concat(F.lit("/labels/"), stem).alias("path"))
    number = F.lpad(F.col("o_custkey").cast("string"), 5, "0")
    numbered = o.where("o_orderstatus IN ('F', 'O')").select(
        F.concat(F.lit("/labels/"), number, F.lit("_"), stem).alias("path")
    )
    return plain.union(numbered)


@query(
    "annotation_to_image",
    sql(_FILES + " SELECT sample_id, annotation_path FROM matched", "samples"),
)
def annotation_to_image(spark, sf):
    return review.match_annotation_files(X.samples(spark, sf), _label_files(spark, sf)).select(
        "sample_id", "annotation_path"
    )


@query(
    "review_build",
    sql(
        _FILES + """ SELECT m.sample_id AS item_id, 'pending' AS status, m.annotation_path,
        count(a.sample_id) AS annotations FROM matched m LEFT JOIN annotations a
        ON a.sample_id = m.sample_id AND m.annotation_path IS NOT NULL GROUP BY 1, 2, 3""",
        "samples",
        "annotations",
    ),
)
def review_build(spark, sf):
    files = _label_files(spark, sf)
    images = X.samples(spark, sf)
    parsed = X.annotations(spark, sf).join(
        review.match_annotation_files(images, files).select("sample_id", "annotation_path"), "sample_id"
    )
    items, notes = review.build_queue(images, files, parsed, 1, "p")
    n = notes.groupBy("item_id").agg(F.count(F.lit(1)).alias("annotations"))
    return (
        items.select("item_id", "status", "annotation_path")
        .join(n, "item_id", "left").na.fill(0, ["annotations"])
    )


@query(
    "review_import_match",
    sql(
        """, imgs AS (SELECT sample_id, CASE WHEN split = 'train' THEN image_path ELSE
            '/moved/' || 'img_' || sample_id // 2 || '.jpg' END AS image_path FROM samples),
        items AS (SELECT item_id, file_path, regexp_extract(file_path, '([^/]+)$', 1) AS name
          FROM review_items),
        lone AS (SELECT name, min(item_id) AS item_id FROM items GROUP BY 1 HAVING count(*) = 1)
        SELECT sample_id, coalesce(i.item_id, l.item_id) AS item_id FROM imgs
        LEFT JOIN items i ON i.file_path = image_path
        LEFT JOIN lone l ON l.name = regexp_extract(image_path, '([^/]+)$', 1)""",
        "samples",
        "review_items",
    ),
)
def review_import_match(spark, sf):
    moved = F.concat(F.lit("/moved/img_"), F.floor(F.col("sample_id") / 2), F.lit(".jpg"))
    images = X.samples(spark, sf).select(
        "sample_id",
        F.when(F.col("split") == "train", F.col("image_path")).otherwise(moved).alias("image_path"),
    )
    return review.match_items(images, X.review_items(spark, sf)).select("sample_id", "item_id")


@query(
    "detection_summary",
    sql(
        """SELECT class_name, count(*) AS count, count(DISTINCT sample_id) AS files,
        round(avg(confidence), 3) AS average_confidence FROM annotations GROUP BY 1""",
        "annotations",
    ),
)
def detection_summary(spark, sf):
    return review.detection_summary(X.annotations(spark, sf), X.samples(spark, sf))


@query(
    "faces_per_image",
    sql(
        """SELECT s.sample_id, count(a.sample_id) AS faces FROM samples s LEFT JOIN annotations a
        ON a.sample_id = s.sample_id AND class_name = 'AF' GROUP BY 1""",
        "samples",
        "annotations",
    ),
)
def faces_per_image(spark, sf):
    faces = X.annotations(spark, sf).where(F.col("class_name") == "AF")
    return review.per_image_counts(faces, X.samples(spark, sf), "faces")


@query(
    "center_to_topleft",
    sql(
        """SELECT sample_id, label_index, round(greatest(0, x1), 6) AS x, round(greatest(0, y1), 6)
        AS y, round(greatest(0, least(w, 1 - greatest(0, x1))), 6) AS width,
        round(greatest(0, least(h, 1 - greatest(0, y1))), 6) AS height FROM corners""",
        "corners",
    ),
)
def center_to_topleft(spark, sf):
    from framewright.sources.yolo import top_left_box

    box = top_left_box(*(F.col(c) for c in ("cx", "cy", "w", "h")))
    names = ("x", "y", "width", "height")
    return X.annotations(spark, sf).select(
        "sample_id", "label_index", *[F.round(e, 6).alias(n) for n, e in zip(names, box)]
    )


# ---- masks ----------------------------------------------------------------------------------

_PIXELS = """, pixels AS (SELECT id, unnest(generate_series(0, 63)) AS p,
    unnest(list_transform(vector, lambda v: (v > 0.05)::INT)) AS on_ FROM vectors),
  runs AS (SELECT id, on_, min(p) AS a, count(*) AS len FROM (SELECT *, p - row_number() OVER
    (PARTITION BY id, on_ ORDER BY p) AS grp FROM pixels) GROUP BY id, on_, grp)"""


def _masks(spark, sf):
    pixels = F.transform("vector", lambda v: (v > F.lit(0.05).cast("double")).cast("int"))
    return X.vectors(spark, sf).select(
        F.col("id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        B.run_lengths(pixels).alias("runs"),
    )


@query(
    "rle_encode",
    sql(
        _PIXELS + """ SELECT id AS image_id, CASE WHEN arg_min(on_, a) = 1 THEN '0,' ELSE '' END ||
        string_agg(len, ',' ORDER BY a) AS runs FROM runs GROUP BY 1""",
        "vectors",
    ),
)
def rle_encode(spark, sf):
    return _masks(spark, sf).select("image_id", F.array_join("runs", ",").alias("runs"))


@query(
    "rle_area",
    sql(_PIXELS + " SELECT id AS image_id, CAST(sum(on_) AS BIGINT) AS area FROM pixels GROUP BY 1", "vectors"),
)
def rle_area(spark, sf):
    return _masks(spark, sf).select("image_id", B.run_area(F.col("runs")).alias("area"))


@query(
    "mask_bbox",
    sql(
        _PIXELS + """ SELECT id AS image_id, min(p // 8) / 8 AS x1, min(p % 8) / 8 AS y1,
        (max(p // 8) + 1) / 8 AS x2, (max(p % 8) + 1) / 8 AS y2 FROM pixels WHERE on_ = 1
        GROUP BY 1""",
        "vectors",
    ),
)
def mask_bbox(spark, sf):
    return masks.mask_box(_masks(spark, sf)).where("x1 IS NOT NULL").select(
        "image_id", "x1", "y1", "x2", "y2"
    )


@query(
    "mask_summary",
    sql(
        _PIXELS + """ SELECT e.label AS image_id, count(DISTINCT p.id) AS masks,
        CAST(sum(on_) AS BIGINT) AS pixel_area, count(*) AS frame_area
        FROM pixels p JOIN embeddings e ON e.vec_id = p.id GROUP BY 1""",
        "vectors",
    ),
)
def mask_summary(spark, sf):
    groups = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    grouped = _masks(spark, sf).join(groups, "image_id").drop("image_id")
    return masks.mask_summary(grouped.withColumnRenamed("label", "image_id"))


# ---- redaction ------------------------------------------------------------------------------

_PLAN = """, px AS (SELECT a.sample_id, label_index, class_name, image_width AS w_, image_height AS h_,
    greatest(0, least(CAST(trunc(x1 * image_width) AS INTEGER), image_width - 1)) AS x1,
    greatest(0, least(CAST(trunc(y1 * image_height) AS INTEGER), image_height - 1)) AS y1,
    greatest(0, least(CAST(trunc(x2 * image_width) AS INTEGER), image_width - 1)) AS x2,
    greatest(0, least(CAST(trunc(y2 * image_height) AS INTEGER), image_height - 1)) AS y2
    FROM corners a JOIN samples s ON a.sample_id = s.sample_id WHERE class_name IN ('AF', 'RO')
    AND confidence >= CASE class_name WHEN 'AF' THEN 0.8 ELSE 0.7 END),
  grown AS (SELECT sample_id, label_index, CASE class_name WHEN 'AF' THEN 'face' ELSE 'plate' END
    AS kind, greatest(0, x1 - CAST(trunc((x2 - x1) * 0.1::DOUBLE) AS INTEGER)) AS x1,
    greatest(0, y1 - CAST(trunc((y2 - y1) * 0.1::DOUBLE) AS INTEGER)) AS y1,
    least(w_, x2 + CAST(trunc((x2 - x1) * 0.1::DOUBLE) AS INTEGER)) AS x2,
    least(h_, y2 + CAST(trunc((y2 - y1) * 0.1::DOUBLE) AS INTEGER)) AS y2 FROM px),
  plan AS (SELECT * FROM grown WHERE x2 > x1 AND y2 > y1)"""


def _plan(spark, sf):
    kind = F.when(F.col("class_name") == "AF", "face").when(F.col("class_name") == "RO", "plate")
    dets = X.annotations(spark, sf).withColumn("kind", kind).join(
        X.samples(spark, sf).select("sample_id", "image_width", "image_height"), "sample_id"
    )
    return redact.redaction_plan(dets, face_conf=0.8, plate_conf=0.7, expansion=0.1)


@query("redaction_plan", sql(_PLAN + " SELECT * FROM plan", "samples", "corners"))
def redaction_plan(spark, sf):
    return _plan(spark, sf).select("sample_id", "label_index", "kind", "x1", "y1", "x2", "y2")


@query(
    "anonymize_summary",
    sql(
        _PLAN + """ SELECT kind, count(*) AS regions, count(DISTINCT sample_id) AS files,
        CAST(sum((x2 - x1) * (y2 - y1)) AS BIGINT) AS pixels FROM plan GROUP BY 1""",
        "samples",
        "corners",
    ),
)
def anonymize_summary(spark, sf):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return _plan(spark, sf).groupBy("kind").agg(
        F.count(F.lit(1)).alias("regions"), F.countDistinct("sample_id").alias("files"),
        F.sum(area).alias("pixels"),
    )


_VIEWS = """, st AS (SELECT cloud_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my,
    (min(z) + max(z)) / 2 AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS size
    FROM points GROUP BY 1),
  eye AS (SELECT *, mx + size * 1.5 * cos(2 * pi() * view / 8) AS ex,
    my + size * 1.5 * sin(2 * pi() * view / 8) AS ey, mz + size * 0.3 * (view % 2 - 0.5) AS ez
    FROM st, (SELECT unnest(generate_series(0, 7)) AS view)),
  fwd AS (SELECT *, sqrt(pow(mx - ex, 2) + pow(my - ey, 2) + pow(mz - ez, 2)) AS len FROM eye),
  dir AS (SELECT *, (mx - ex) / len AS fx, (my - ey) / len AS fy, (mz - ez) / len AS fz FROM fwd),
  cams AS (SELECT *, fy / sqrt(fx * fx + fy * fy) AS rx, -fx / sqrt(fx * fx + fy * fy) AS ry
    FROM dir),
  local AS (SELECT p.cloud_id, point_idx, view, (x - ex) * rx + (y - ey) * ry AS a,
    (x - ex) * (ry * fz) + (y - ey) * (-rx * fz) + (z - ez) * (rx * fy - ry * fx) AS b,
    (x - ex) * fx + (y - ey) * fy + (z - ez) * fz AS depth
    FROM points p JOIN cams c ON c.cloud_id = p.cloud_id),
  viewed AS (SELECT *, 640 * a / depth + 320 AS u, 640 * -b / depth + 240 AS v FROM local
    WHERE depth > 0),
  shown AS (SELECT * FROM viewed WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480)"""


def _viewed(spark, sf):
    pts = X.points(spark, sf)
    return redact.view_points(pts, redact.virtual_cameras(X.raw_points(spark, sf)))


@query(
    "virtual_cameras",
    sql(
        _VIEWS + """ SELECT cloud_id, view, round(ex, 6) AS ex, round(ey, 6) AS ey,
        round(ez, 6) AS ez, round(rx, 6) AS rx, round(ry, 6) AS ry, round(ry * fz, 6) AS ux,
        round(-rx * fz, 6) AS uy, round(rx * fy - ry * fx, 6) AS uz, round(-fx, 6) AS bx,
        round(-fy, 6) AS by, round(-fz, 6) AS bz FROM cams""",
        "points",
    ),
)
def virtual_cameras(spark, sf):
    cams = redact.virtual_cameras(X.raw_points(spark, sf)).drop("width", "height", "rz")
    return _round(cams, 6, *[c for c in cams.columns if c not in ("cloud_id", "view")])


@query(
    "view_projection",
    sql(
        _VIEWS + """ SELECT cloud_id, view, count(*) AS visible, round(avg(u), 4) AS mean_u,
        round(avg(v), 4) AS mean_v, round(min(depth), 6) AS near FROM shown GROUP BY 1, 2""",
        "points",
    ),
)
def view_projection(spark, sf):
    return _viewed(spark, sf).where("valid").groupBy("cloud_id", "view").agg(
        F.count(F.lit(1)).alias("visible"), F.round(F.avg("u"), 4).alias("mean_u"),
        F.round(F.avg("v"), 4).alias("mean_v"), F.round(F.min("depth"), 6).alias("near"),
    )


@query(
    "depth_raster",
    sql(
        _VIEWS + """, base AS (SELECT cloud_id, view, trunc(u)::INT AS pu, trunc(v)::INT AS pv, max(1.0 / greatest(depth, 0.01)) AS inv
        FROM shown GROUP BY 1, 2, 3, 4),
      tops AS (SELECT cloud_id, view, max(inv) AS top FROM base GROUP BY 1, 2),
      lit AS (SELECT cloud_id, view, greatest(0, least(pu + dx, 639)) AS x, greatest(0, least(pv + dy, 479)) AS y, max(inv) AS inv
        FROM base, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) GROUP BY 1, 2, 3, 4)
      SELECT cloud_id, view, count(*) AS lit_pixels, sum(floor(inv / top * 255)::BIGINT)::BIGINT AS gray_sum, max(floor(inv / top * 255)::INT) AS brightest
      FROM lit JOIN tops USING (cloud_id, view) GROUP BY 1, 2""",
        "points",
    ),
)
def depth_raster(spark, sf):
    raster = redact.depth_raster(_viewed(spark, sf), point_radius=2)
    return raster.groupBy("cloud_id", "view").agg(
        F.count(F.lit(1)).alias("lit_pixels"), F.sum("gray").alias("gray_sum"),
        F.max("gray").alias("brightest"),
    )


_FACES = _VIEWS + """, faces AS (SELECT s_suppkey AS cloud_id, v AS view, v AS box_id, 300.0 AS x1,
    180.0 AS y1, 360.0 AS x2, 260.0 AS y2 FROM supplier, (SELECT unnest([0, 3]) AS v)
    WHERE s_acctbal > 0),
  hit AS (SELECT DISTINCT s.cloud_id, point_idx FROM shown s JOIN faces f ON f.cloud_id = s.cloud_id
    AND f.view = s.view AND u BETWEEN 330 - 36 AND 330 + 36 AND v BETWEEN 220 - 48 AND 220 + 48)"""


def _faces(spark, sf):
    view = F.explode(F.array(F.lit(0), F.lit(3)))
    return (
        X.table(spark, sf, "supplier").where("s_acctbal > 0")
        .select(F.col("s_suppkey").alias("cloud_id"), view.alias("view"))
        .select(
            "cloud_id", "view", F.col("view").alias("box_id"), F.lit(300.0).alias("x1"),
            F.lit(180.0).alias("y1"), F.lit(360.0).alias("x2"), F.lit(260.0).alias("y2"),
        )
    )


def _hits(spark, sf, faces):
    return redact.face_hits(X.points(spark, sf), redact.virtual_cameras(X.raw_points(spark, sf)), faces)


@query(
    "redact_points",
    sql(
        _FACES + """ SELECT cloud_id, point_idx FROM points EXCEPT SELECT cloud_id, point_idx
        FROM hit""",
        "points",
    ),
)
def redact_points(spark, sf):
    hit = _hits(spark, sf, _faces(spark, sf))
    return redact.redact_points(X.points(spark, sf), hit).select("cloud_id", "point_idx")


@query(
    "redact_points_noise",
    sql(
        _FACES + """ SELECT p.cloud_id, count(*) AS points, count(h.point_idx) AS noised FROM points p
        LEFT JOIN hit h ON h.cloud_id = p.cloud_id AND h.point_idx = p.point_idx GROUP BY 1""",
        "points",
    ),
)
def redact_points_noise(spark, sf):
    hit = _hits(spark, sf, _faces(spark, sf))
    out = redact.redact_points(X.points(spark, sf), hit, mode="noise", sigma=0.1, seed=3)
    return out.groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_if("noised").alias("noised")
    )


@query(
    "redact_summary",
    sql(
        _FACES + """ SELECT p.cloud_id, count(*) AS original_points,
        (SELECT count(*) FROM hit h WHERE h.cloud_id = p.cloud_id) AS points_removed,
        (SELECT count(*) FROM faces f WHERE f.cloud_id = p.cloud_id) AS face_regions,
        count(*) - (SELECT count(*) FROM hit h WHERE h.cloud_id = p.cloud_id) AS remaining_points
        FROM points p GROUP BY 1""",
        "points",
    ),
)
def redact_summary(spark, sf):
    faces = _faces(spark, sf)
    hit = _hits(spark, sf, faces)
    return redact.redact_summary(X.raw_points(spark, sf), hit, faces)
