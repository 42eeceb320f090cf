"""Streaming queries: each reads its table as a stream to the end and returns what the sink got."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.plans import fixtures as X
from framewright.plans.fixtures import sql
from framewright.plans.labels import _PAIRS
from framewright.plans.registry import query
from framewright.session import scratch_path
from framewright.streaming import jobs


def _events(spark, sf):
    us = X.micros(F.col("ts"))
    return jobs.file_stream(spark, sf, "events.parquet").select(
        "event_id", F.col("user_id").alias("thread_id"), F.timestamp_micros(us).alias("ts"), us.alias("ts_us"),
        F.col("event_type").alias("type"), "value",
    )


def _out(spark, stream, label):
    return jobs.run_available(stream, scratch_path(spark, label))


# Rows leave a window when its end is not after the latest event, cut to milliseconds, less ten
# minutes.
_MARK = """, mark AS (SELECT max(ts_us) // 1000 * 1000 - 600000000 AS w FROM messages)"""


@query(
    "stream_progress_latest",
    sql(
        _MARK + """, win AS (SELECT sensor, ts_us // 14400000000 AS k, arg_max(idx, ts_us) AS event_id
          FROM messages WHERE topic = 'view' GROUP BY 1, 2)
        SELECT user_id AS thread_id, event_type AS type, event_id, value FROM events
        WHERE event_type <> 'view' UNION ALL
        SELECT user_id, event_type, e.event_id, value FROM events e JOIN win USING (event_id), mark
        WHERE (k + 1) * 14400000000 <= w""",
        "messages",
    ),
)
def stream_progress_latest(spark, sf):
    return _out(spark, jobs.progress_latest(_events(spark, sf), "view", "4 hours"), "progress")


@query(
    "stream_topic_rate",
    sql(
        _MARK + """, slid AS (SELECT topic, (ts_us // 1800000000 - o) * 1800000000 AS start_us
          FROM messages, (SELECT unnest([0, 1, 2, 3]) AS o))
        SELECT topic, start_us, count(*) AS message_count, round(count(*) / 7200, 9) AS frequency_hz
        FROM slid, mark WHERE start_us + 7200000000 <= w GROUP BY 1, 2""",
        "messages",
    ),
)
def stream_topic_rate(spark, sf):
    msgs = _events(spark, sf).withColumnRenamed("type", "topic")
    return _out(spark, jobs.topic_rate(msgs, "2 hours", "30 minutes"), "rate").withColumn(
        "frequency_hz", F.round("frequency_hz", 9)
    )


@query(
    "stream_session_expiry",
    sql(
        _MARK + """, cut AS (SELECT *, ts_us - lag(ts_us) OVER w >= 43200000000 AS fresh FROM messages
          WINDOW w AS (PARTITION BY sensor ORDER BY ts_us)),
        grp AS (SELECT *, sum(coalesce(fresh, true)::INT) OVER (PARTITION BY sensor ORDER BY ts_us)
          AS g FROM cut)
        SELECT sensor AS thread_id, min(ts_us) AS start_us, max(ts_us) AS last_us,
        count(*) AS events FROM grp, mark GROUP BY sensor, g
        HAVING max(ts_us) + 43200000000 <= any_value(w)""",
        "messages",
    ),
)
def stream_session_expiry(spark, sf):
    return _out(spark, jobs.session_expiry(_events(spark, sf), "12 hours"), "session")


_DAY = 86_400_000


@query(
    "stream_rate_limit",
    sql(
        """/*recursive*/, pick AS (SELECT sensor, topic, min(ts_us) AS ts_us FROM messages
          GROUP BY 1, 2 UNION ALL SELECT p.sensor, p.topic, (SELECT min(m.ts_us) FROM messages m
          WHERE m.sensor = p.sensor AND m.topic = p.topic AND m.ts_us >= p.ts_us +
          CASE p.topic WHEN 'view' THEN 172800000000 ELSE 86400000000 END) FROM pick p
          WHERE p.ts_us IS NOT NULL)
        SELECT m.sensor AS thread_id, m.topic AS type, m.idx AS event_id, m.ts_us FROM messages m
        JOIN pick p ON p.sensor = m.sensor AND p.topic = m.topic AND p.ts_us = m.ts_us""",
        "messages",
    ),
)
def stream_rate_limit(spark, sf):
    return _out(spark, jobs.rate_limit(_events(spark, sf), {"view": 2 * _DAY}, _DAY), "limit")


@query(
    "stream_quality",
    sql(
        """SELECT run_id, step_key, round(avg(error::INT) OVER last5, 6) AS recent_error_rate,
        round(avg(confidence) OVER last5 + 1e-9, 6) AS recent_confidence,
        round(avg(confidence) OVER r + 1e-9, 6) AS overall_confidence FROM steps
        WINDOW r AS (PARTITION BY run_id ORDER BY step_key),
        last5 AS (PARTITION BY run_id ORDER BY step_key ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
        "steps",
    ),
)
def stream_quality(spark, sf):
    failed = F.col("type") == "error"
    steps = _events(spark, sf).select(
        F.col("thread_id").alias("run_id"), F.col("event_id").alias("step_key"), failed.alias("error"),
        F.when(~failed, F.least(F.lit(1.0), F.col("value") / 100)).alias("confidence"),
    )
    out = _out(spark, jobs.quality(steps), "quality")
    return out.withColumns(
        {
            "recent_error_rate": F.round("recent_error_rate", 6),
            # The offset keeps exact rounding ties on the same side in both engines.
            **{c: F.round(F.col(c) + 1e-9, 6) for c in ("recent_confidence", "overall_confidence")},
        }
    )


@query(
    "stream_sync",
    sql(
        """, mark AS (SELECT least(max(ts_us) FILTER (topic = 'view'), max(ts_us) FILTER (topic = 'click')) // 1000 * 1000 - 600000000 AS w
          FROM messages)
        SELECT c.idx AS cloud_idx, arg_min(i.idx, (abs(i.ts_us - c.ts_us), i.idx)) AS image_idx, min(abs(i.ts_us - c.ts_us)) / 1000.0 AS error_ms
        FROM messages c JOIN messages i ON c.topic = 'view' AND i.topic = 'click' AND abs(i.ts_us - c.ts_us) <= 300000000, mark
        WHERE (c.ts_us // 600000000 + 1) * 600000000 <= w GROUP BY c.idx""",
        "messages",
    ),
)
def stream_sync(spark, sf):
    clouds = _events(spark, sf).where("type = 'view'").withColumnRenamed("event_id", "idx")
    images = _events(spark, sf).where("type = 'click'").withColumnRenamed("event_id", "idx")
    return _out(spark, jobs.sync(clouds, images, 300_000_000), "sync")


def _in_parts(spark, sf, n=6, rows=500_000):
    """The line items as files of a growing folder, dealt by their values, so that boxes of an image arrive in different triggers.

    ``n`` triggers take ``m`` files each; a file holds about ``rows`` line items at most. Returns the folder and ``m``.
    """
    path = scratch_path(spark, "arrivals")
    table = X.table(spark, sf, "lineitem")
    m = max(1, -(-table.count() // (n * rows)))
    table.repartition(n * m, *table.columns).write.parquet(path)
    return path, m


def _arrivals(spark, sf):
    folder, files = _in_parts(spark, sf)
    return jobs.file_stream(spark, folder, "*.parquet", files)


@query(
    "stream_label_pairs",
    sql(
        _PAIRS + """, kinds AS (SELECT *, 'overlapping_boxes' AS issue_type FROM pairs WHERE iou > 0.8
        UNION ALL SELECT *, 'duplicate_label' FROM pairs WHERE iou > 0.95 AND id_i = id_j)
        SELECT issue_type, sample_id, i AS label_index, j AS other_index, round(iou, 9) AS measure FROM kinds""",
        "corners",
    ),
)
def stream_label_pairs(spark, sf):
    from framewright.model import unit

    labels = _arrivals(spark, sf).select(
        F.col("l_orderkey").alias("sample_id"), X.label_key().alias("label_index"),
        F.concat("l_returnflag", "l_linestatus").alias("class_name"), X.class_id().alias("class_id"),
        unit(F.col("l_quantity") / 50).alias("cx"),
        unit((F.col("l_extendedprice") % 1000) / 1000).alias("cy"),
        unit(F.lit(0.02) + F.lit(9.8) * F.col("l_discount")).alias("w"),
        unit(F.lit(0.02) + F.lit(12.25) * F.col("l_tax")).alias("h"),
    )
    found = jobs.new_label_pairs(labels, scratch_path(spark, "label-pairs"))
    return found.select("issue_type", "sample_id", "label_index", "other_index", F.round("measure", 9).alias("measure"))


@query(
    "stream_review_state",
    sql(
        """SELECT item_id, arg_max(CASE WHEN annotations_edited THEN 'modified' ELSE status END,
        (ts, edit_id)) AS status, max(ts) AS ts FROM review_edits
        WHERE annotations_edited OR status IS NOT NULL GROUP BY 1""",
        "review_edits",
    ),
)
def stream_review_state(spark, sf):
    status = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "rejected")
    edits = _arrivals(spark, sf).select(
        F.col("l_orderkey").alias("item_id"), X.label_key().alias("edit_id"), F.col("l_shipdate").alias("ts"),
        status.alias("status"), (F.col("l_returnflag") == "N").alias("annotations_edited"),
    )
    return jobs.review_state(edits, scratch_path(spark, "review"), fan=3)


@query(
    "stream_new_labels_qa",
    sql(
        """, found AS (SELECT 'out_of_bounds' AS issue_type, sample_id, label_index FROM corners
          WHERE NOT (x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1) UNION ALL
          SELECT 'tiny_box', sample_id, label_index FROM corners WHERE w * h < 0.001 UNION ALL
          SELECT 'huge_box', sample_id, label_index FROM corners WHERE w * h > 0.9)
        SELECT * FROM found""",
        "corners",
    ),
)
def stream_new_labels_qa(spark, sf):
    from framewright.model import unit

    labels = jobs.file_stream(spark, sf, "lineitem.parquet").select(
        F.col("l_orderkey").alias("sample_id"), X.label_key().alias("label_index"),
        F.concat("l_returnflag", "l_linestatus").alias("class_name"),
        unit(F.col("l_quantity") / 50).alias("cx"),
        unit((F.col("l_extendedprice") % 1000) / 1000).alias("cy"),
        unit(F.lit(0.02) + F.lit(9.8) * F.col("l_discount")).alias("w"),
        unit(F.lit(0.02) + F.lit(12.25) * F.col("l_tax")).alias("h"),
    )
    found = _out(spark, jobs.new_label_checks(labels), "label-qa")
    return found.select("issue_type", "sample_id", "label_index")
