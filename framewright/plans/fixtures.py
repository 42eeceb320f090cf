"""Dataset tables derived from the star schema, once for Spark and once as SQL text.

No annotation data is given, so orders play images, line items play boxes and points, and events
play sensor messages and job steps. Every derivation is a projection over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.model import Dataset, unit
from framewright.operators.ranking import with_rank

# Camera of the fusion tables.
FX, FY, CX, CY, CAM_W, CAM_H = 500.0, 500.0, 320.0, 240.0, 640, 480


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores.

    A small table may be a single row group, which one task would have to work through. A table
    of enough files is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    d = ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def part(unit_name: str) -> Column:
        return F.extract(F.lit(unit_name), d)

    secs = part("DAY").cast("bigint") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60
    return secs * 1000000 + (part("SECOND") * 1000000).cast("bigint")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    width = F.when(F.col("o_orderstatus") == "O", 1920).otherwise(1280)
    split = F.when(F.col("o_orderpriority") == "1-URGENT", "test").when(
        F.col("o_orderpriority") == "2-HIGH", "val"
    ).when(F.col("o_orderpriority") != "5-LOW", "train")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_orderkey").alias("ordinal"),
        F.concat(F.lit("/data/img_"), F.col("o_orderkey"), F.lit(".jpg")).alias("image_path"),
        width.alias("image_width"),
        F.lit(720).alias("image_height"),
        split.alias("split"),
    )


def label_key() -> Column:
    """Order of a box inside its image: line, part, supplier and price, so that line items that
    share the first three still differ. Not dense; exact as a double too."""
    return (
        F.col("l_linenumber").cast("bigint") * 1000000000000000
        + F.col("l_partkey") % 10000 * 100000000000
        + F.col("l_suppkey") % 1000 * 100000000
        + F.round(F.col("l_extendedprice") * 100).cast("bigint")
    )


def class_id() -> Column:
    return (
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4)
        + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    )


def annotations(
    spark: SparkSession, sf: str, image: str = "l_orderkey", index: Column | None = None
) -> DataFrame:
    return spread(table(spark, sf, "lineitem")).select(
        F.col(image).alias("sample_id"),
        (label_key() if index is None else index).alias("label_index"),
        F.concat("l_returnflag", "l_linestatus").alias("class_name"),
        class_id().alias("class_id"),
        unit(F.col("l_quantity") / 50).alias("cx"),
        unit((F.col("l_extendedprice") % 1000) / 1000).alias("cy"),
        unit(F.lit(0.02) + F.lit(9.8) * F.col("l_discount")).alias("w"),
        unit(F.lit(0.02) + F.lit(12.25) * F.col("l_tax")).alias("h"),
        unit(F.lit(1) - F.lit(5) * F.col("l_tax")).alias("confidence"),
    )


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """Declared classes: those in use and one that nothing uses."""
    used = table(spark, sf, "lineitem").select(
        class_id().alias("class_id"), F.concat("l_returnflag", "l_linestatus").alias("class_name")
    )
    spare = table(spark, sf, "region").where(F.col("r_regionkey") == 0).select(
        F.lit(6).alias("class_id"), F.lower("r_name").alias("class_name")
    )
    return used.distinct().union(spare)


def dataset(spark: SparkSession, sf: str) -> Dataset:
    return Dataset(samples(spark, sf), annotations(spark, sf), classes(spark, sf), "orders")


def on_disk(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that exist: images of orders that are not partly delivered."""
    return table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(
        F.concat(F.lit("/data/img_"), F.col("o_orderkey"), F.lit(".jpg")).alias("path")
    )


def raw_points(spark: SparkSession, sf: str) -> DataFrame:
    """Point clouds of the suppliers, with the order key in place of a dense index."""
    return spread(table(spark, sf, "lineitem")).select(
        F.col("l_suppkey").alias("cloud_id"),
        F.col("l_orderkey").alias("scan_id"),
        label_key().alias("seq"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.lit(100) * F.col("l_discount")).alias("z"),
        (F.lit(5) * F.col("l_tax")).alias("intensity"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """The same clouds with a dense 0-based ``point_idx``."""
    return with_rank(
        raw_points(spark, sf),
        ["cloud_id"],
        [F.col("scan_id"), F.col("seq")],
        F.floor(F.col("scan_id") / 4096),
        "point_idx",
    ).drop("scan_id", "seq")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.lit("bag").alias("bag"),
        F.col("event_type").alias("topic"),
        F.col("event_id").alias("idx"),
        F.col("user_id").alias("sensor"),
        micros(F.col("ts")).alias("ts_us"),
    )


def boxes3d(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes whose projection lies near the 2D box of the same line item."""
    z = F.lit(5) + F.col("l_quantity") / 2
    cx, cy = F.col("l_quantity") / 50, (F.col("l_extendedprice") % 1000) / 1000
    return spread(table(spark, sf, "lineitem")).select(
        F.col("l_orderkey").alias("frame_id"),
        label_key().alias("det_id"),
        class_id().alias("class_id"),
        F.concat("l_returnflag", "l_linestatus").alias("class_name"),
        ((cx * CAM_W - CX) / FX * z).alias("x"),
        ((cy * CAM_H - CY) / FY * z).alias("y"),
        z.alias("z"),
        ((F.lit(0.02) + F.lit(8.0) * F.col("l_discount")) * CAM_W / FX * z).alias("l"),
        ((F.lit(0.02) + F.lit(10.0) * F.col("l_tax")) * CAM_H / FY * z).alias("w"),
        F.lit(0.5).alias("h"),
        (F.col("l_tax") - F.lit(0.04)).alias("yaw"),
        (F.lit(1) - F.lit(4) * F.col("l_tax")).alias("confidence"),
    )


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Job steps: one per event, ordered by event id inside a user's run."""
    failed = F.col("event_type") == "error"
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step_key"),
        micros(F.col("ts")).alias("ts_us"),
        F.col("event_type").alias("tool"),
        F.when(~failed, F.least(F.lit(1.0), F.col("value") / 100)).alias("confidence"),
        failed.alias("error"),
        F.get_json_object("props", "$.k").cast("bigint").alias("files_processed"),
        F.col("value").alias("duration"),
    )


def threads(spark: SparkSession, sf: str) -> DataFrame:
    status = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "completed")
        .when(F.col("o_orderpriority") == "2-HIGH", "cancelled")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "failed")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "awaiting_review")
        .otherwise("active")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("thread_id"),
        status.alias("status"),
        F.concat(F.lit("thread "), F.col("o_custkey")).alias("title"),
        F.col("o_orderdate").alias("updated_at"),
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("thread_id"),
        label_key().alias("snapshot_id"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_quantity").cast("int").alias("step_index"),
    )


def review_items(spark: SparkSession, sf: str) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "P", "pending")
        .when(F.col("o_orderstatus") == "F", "approved")
        .otherwise("rejected")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_custkey").alias("execution_id"),
        F.col("o_orderpriority").alias("project_id"),
        F.concat(F.lit("/data/img_"), F.col("o_orderkey"), F.lit(".jpg")).alias("file_path"),
        status.alias("status"),
    )


def review_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Edit log: approvals, rejections and annotation edits (null status)."""
    status = F.when(F.col("l_returnflag") == "A", "approved").when(
        F.col("l_returnflag") == "R", "rejected"
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item_id"),
        label_key().alias("edit_id"),
        F.col("l_shipdate").alias("ts"),
        status.alias("status"),
        (F.col("l_returnflag") == "N").alias("annotations_edited"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )


KEY_SQL = (
    "(CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_partkey % 10000 * 100000000000"
    " + l_suppkey % 1000 * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT))"
)
_CLASS = (
    "((CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END)"
    " + (CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END))"
)

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "samples": (
        """SELECT o_orderkey AS sample_id, o_orderkey AS ordinal,
        '/data/img_' || o_orderkey || '.jpg' AS image_path,
        CASE WHEN o_orderstatus = 'O' THEN 1920 ELSE 1280 END AS image_width, 720 AS image_height,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'test' WHEN '2-HIGH' THEN 'val'
          WHEN '5-LOW' THEN NULL ELSE 'train' END AS split FROM orders""",
        (),
    ),
    "annotations": (
        f"""SELECT l_orderkey AS sample_id, {KEY_SQL} AS label_index,
        l_returnflag || l_linestatus AS class_name, {_CLASS} AS class_id,
        greatest(0, least(1, l_quantity / 50)) AS cx,
        greatest(0, least(1, (l_extendedprice % 1000) / 1000)) AS cy,
        greatest(0, least(1, CAST(0.02 AS DOUBLE) + CAST(9.8 AS DOUBLE) * l_discount)) AS w,
        greatest(0, least(1, CAST(0.02 AS DOUBLE) + CAST(12.25 AS DOUBLE) * l_tax)) AS h,
        greatest(0, least(1, 1 - 5 * l_tax)) AS confidence FROM lineitem""",
        (),
    ),
    "corners": (
        """SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2
        FROM annotations""",
        ("annotations",),
    ),
    "classes": (
        f"""SELECT DISTINCT {_CLASS} AS class_id, l_returnflag || l_linestatus AS class_name
        FROM lineitem UNION ALL SELECT 6, lower(r_name) FROM region WHERE r_regionkey = 0""",
        (),
    ),
    "on_disk": (
        "SELECT '/data/img_' || o_orderkey || '.jpg' AS path FROM orders WHERE o_orderstatus <> 'P'",
        (),
    ),
    "points": (
        f"""SELECT l_suppkey AS cloud_id, row_number() OVER (PARTITION BY l_suppkey
          ORDER BY l_orderkey, {KEY_SQL}) - 1 AS point_idx, l_quantity AS x,
        l_extendedprice / 1000 AS y, 100 * l_discount AS z, 5 * l_tax AS intensity FROM lineitem""",
        (),
    ),
    "messages": (
        """SELECT 'bag' AS bag, event_type AS topic, event_id AS idx, user_id AS sensor,
        epoch_us(ts) AS ts_us FROM events""",
        (),
    ),
    "boxes3d": (
        f"""SELECT l_orderkey AS frame_id, {KEY_SQL} AS det_id, {_CLASS} AS class_id,
        l_returnflag || l_linestatus AS class_name,
        (l_quantity / 50 * 640 - 320) / 500 * (5 + l_quantity / 2) AS x,
        ((l_extendedprice % 1000) / 1000 * 480 - 240) / 500 * (5 + l_quantity / 2) AS y,
        5 + l_quantity / 2 AS z,
        (CAST(0.02 AS DOUBLE) + 8 * l_discount) * 640 / 500 * (5 + l_quantity / 2) AS l,
        (CAST(0.02 AS DOUBLE) + 10 * l_tax) * 480 / 500 * (5 + l_quantity / 2) AS w,
        CAST(0.5 AS DOUBLE) AS h, l_tax - CAST(0.04 AS DOUBLE) AS yaw, 1 - 4 * l_tax AS confidence
        FROM lineitem""",
        (),
    ),
    "steps": (
        """SELECT user_id AS run_id, event_id AS step_key, epoch_us(ts) AS ts_us,
        event_type AS tool,
        CASE WHEN event_type <> 'error' THEN least(1, value / 100) END AS confidence,
        event_type = 'error' AS error, CAST(json_extract_string(props, '$.k') AS BIGINT)
          AS files_processed, value AS duration FROM events""",
        (),
    ),
    "threads": (
        """SELECT o_orderkey AS thread_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'completed'
        WHEN '2-HIGH' THEN 'cancelled' WHEN '3-MEDIUM' THEN 'failed'
        WHEN '4-NOT SPECIFIED' THEN 'awaiting_review' ELSE 'active' END AS status,
        'thread ' || o_custkey AS title, o_orderdate AS updated_at FROM orders""",
        (),
    ),
    "snapshots": (
        f"""SELECT l_orderkey AS thread_id, {KEY_SQL} AS snapshot_id, l_shipdate AS created_at,
        CAST(floor(l_quantity) AS INTEGER) AS step_index FROM lineitem""",
        (),
    ),
    "review_items": (
        """SELECT o_orderkey AS item_id, o_custkey AS execution_id, o_orderpriority AS project_id,
        '/data/img_' || o_orderkey || '.jpg' AS file_path,
        CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END
          AS status FROM orders""",
        (),
    ),
    "review_edits": (
        f"""SELECT l_orderkey AS item_id, {KEY_SQL} AS edit_id, l_shipdate AS ts,
        CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' END AS status,
        l_returnflag = 'N' AS annotations_edited FROM lineitem""",
        (),
    ),
    "vectors": ("SELECT vec_id AS id, embedding AS vector FROM embeddings", ()),
    "hashes": (
        """SELECT id, list_aggregate(list_transform(vector, lambda v: CASE WHEN
          CAST(v AS DOUBLE) > list_avg(vector) THEN '1' ELSE '0' END), 'string_agg', '') AS bits
        FROM vectors""",
        ("vectors",),
    ),
}


def sql(body: str, *views: str) -> str:
    """Put the named derived views in front of a query body (which may add ``, name AS (...)``)."""
    need: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][1]:
            add(dep)
        if name not in need:
            need.append(name)

    for v in views:
        add(v)
    head = ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in need)
    recursive = "RECURSIVE " if body.startswith("/*recursive*/") else ""
    body = body.removeprefix("/*recursive*/").strip()
    glue = "" if body.startswith(",") else "\n"
    return f"WITH {recursive}{head}{glue}{body}"
