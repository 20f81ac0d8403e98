"""Frames, detections, latencies and messages derived from the driver's tables by one SQL text, here and in DuckDB.

The tables hold no frames, so deterministic arithmetic on their keys stands in for a detector and a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "detections": """
        SELECT l_orderkey AS frame_idx, CAST(l_linenumber - 1 AS INT) AS patch_id,
               CAST((l_partkey * 7) % 64 AS DOUBLE) AS x1, CAST((l_suppkey * 13) % 64 AS DOUBLE) AS y1,
               CAST((l_partkey * 7) % 64 + 16 AS DOUBLE) + l_quantity AS x2, CAST((l_suppkey * 13) % 64 + 16 AS DOUBLE) + l_quantity AS y2,
               CAST((l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 1000 AS DOUBLE) / 1e3 AS conf, CAST(l_partkey % 3 AS INT) AS cls
        FROM {lineitem}""",
    "frames": """
        SELECT event_id AS source_idx, user_id % 4 AS stream_id, event_id * 33 AS t_ms,
               CAST(CASE event_id % 6 WHEN 0 THEN 3840 WHEN 1 THEN 1920 WHEN 2 THEN 5956 WHEN 3 THEN 640 WHEN 4 THEN 4294 ELSE 1281 END AS INT) AS w,
               CAST(CASE event_id % 6 WHEN 0 THEN 2160 WHEN 1 THEN 1080 WHEN 2 THEN 1440 WHEN 3 THEN 480 WHEN 4 THEN 2560 ELSE 1281 END AS INT) AS h
        FROM {events}""",
    "images": """
        SELECT o_orderkey AS image_id,
               concat('shots/d', CAST(o_orderkey % 5 AS VARCHAR(20)), '/im.', CAST(o_orderkey AS VARCHAR(20)),
                      CASE o_orderkey % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' WHEN 3 THEN '.bmp' WHEN 4 THEN '.txt' WHEN 5 THEN '.jpg.bak' ELSE '.PNG' END) AS path,
               CAST(CASE o_orderkey % 5 WHEN 0 THEN 3840 WHEN 1 THEN 1000 WHEN 2 THEN 1281 WHEN 3 THEN 640 ELSE 4001 END AS INT) AS w,
               CAST(CASE o_orderkey % 5 WHEN 0 THEN 2160 WHEN 1 THEN 1000 WHEN 2 THEN 719 WHEN 3 THEN 480 ELSE 3003 END AS INT) AS h
        FROM {orders}""",
    "sources": """
        SELECT o_orderkey AS id,
               CASE o_orderkey % 7 WHEN 0 THEN concat('rtsp://cam/', CAST(o_orderkey AS VARCHAR(20))) WHEN 1 THEN concat('in/v.', CAST(o_orderkey AS VARCHAR(20)), '.mp4')
                    WHEN 2 THEN CAST(o_orderkey AS VARCHAR(20)) WHEN 3 THEN 'httpfoo.mp4' WHEN 4 THEN concat('tcp://h:', CAST(o_orderkey AS VARCHAR(20)))
                    WHEN 5 THEN concat('clip', CAST(o_orderkey AS VARCHAR(20))) ELSE concat('a/b/', CAST(o_orderkey AS VARCHAR(20)), 'x') END AS source,
               o_orderkey % 2 = 0 AS save, o_orderkey % 3 = 0 AS save_json
        FROM {orders}""",
    "latency": """
        SELECT event_id AS frame_idx, event_id % 3 AS run, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS dispatch_to_write_ms,
               CASE WHEN event_id % 11 = 0 THEN value * 0.5e0 ELSE value * 0.8e0 END AS dispatch_to_result_ms,
               CAST((event_id * 7) % 48 AS BIGINT) AS dispatch_backlog, CAST((event_id * 5) % 9 AS DOUBLE) AS stale_frames,
               CAST((event_id * 5) % 9 AS DOUBLE) * 40e0 AS stale_ms
        FROM {events}""",
    "timings": """
        SELECT user_id % 4 AS run, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(event_id % 97 AS DOUBLE) / 1e3 END AS total,
               CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(event_id % 61 AS DOUBLE) / 1e3 END AS inference,
               CASE WHEN event_id % 5 > 2 THEN NULL ELSE CAST(event_id % 13 AS DOUBLE) / 1e3 END AS nms,
               CAST(event_id % 29 AS DOUBLE) / 1e3 AS read, CAST(event_id % (20 + 30 * (user_id % 4)) AS DOUBLE) / 1e3 AS preprocess,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 17 AS DOUBLE) / 1e3 END AS visual, 60e0 AS wall_s
        FROM {events}""",
    "fps_history": """
        SELECT run, i, CAST(i AS DOUBLE) AS t, CAST(n AS DOUBLE) * least(1e0, CAST(i + 1 AS DOUBLE) / 6e0) AS fps
        FROM (SELECT user_id % 4 AS run, CAST(day(ts) - 1 AS BIGINT) AS i, count(*) AS n FROM {events} GROUP BY user_id % 4, day(ts) - 1) AS daily
        UNION ALL
        SELECT run, i, t, fps FROM (VALUES
          (10, 0, 0e0, 5e0), (10, 1, 1e0, 6e0), (11, 0, 0e0, 0e0), (11, 1, 1e0, 9e0), (11, 2, 2e0, 9e0), (11, 3, 3e0, 9e0), (11, 4, 4e0, 9e0), (11, 5, 5e0, 9e0),
          (12, 0, 0e0, 7e0)) AS short(run, i, t, fps)""",
    "queue_runs": """
        SELECT o_custkey % 50 AS run, CAST(count(*) * (o_custkey % 2) AS BIGINT) AS frames_seen, count(CASE WHEN o_orderkey % 5 > 0 THEN 1 END) AS frames_written,
               count(CASE WHEN o_orderkey % 5 = 0 THEN 1 END) AS frames_dropped, CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 12.5e0 ELSE -1e0 END AS input_fps_cap,
               CASE o_custkey % 4 WHEN 0 THEN 0e0 ELSE 25e0 END AS loader_fps
        FROM {orders} GROUP BY o_custkey""",
    "arrivals": """
        SELECT user_id % 4 AS stream_id, event_id * 10 AS t, 'arrival' AS kind, event_id AS source_idx FROM {events}
        UNION ALL
        SELECT user_id % 4 AS stream_id, event_id * 10 + 5 + (event_id * 37) % 190 AS t, 'completion' AS kind, event_id AS source_idx FROM {events}""",
    "stale_events": """
        SELECT user_id % 4 AS stream_id, event_id * 10 AS t, 'ingest' AS kind, event_id AS source_idx, CASE user_id % 3 WHEN 0 THEN 25e0 WHEN 1 THEN 0e0 ELSE 50e0 END AS fps FROM {events}
        UNION ALL
        SELECT user_id % 4 AS stream_id, event_id * 10 + 3 + (event_id * 37) % 900 AS t, 'emit' AS kind, event_id AS source_idx, CASE user_id % 3 WHEN 0 THEN 25e0 WHEN 1 THEN 0e0 ELSE 50e0 END AS fps FROM {events}""",
    "emitted": "SELECT user_id % 4 AS run, CAST((event_id * 7919) % 20000 AS DOUBLE) / 1e1 AS t FROM {events}",
    "messages": """
        SELECT event_id AS seq, user_id % 3 AS device,
               CASE event_id % 9
                 WHEN 0 THEN concat(CAST(event_id AS VARCHAR(20)), '|0.5|0.25|0.125|[[1.0, 2.0, 3.0, 4.0, 0.5, 1.0]]') WHEN 1 THEN concat(CAST(event_id AS VARCHAR(20)), '|0.75|[]')
                 WHEN 2 THEN concat(CAST(event_id AS VARCHAR(20)), '|[[5.0, 6.0, 7.0, 8.0, 0.25, 0.0]]') WHEN 3 THEN concat(CAST(event_id AS VARCHAR(20)), '|0.5|0.25|[]')
                 WHEN 4 THEN 'Ready.' WHEN 5 THEN concat('x', CAST(event_id AS VARCHAR(20)), '|0.5|0.25|0.125|[]') WHEN 6 THEN concat(CAST(event_id AS VARCHAR(20)), '|0.5|0.25|oops|[]')
                 WHEN 7 THEN concat('  ', CAST(event_id AS VARCHAR(20)), '|1.5|1.0|0.5|[] ') ELSE concat(CAST(event_id AS VARCHAR(20)), '|0.5|') END AS line
        FROM {events}""",
}
TABLES = ("lineitem", "events", "orders")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text})


def duck(name: str) -> str:
    """The view as a DuckDB common table expression."""
    return f"{name} AS ({SQL[name].format(**{t: t for t in TABLES})})"
