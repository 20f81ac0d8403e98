"""Registered queries of the detection engine and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.functions import geometry, text
from frametide.operators import detections as D
from frametide.operators import policy as P
from frametide.operators import sequences as S
from frametide.operators import telemetry as M
from frametide.plans.views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The tilings that the published figures use (patch, least overlap).
TILINGS = ((640, 128), (960, 128), (1280, 128), (1920, 128), (256, 32))
GLOBAL_SIZE = 640


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name. ``sql`` may use ``views`` as tables."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
            body = sql.replace("RECURSIVE", "")
            parts = [duck(v) for v in views]
            head, sep, rest = body.lstrip().partition("WITH ") if body.lstrip().startswith("WITH ") else ("", "", body)
            ORACLE_SQL[f.__name__] = f"WITH {recursive}" + ", ".join(parts) + (", " + rest if sep else " " + rest) if parts else body
        return f

    return register


def _tiles_sql(dims: str, patch: str = "patch", overlap: str = "overlap") -> str:
    """CTE ``axis``: starts of each (dim, patch, overlap) of the CTE ``dims``."""
    return f"""dims AS ({dims}),
    st AS (SELECT *, CASE WHEN d <= {patch} THEN 0e0 ELSE CAST(d - {patch} AS DOUBLE) / ceil(CAST(d - {patch} AS DOUBLE) / ({patch} - {overlap})) END AS s FROM dims),
    axis AS (SELECT d, {patch} AS patch, {overlap} AS overlap, i, greatest(0, least(CAST(trunc(i * s) AS INT) + {patch}, d) - {patch}) AS a
             FROM (SELECT *, unnest(range(0, CASE WHEN s > 0 THEN CAST(ceil((d - {patch}) / s) AS BIGINT) + 1 ELSE 1 END)) AS i FROM st))"""


@query("SELECT source_idx, stream_id FROM frames WHERE source_idx % 3 = 1", "frames")
def stride_sample(spark, sf):
    return D.stride_sample(view(spark, sf, "frames"), 3, 1).select("source_idx", "stream_id")


@query("SELECT id, source, regexp_matches(source, '^(rtsp|rtmp|http|tcp)') OR regexp_full_match(source, '[0-9]+') AS is_stream FROM sources", "sources")
def source_kind(spark, sf):
    return view(spark, sf, "sources").select("id", "source", text.is_stream(F.col("source")).alias("is_stream"))


@query("SELECT image_id, path, string_split(path, '/')[-1] AS name FROM images WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|bmp)$')", "images")
def image_scan(spark, sf):
    return view(spark, sf, "images").filter(text.is_image(F.col("path"))).select("image_id", "path", text.basename(F.col("path")).alias("name"))


TILING_SQL = "(VALUES " + ", ".join(map(str, TILINGS)) + ") AS tl(patch, overlap)"


@query(f"SELECT DISTINCT w AS dim, patch, overlap, CASE WHEN w <= patch THEN 0e0 ELSE CAST(w - patch AS DOUBLE) / ceil(CAST(w - patch AS DOUBLE) / (patch - overlap)) END AS stride FROM frames, {TILING_SQL}", "frames")
def optimal_stride(spark, sf):
    dims = view(spark, sf, "frames").select(F.col("w").alias("dim")).distinct()
    each = [F.struct(F.lit(p).alias("patch"), F.lit(o).alias("overlap"), geometry.optimal_stride(F.col("dim"), p, o).alias("stride")) for p, o in TILINGS]
    return dims.select("dim", F.inline(F.array(*each)))


@query(
    f"WITH shapes AS (SELECT DISTINCT w, h FROM frames), {_tiles_sql(f'SELECT DISTINCT d, patch, overlap FROM (SELECT w AS d FROM frames UNION SELECT h FROM frames) AS q, {TILING_SQL}')}, "
    "xn AS (SELECT d, patch, count(*) AS n FROM axis GROUP BY d, patch) "
    "SELECT w, h, x.patch, x.overlap, CAST(y.i * xn.n + x.i AS INT) AS patch_id, x.a AS x0, y.a AS y0, x.a + x.patch AS x1, y.a + x.patch AS y1 "
    "FROM shapes JOIN axis AS x ON x.d = w JOIN axis AS y ON y.d = h AND y.patch = x.patch JOIN xn ON xn.d = w AND xn.patch = x.patch",
    "frames",
)
def patch_windows(spark, sf):
    shapes = view(spark, sf, "frames").select("w", "h").distinct()
    parts = [D.tile_frames(shapes, p, o).withColumns({"patch": F.lit(p), "overlap": F.lit(o)}) for p, o in TILINGS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("w", "h", "patch", "overlap", "patch_id", "x0", "y0", "x1", "y1")


@query(
    f"WITH {_tiles_sql('SELECT DISTINCT d FROM (SELECT w AS d FROM frames UNION SELECT h FROM frames) AS q', '1280', '128')}, n AS (SELECT d, count(*) AS n, sum(a) AS s FROM axis GROUP BY d) "
    "SELECT source_idx, x.n * y.n AS n_tiles, CAST(x.s * y.n AS BIGINT) AS sum_x0 FROM frames JOIN n AS x ON x.d = w JOIN n AS y ON y.d = h",
    "frames",
)
def tiles_per_frame(spark, sf):
    frames = view(spark, sf, "frames")
    # one tiling per distinct shape; Catalyst broadcasts the few shapes
    per_shape = D.tile_frames(frames.select("w", "h").distinct(), 1280, 128).groupBy("w", "h").agg(F.count("*").alias("n_tiles"), F.sum("x0").alias("sum_x0"))
    return frames.join(per_shape, ["w", "h"]).select("source_idx", "n_tiles", "sum_x0")


LETTERBOX_SQL = """WITH a AS (SELECT image_id, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, w = 3840 AND h = 2160 AS same FROM images),
 b AS (SELECT *, least(2160e0 / h, 3840e0 / w) AS r FROM a), c AS (SELECT *, round_even(w * r, 0) AS uw, round_even(h * r, 0) AS uh FROM b),
 e AS (SELECT *, (3840e0 - uw) / 2e0 AS dw, (2160e0 - uh) / 2e0 AS dh FROM c)"""


@query(
    LETTERBOX_SQL + " SELECT image_id, CASE WHEN same THEN 1e0 ELSE r END AS rx, CASE WHEN same THEN 1e0 ELSE r END AS ry, dw, dh, CAST(uw AS INT) AS unpad_w, CAST(uh AS INT) AS unpad_h, "
    'CAST(round_even(dh - 0.1e0, 0) AS INT) AS top, CAST(round_even(dh + 0.1e0, 0) AS INT) AS bottom, CAST(round_even(dw - 0.1e0, 0) AS INT) AS "left", CAST(round_even(dw + 0.1e0, 0) AS INT) AS "right" FROM e',
    "images",
)
def letterbox(spark, sf):
    return view(spark, sf, "images").select("image_id", geometry.prepare(F.col("w"), F.col("h"), 3840, 2160).alias("b")).select("image_id", "b.*")


@query("SELECT image_id, greatest(0, w // 2 - 640) AS x1, greatest(0, h // 2 - 360) AS y1, least(greatest(0, w // 2 - 640) + 1280, w) AS x2, least(greatest(0, h // 2 - 360) + 720, h) AS y2 FROM images", "images")
def center_crop(spark, sf):
    (x1, x2), (y1, y2) = geometry.center_crop(F.col("w"), 1280), geometry.center_crop(F.col("h"), 720)
    return view(spark, sf, "images").select("image_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


@query(
    LETTERBOX_SQL + " SELECT d.frame_idx, d.conf, " + ", ".join(f"greatest(0e0, least((d.{c} * 40e0 - e.d{s}) / (CASE WHEN same THEN 1e0 ELSE e.r END), e.{s})) AS {c}" for c, s in (("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h")))
    + " FROM detections AS d JOIN e ON e.image_id = d.frame_idx",
    "images", "detections",
)
def inverse_clamp(spark, sf):
    images = view(spark, sf, "images").select(F.col("image_id").alias("frame_idx"), "w", "h", geometry.prepare(F.col("w"), F.col("h"), 3840, 2160).alias("b"))
    both = view(spark, sf, "detections").join(images, "frame_idx")
    back = [geometry.inverse_clamp(F.col(c) * 40.0, F.col("b.dw" if c[0] == "x" else "b.dh"), F.col("b.rx" if c[0] == "x" else "b.ry"), F.col("w" if c[0] == "x" else "h")).alias(c) for c in D.BOX[:4]]
    return both.select("frame_idx", "conf", *back)


TILES_4K = "(VALUES (0, 0, 0), (1, 853, 0), (2, 1706, 0), (3, 2560, 0), (4, 0, 880), (5, 853, 880), (6, 1706, 880), (7, 2560, 880)) AS t4(patch_id, x0, y0)"


def _tiles_4k(spark):
    shape = spark.sql("SELECT 3840 AS w, 2160 AS h")
    return D.tile_frames(shape, 1280, 128)


@query(f"SELECT frame_idx, d.patch_id, x1 + x0 AS x1, y1 + y0 AS y1, x2 + x0 AS x2, y2 + y0 AS y2, conf, cls FROM detections AS d JOIN {TILES_4K} ON t4.patch_id = d.patch_id", "detections")
def offset_boxes(spark, sf):
    return D.offset_boxes(view(spark, sf, "detections"), _tiles_4k(spark), ["patch_id"]).select("frame_idx", "patch_id", *D.BOX)


@query(
    f"SELECT frame_idx, patch_id = 6 AS is_global, CASE WHEN patch_id = 6 THEN x1 * (3840e0 / 640e0) ELSE x1 + x0 END AS x1, CASE WHEN patch_id = 6 THEN y1 * (2160e0 / 640e0) ELSE y1 + y0 END AS y1, "
    f"CASE WHEN patch_id = 6 THEN x2 * (3840e0 / 640e0) ELSE x2 + x0 END AS x2, CASE WHEN patch_id = 6 THEN y2 * (2160e0 / 640e0) ELSE y2 + y0 END AS y2 "
    f"FROM (SELECT d.*, t4.x0, t4.y0 FROM detections AS d JOIN {TILES_4K} ON t4.patch_id = d.patch_id) AS q",
    "detections",
)
def scale_global(spark, sf):
    found = view(spark, sf, "detections")  # the last patch is the whole frame
    whole = D.scale_global(found.filter("patch_id = 6"), F.lit(3840.0), F.lit(2160.0), GLOBAL_SIZE)
    tiled = D.offset_boxes(found.filter("patch_id < 6"), _tiles_4k(spark), ["patch_id"])
    both = tiled.select(*found.columns).unionByName(whole)
    return both.select("frame_idx", (F.col("patch_id") == 6).alias("is_global"), *D.BOX[:4])


@query("SELECT frame_idx, patch_id, conf, cls FROM detections WHERE conf > 0.25e0 AND cls IN (0, 2)", "detections")
def conf_class_filter(spark, sf):
    return D.select_boxes(view(spark, sf, "detections"), 0.25, [0, 2]).select("frame_idx", "patch_id", "conf", "cls")


def _nms_sql(keys: str) -> str:
    """Rounds of greedy suppression: each keeps the best box left in every group and drops what it overlaps."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    inter = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0e0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0e0)"
    area = "(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)"
    return f"""WITH RECURSIVE r AS MATERIALIZED (SELECT frame_idx, x1, y1, x2, y2, conf, cls, row_number() OVER (PARTITION BY {keys} ORDER BY conf DESC, x1, y1, x2, y2, cls) AS n FROM detections WHERE conf > 0.25e0),
     s AS MATERIALIZED (SELECT {', '.join('a.' + k for k in keys.split(', '))}, b.n AS n, list(a.n) AS by_ FROM r AS a JOIN r AS b ON {same} AND a.n < b.n AND {inter} > 0.45e0 * ({area} - {inter}) GROUP BY {', '.join('a.' + k for k in keys.split(', '))}, b.n),
     g AS MATERIALIZED (SELECT {', '.join('r.' + k for k in keys.split(', '))}, r.n, coalesce(s.by_, CAST([] AS BIGINT[])) AS by_ FROM r LEFT JOIN s ON {' AND '.join(f's.{k} = r.{k}' for k in keys.split(', '))} AND s.n = r.n),
     f AS (SELECT {keys}, CAST(1 AS BIGINT) AS n, CAST([1] AS BIGINT[]) AS kept FROM g WHERE n = 1
           UNION ALL SELECT {', '.join('f.' + k for k in keys.split(', '))}, g.n, CASE WHEN list_has_any(f.kept, g.by_) THEN f.kept ELSE list_append(f.kept, g.n) END FROM f JOIN g ON {' AND '.join(f'g.{k} = f.{k}' for k in keys.split(', '))} AND g.n = f.n + 1),
     k AS (SELECT {keys}, unnest(kept) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC) AS last_ FROM f) AS q WHERE last_ = 1)
     SELECT r.frame_idx, CAST(row_number() OVER (PARTITION BY r.frame_idx ORDER BY conf DESC, x1, y1, x2, y2, r.cls) - 1 AS INT) AS rank, x1, y1, x2, y2, conf, r.cls FROM r JOIN k ON {' AND '.join(f'k.{k} = r.{k}' for k in keys.split(', '))} AND k.n = r.n"""


NMS_SQL, NMS_CLASS_SQL = _nms_sql("frame_idx"), _nms_sql("frame_idx, cls")


def _kept(spark, sf, per_class=False):
    return D.nms(view(spark, sf, "detections"), 0.25, 0.45, per_class)


@query(NMS_SQL, "detections")
def nms(spark, sf):
    return _kept(spark, sf)


@query(NMS_CLASS_SQL, "detections")
def nms_per_class(spark, sf):
    return _kept(spark, sf, True)


@query(NMS_SQL, "detections")
def nms_crowded(spark, sf):
    return D.nms_arrow(view(spark, sf, "detections"), 0.25, 0.45)


def _after_nms(select: str) -> str:
    head, _, last = NMS_SQL.rpartition("\n     SELECT ")
    return f"{head}, kept AS (SELECT {last}) {select}"


def _all_frames(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("frame_idx"))


@query(_after_nms("SELECT o_orderkey AS frame_idx, count(kept.frame_idx) AS n FROM orders LEFT JOIN kept ON kept.frame_idx = o_orderkey GROUP BY o_orderkey"), "detections")
def object_count(spark, sf):
    return D.object_count(_all_frames(spark, sf), _kept(spark, sf))


BOX_TEXT = "concat('{\"bbox\":[', CAST(x1 AS VARCHAR), ',', CAST(y1 AS VARCHAR), ',', CAST(x2 AS VARCHAR), ',', CAST(y2 AS VARCHAR), '],\"conf\":', CAST(conf AS VARCHAR), ',\"class\":', CAST(cls AS VARCHAR), '}')"


@query(
    _after_nms(
        f"SELECT o_orderkey AS frame_idx, concat('{{\"frame_idx\":', CAST(o_orderkey AS VARCHAR), ',\"detections\":[', coalesce(string_agg({BOX_TEXT}, ',' ORDER BY rank) FILTER (WHERE kept.frame_idx IS NOT NULL), ''), ']}}') AS document "
        "FROM orders LEFT JOIN kept ON kept.frame_idx = o_orderkey GROUP BY o_orderkey"
    ),
    "detections",
)
def frame_json(spark, sf):
    docs = D.frame_documents(_all_frames(spark, sf), _kept(spark, sf))
    return docs.select("frame_idx", F.to_json(F.struct("frame_idx", "detections")).alias("document"))


@query(
    _after_nms(
        "SELECT path, string_split(path, '/')[-1] AS name, concat('[', coalesce(string_agg(concat('[', CAST(x1 AS VARCHAR), ',', CAST(y1 AS VARCHAR), ',', CAST(x2 AS VARCHAR), ',', CAST(y2 AS VARCHAR), ',', CAST(conf AS VARCHAR), ',', CAST(CAST(kept.cls AS DOUBLE) AS VARCHAR), ']'), ',' ORDER BY rank) FILTER (WHERE kept.frame_idx IS NOT NULL), ''), ']') AS boxes "
        "FROM images LEFT JOIN kept ON kept.frame_idx = image_id GROUP BY path"
    ),
    "detections", "images",
)
def image_json(spark, sf):
    images = view(spark, sf, "images").select(F.col("image_id").alias("frame_idx"), "path")
    docs = D.image_documents(images, _kept(spark, sf).join(images, "frame_idx"))
    return docs.select("path", "name", F.to_json("boxes").alias("boxes"))


@query(
    "SELECT frame_idx, " + ", ".join(f"CAST(trunc({c}) AS INT) AS {c}" for c in D.BOX[:4])
    + ", CAST(trunc(255e0 * (1e0 - conf)) AS INT) AS green, format('{:.2f}', conf) AS label, CAST(CASE WHEN trunc(y1) - 2 > 0 THEN trunc(y1) - 2 ELSE trunc(y1) + 10 END AS INT) AS label_y FROM detections",
    "detections",
)
def draw_primitives(spark, sf):
    return D.draw_primitives(view(spark, sf, "detections"))


@query(
    "WITH n AS (SELECT *, CASE WHEN regexp_matches(source, '^(rtsp|rtmp|http|tcp)') OR regexp_full_match(source, '[0-9]+') THEN 'stream_output.mp4' ELSE string_split(source, '/')[-1] END AS filename FROM sources) "
    "SELECT id, filename, CASE WHEN save THEN concat('out/', filename) END AS save_path, CASE WHEN save_json THEN concat('out/', regexp_replace(filename, '^(.+)\\.[^.]*$', '\\1'), '.json') END AS json_path FROM n",
    "sources",
)
def output_paths(spark, sf):
    rows = view(spark, sf, "sources")
    return rows.select("id", text.output_paths(F.col("source"), "out", F.col("save"), F.col("save_json")).alias("p")).select("id", "p.*")


def _summary_sql(v: str) -> str:
    q = ", ".join(f"round(coalesce(quantile_cont({v}, {p}), 0e0), 6) AS {n}" for p, n in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99")))
    return f"count({v}) AS count, round(coalesce(avg({v}), 0e0), 6) AS mean, {q}, coalesce(min({v}), 0e0) AS min, coalesce(max({v}), 0e0) AS max"


INTERPOLATED = ("mean", "p50", "p95", "p99")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums and interpolations of doubles depend on the order of operations in the last digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"SELECT run, {_summary_sql('dispatch_to_write_ms')} FROM latency GROUP BY run", "latency")
def percentile_summary(spark, sf):
    return _rounded(view(spark, sf, "latency").groupBy("run").agg(*M.summary(F.col("dispatch_to_write_ms"))), *INTERPOLATED)


TIMINGS_SQL = (
    "SELECT run, round(coalesce(avg(total), 0e0), 6) AS worker_total, round(coalesce(avg(inference), 0e0), 6) AS inference, round(coalesce(avg(nms), 0e0), 6) AS nms, round(sum(read) / count(read), 6) AS read, "
    "round(sum(preprocess) / count(read), 6) AS preprocess, round(sum(visual) / count(visual), 6) AS visual, round(1000e0 / (count(*) / max(wall_s)), 6) AS e2e_ms FROM timings GROUP BY run"
)


@query(TIMINGS_SQL, "timings")
def avg_timings(spark, sf):
    out = M.average_timings(view(spark, sf, "timings"), ["run"])
    return _rounded(out, *(c for c in out.columns if c != "run"))


@query(f"SELECT run, CASE WHEN inference > preprocess AND inference > read THEN 'GPU Inference' ELSE 'CPU Preprocessing/Reading' END AS bottleneck FROM ({TIMINGS_SQL}) AS q", "timings")
def bottleneck(spark, sf):
    return avg_timings(spark, sf).select("run", M.bottleneck(F.col("inference"), F.col("preprocess"), F.col("read")).alias("bottleneck"))


@query(
    "SELECT run, frames_written, attempted, retain_ratio, fps_reference, fps_reference * retain_ratio AS retained_fps, CASE WHEN attempted > 0 THEN frames_dropped * 100e0 / attempted ELSE 0e0 END AS drop_rate FROM ("
    "SELECT *, CASE WHEN attempted > 0 THEN CAST(frames_written AS DOUBLE) / attempted ELSE 0e0 END AS retain_ratio, CASE WHEN input_fps_cap > 0 THEN input_fps_cap WHEN loader_fps > 0 THEN loader_fps ELSE 30e0 END AS fps_reference "
    "FROM (SELECT *, CASE WHEN frames_seen > 0 THEN frames_seen ELSE frames_written + frames_dropped END AS attempted FROM queue_runs) AS a) AS b",
    "queue_runs",
)
def queue_control(spark, sf):
    return M.queue_control(view(spark, sf, "queue_runs")).select("run", "frames_written", "attempted", "retain_ratio", "fps_reference", "retained_fps", "drop_rate")


@query(
    "SELECT o_custkey % 7 AS run, count(*) FILTER (WHERE o_orderkey % 4 IN (0, 3)) AS drop_oldest, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS drop_newest, count(*) FILTER (WHERE o_orderkey % 4 = 2) AS latest_only FROM orders GROUP BY o_custkey % 7",
)
def drops_by_policy(spark, sf):
    named = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey % 7 AS run", "CASE o_orderkey % 4 WHEN 0 THEN ' Drop_Oldest ' WHEN 1 THEN 'drop_newest' WHEN 2 THEN 'LATEST_ONLY' ELSE 'bad' END AS policy")
    return M.drops_by_policy(named.withColumn("policy", text.policy(F.col("policy"))), ["run"])


CONTROLS = "SELECT o_orderkey AS id, CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE o_orderkey % 4 * 10 - 10 END AS INT) AS max_in_flight, CASE o_orderkey % 3 WHEN 0 THEN ' Latest_Only' WHEN 1 THEN 'drop_newest' ELSE 'none' END AS drop_policy, CASE o_orderkey % 5 WHEN 0 THEN '30' WHEN 1 THEN 'x' WHEN 2 THEN '-1' WHEN 3 THEN NULL ELSE '12.5' END AS input_fps_cap FROM {orders}"


@query(
    "SELECT id, CAST(CASE WHEN p = 'latest_only' THEN 1 WHEN max_in_flight >= 1 THEN max_in_flight ELSE 64 END AS INT) AS max_in_flight, p AS drop_policy, CASE WHEN c > 0 THEN c END AS input_fps_cap "
    f"FROM (SELECT *, CASE WHEN lower(trim(drop_policy)) IN ('drop_oldest', 'drop_newest', 'latest_only') THEN lower(trim(drop_policy)) ELSE 'drop_oldest' END AS p, TRY_CAST(input_fps_cap AS DOUBLE) AS c FROM ({CONTROLS.format(orders='orders')}) AS q) AS r",
)
def normalized_controls(spark, sf):
    return M.normalized_controls(spark.sql(CONTROLS, orders=spark.read.parquet(f"{sf}/orders.parquet")))


@query(
    f"WITH b AS (SELECT * FROM (VALUES ('q_0_15', 0, 15), ('q_16_31', 16, 31), ('q_32_plus', 32, 1000000)) AS v(bucket, lo, hi)) SELECT bucket, {_summary_sql('dispatch_to_write_ms')} "
    "FROM b LEFT JOIN latency ON dispatch_to_write_ms IS NOT NULL AND dispatch_backlog BETWEEN lo AND hi GROUP BY bucket",
    "latency",
)
def latency_by_backlog(spark, sf):
    return _rounded(M.latency_by_backlog(view(spark, sf, "latency")), *INTERPOLATED)


@query(
    " UNION ALL ".join(f"SELECT '{m}' AS metric, {_summary_sql(f'CAST({m} AS DOUBLE)')} FROM latency" for m in ("dispatch_to_result_ms", "dispatch_to_write_ms", "dispatch_backlog", "stale_frames", "stale_ms")),
    "latency",
)
def latency_trace_summary(spark, sf):
    return _rounded(M.latency_trace_summary(view(spark, sf, "latency")), *INTERPOLATED)


@query(
    "WITH c AS (SELECT run, CAST(floor(t) AS BIGINT) AS i, CAST(count(*) AS DOUBLE) AS fps FROM emitted GROUP BY run, floor(t)), e AS (SELECT run, unnest(range(min(i), max(i) + 1)) AS i FROM c GROUP BY run) "
    "SELECT e.run, e.i, coalesce(c.fps, 0e0) AS fps FROM e LEFT JOIN c ON c.run = e.run AND c.i = e.i",
    "emitted",
)
def fps_bins(spark, sf):
    return M.fps_bins(view(spark, sf, "emitted"), "run", "t")


STABLE_SQL = """WITH b AS (SELECT run, i, t, fps, quantile_cont(CASE WHEN fps > 0 THEN fps END, 0.5) OVER (PARTITION BY run ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS base FROM fps_history),
 e AS (SELECT run, 1 + max(i) AS e FROM b WHERE i < 10 OR base IS NULL OR fps BETWEEN base * (1 - 0.35e0) AND base * (1 + 0.35e0) GROUP BY run),
 fl AS (SELECT run, coalesce(greatest(1e0, 0.3e0 * quantile_cont(CASE WHEN fps > 0 THEN fps END, 0.9)), 0e0) AS fl FROM b JOIN e USING (run) WHERE i < e GROUP BY run),
 w AS (SELECT b.run, b.i, fps, fl, count(*) OVER k AS c, max(t) OVER k - min(t) OVER k AS span, quantile_cont(fps, 0.5) OVER k AS med, stddev_pop(fps) OVER k AS sd, list(fps) OVER k AS vals
       FROM b JOIN e USING (run) JOIN fl USING (run) WHERE i < e WINDOW k AS (PARTITION BY b.run ORDER BY b.i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
 g AS (SELECT run, min(i) AS s FROM w WHERE c = 5 AND span >= 4 AND med > fl AND sd / med <= 0.15e0 AND fps BETWEEN med * (1 - 0.15e0) AND med * (1 + 0.15e0)
       AND len(list_filter(vals, lambda v: v BETWEEN med * (1 - 0.15e0) AND med * (1 + 0.15e0))) >= 4 GROUP BY run),
 h AS (SELECT run, min(i) AS s FROM w WHERE fps >= fl GROUP BY run),
 n AS (SELECT run, count(*) AS n, max(t) - min(t) AS dur FROM fps_history GROUP BY run),
 o AS (SELECT n.run, n, CASE WHEN n < 5 THEN 0 WHEN dur < 20 THEN least(2, n - 1) ELSE coalesce(g.s, h.s, 0) END AS s, CASE WHEN n < 5 OR dur < 20 THEN n ELSE e END AS e
       FROM n JOIN e USING (run) LEFT JOIN g ON g.run = n.run LEFT JOIN h ON h.run = n.run),
 region AS (SELECT run, n, CAST(s AS BIGINT) AS "start", CAST(greatest(s + 1, e) AS BIGINT) AS "end" FROM o) """


@query(STABLE_SQL + 'SELECT run, n, "start", "end" FROM region UNION ALL SELECT 99, 0, 0, 0', "fps_history")
def stable_region(spark, sf):
    history = view(spark, sf, "fps_history")
    runs = history.select("run").distinct().unionByName(spark.sql("SELECT CAST(99 AS BIGINT) AS run"))
    return S.stable_region(history, runs)


@query(
    STABLE_SQL + 'SELECT f.run, min(fps) AS fps_min, round(avg(fps), 6) AS fps_mean, max(fps) AS fps_max, arg_min(t, {\'a\': -fps, \'b\': t}) AS t_max, arg_min(t, {\'a\': fps, \'b\': t}) AS t_min FROM fps_history AS f JOIN region AS r ON r.run = f.run AND i >= r."start" AND i < r."end" GROUP BY f.run',
    "fps_history",
)
def stable_fps_stats(spark, sf):
    history = view(spark, sf, "fps_history")
    return _rounded(S.stable_fps_stats(history, S.stable_region(history)), "fps_mean")


@query(
    "WITH s AS (SELECT *, max(CASE WHEN kind = 'ingest' THEN source_idx END) OVER (PARTITION BY stream_id ORDER BY t, CASE WHEN kind = 'ingest' THEN 0 ELSE 1 END, source_idx ROWS UNBOUNDED PRECEDING) AS top FROM stale_events) "
    "SELECT stream_id, source_idx, greatest(0, coalesce(top, source_idx) - source_idx) AS stale_frames, greatest(0, coalesce(top, source_idx) - source_idx) * 1000e0 / (CASE WHEN fps > 0 THEN fps ELSE 30e0 END) AS stale_ms FROM s WHERE kind = 'emit'",
    "stale_events",
)
def staleness(spark, sf):
    return S.staleness(view(spark, sf, "stale_events"))


BACKLOG_SQL = (
    "WITH l AS (SELECT stream_id, t, CASE WHEN kind = 'arrival' THEN 'dispatch' ELSE 'emit' END AS kind, source_idx FROM arrivals), "
    "g AS (SELECT *, CAST(sum(CASE WHEN kind = 'dispatch' THEN 1 ELSE -1 END) OVER (PARTITION BY stream_id ORDER BY t, kind, source_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS backlog FROM l) "
)


def _log(spark, sf):
    return S.dispatch_backlog(view(spark, sf, "arrivals").withColumn("kind", F.when(F.col("kind") == "arrival", "dispatch").otherwise("emit")))


@query(BACKLOG_SQL + "SELECT stream_id, t, kind, source_idx, backlog FROM g", "arrivals")
def dispatch_backlog(spark, sf):
    return _log(spark, sf)


@query(
    BACKLOG_SQL + "SELECT stream_id, CAST(t // 250 AS BIGINT) AS bin, arg_max(t, {'t': t, 'k': kind, 's': source_idx}) AS t, arg_max(backlog, {'t': t, 'k': kind, 's': source_idx}) AS backlog FROM g GROUP BY stream_id, t // 250",
    "arrivals",
)
def queue_depth_sample(spark, sf):
    return S.queue_depth_samples(_log(spark, sf))


def _emitted(spark, sf):
    frames = view(spark, sf, "frames")
    results = frames.selectExpr("source_idx AS frame_idx", "t_ms + 40 + source_idx % 13 AS result_ms")
    known = frames.filter("source_idx % 10 > 0").selectExpr("source_idx AS frame_idx", "source_idx * 2 AS source_idx", "t_ms AS dispatch_ms", "source_idx % 5 AS backlog")
    dropped = frames.filter("source_idx % 7 = 3").selectExpr("source_idx AS frame_idx")
    return S.emission(results, known, dropped)


@query(
    "WITH d AS (SELECT source_idx AS frame_idx FROM frames WHERE source_idx % 7 = 3), r AS (SELECT source_idx AS frame_idx, t_ms + 40 + source_idx % 13 AS result_ms FROM frames), "
    "k AS (SELECT source_idx AS frame_idx, source_idx * 2 AS source_idx, t_ms AS dispatch_ms, source_idx % 5 AS backlog FROM frames WHERE source_idx % 10 > 0) "
    "SELECT r.frame_idx, coalesce(k.source_idx, r.frame_idx) AS source_idx, CAST(coalesce(k.backlog, 0) AS BIGINT) AS dispatch_backlog, CAST(r.result_ms - k.dispatch_ms AS DOUBLE) AS dispatch_to_result_ms "
    "FROM r LEFT JOIN k ON k.frame_idx = r.frame_idx WHERE r.frame_idx NOT IN (SELECT frame_idx FROM d) ORDER BY r.frame_idx LIMIT 500",
    "frames",
)
def ordered_emit(spark, sf):
    return S.ordered(_emitted(spark, sf), limit=500)


@query(
    "WITH d AS (SELECT source_idx AS frame_idx FROM frames WHERE source_idx % 7 = 3), r AS (SELECT source_idx AS frame_idx, t_ms + 40 + source_idx % 13 AS result_ms FROM frames), "
    "k AS (SELECT source_idx AS frame_idx, source_idx * 2 AS source_idx, t_ms AS dispatch_ms, source_idx % 5 AS backlog FROM frames WHERE source_idx % 10 > 0) "
    "SELECT r.frame_idx, coalesce(k.source_idx, r.frame_idx) AS source_idx, CAST(coalesce(k.backlog, 0) AS BIGINT) AS dispatch_backlog, CAST(r.result_ms - k.dispatch_ms AS DOUBLE) AS dispatch_to_result_ms "
    "FROM r LEFT JOIN k ON k.frame_idx = r.frame_idx WHERE r.frame_idx NOT IN (SELECT frame_idx FROM d) ORDER BY r.frame_idx",
    "frames",
)
def ordered_emit_all(spark, sf):
    return S.ordered(_emitted(spark, sf))


def _policy_sql(policy: str, cap: int) -> str:
    """The replay as a recursion over each stream's events. State: next frame to emit, frames dispatched, and lists of live and done frames."""
    newest = policy == "drop_newest"
    # an eviction takes the least live frame; the emission point then moves to the least frame that is live, or to the end
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT stream_id, t, kind, source_idx, row_number() OVER (PARTITION BY stream_id ORDER BY t, CASE WHEN kind = 'completion' THEN 0 ELSE 1 END, source_idx) AS n FROM arrivals),
     s AS (
       SELECT stream_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS d, CAST([] AS BIGINT[]) AS live, CAST([] AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS t, CAST([] AS STRUCT(src BIGINT, what VARCHAR)[]) AS outs FROM (SELECT DISTINCT stream_id FROM o) AS q
       UNION ALL
       SELECT stream_id, n, d, CASE WHEN dead THEN list_filter(live2, lambda x: x <> gone) ELSE live2 END, list_filter(held2, lambda x: NOT list_contains(fin, x)), t,
              CASE WHEN gone IS NOT NULL THEN [{{'src': gone, 'what': 'evicted'}}] ELSE CAST([] AS STRUCT(src BIGINT, what VARCHAR)[]) END || list_transform(fin, lambda x: {{'src': x, 'what': 'emitted'}}) || CASE WHEN lost THEN [{{'src': src, 'what': 'dropped'}}] ELSE CAST([] AS STRUCT(src BIGINT, what VARCHAR)[]) END
       FROM (
         SELECT *, gone IS NOT NULL AS dead,
                list_filter(held2, lambda x: coalesce(list_min(list_filter(live2, lambda y: y <> coalesce(gone, -1) AND (NOT admitted OR y <> src))) > x, true)) AS fin
         FROM (
           SELECT *, CASE WHEN admitted THEN list_append(live1, src) ELSE live1 END AS live2, CASE WHEN hit THEN list_sort(list_append(held, src)) ELSE held END AS held2
           FROM (
             SELECT *, CASE WHEN hit THEN list_filter(live, lambda x: x <> src) ELSE live END AS live1, arr AND (NOT full_ OR gone IS NOT NULL) AS admitted, arr AND full_ AND gone IS NULL AS lost
             FROM (
               SELECT *, {'NULL::BIGINT' if newest else 'CASE WHEN arr AND full_ THEN list_min(live) END'} AS gone
               FROM (
                 SELECT s.stream_id, o.n, s.d, s.live, s.held, o.t, o.source_idx AS src, o.kind = 'arrival' AS arr, o.kind = 'completion' AND list_contains(s.live, o.source_idx) AS hit, len(s.live) + len(s.held) >= {cap} AS full_
                 FROM s JOIN o ON o.stream_id = s.stream_id AND o.n = s.n + 1) AS a) AS b) AS c) AS e) AS f)
     SELECT stream_id, u.src AS source_idx, u.what AS outcome, t FROM (SELECT stream_id, t, unnest(outs) AS u FROM s) AS z"""


def _replayed(spark, sf, policy, cap):
    return P.replay(view(spark, sf, "arrivals"), policy, cap).select("stream_id", "source_idx", "outcome", "t")


@query(_policy_sql("drop_newest", 4), "arrivals")
def drop_newest(spark, sf):
    return _replayed(spark, sf, "drop_newest", 4)


@query(_policy_sql("drop_oldest", 4), "arrivals")
def drop_oldest(spark, sf):
    return _replayed(spark, sf, "drop_oldest", 4)


@query(_policy_sql("latest_only", 1), "arrivals")
def latest_only(spark, sf):
    return _replayed(spark, sf, "latest_only", 64)


MESSAGE_SQL = """WITH p AS (SELECT seq, device, line, string_split(trim(line), '|') AS a FROM messages),
 q AS (SELECT *, CAST(least(len(a), 5) AS INT) AS fields, TRY_CAST(a[1] AS BIGINT) AS f, TRY_CAST(a[2] AS DOUBLE) AS b, TRY_CAST(a[3] AS DOUBLE) AS c, TRY_CAST(a[4] AS DOUBLE) AS d, TRY_CAST(TRY_CAST(a[least(len(a), 5)] AS JSON) AS DOUBLE[][]) AS x FROM p),
 m AS (SELECT seq, device, line, fields, CASE fields WHEN 2 THEN 0e0 ELSE b END AS total, CASE fields WHEN 5 THEN c WHEN 3 THEN b ELSE 0e0 END AS inference, CASE fields WHEN 5 THEN d ELSE 0e0 END AS nms, f, x,
        coalesce(fields IN (2, 3, 5) AND f IS NOT NULL AND x IS NOT NULL AND (fields = 2 OR b IS NOT NULL) AND (fields <> 5 OR (c IS NOT NULL AND d IS NOT NULL)), false) AS good FROM q) """


@query(
    MESSAGE_SQL + "SELECT seq, fields, CASE WHEN good THEN f ELSE -1 END AS frame_idx, CASE WHEN good THEN total END AS total, CASE WHEN good THEN inference END AS inference, CASE WHEN good THEN nms END AS nms, CAST(CASE WHEN good THEN len(x) ELSE -1 END AS INT) AS n_boxes, NOT good AS malformed FROM m",
    "messages",
)
def parse_messages(spark, sf):
    rows = view(spark, sf, "messages").select("seq", text.parsed_message(F.col("line")).alias("m")).select("seq", "m.*")
    numbers = {"frame_idx": F.coalesce("frame_idx", F.lit(-1)), "n_boxes": F.when(F.col("boxes").isNotNull(), F.size("boxes")).otherwise(-1)}
    return rows.withColumns(numbers).drop("boxes")


@query(
    MESSAGE_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY seq) AS k FROM m WHERE NOT good) SELECT device, count(*) AS n, string_agg(line, '~' ORDER BY seq) FILTER (WHERE k <= 5) AS first_lines FROM r GROUP BY device",
    "messages",
)
def malformed_by_device(spark, sf):
    rows = view(spark, sf, "messages").withColumn("malformed", text.parsed_message(F.col("line"))["malformed"])
    return M.malformed_by_device(rows).select("device", "n", F.array_join("first_lines", "~").alias("first_lines"))


@query(
    "SELECT frame_idx, concat(CAST(frame_idx AS VARCHAR), '|', format('{:.6f}', conf), '|', format('{:.6f}', conf / 3e0), '|', format('{:.6f}', conf / 7e0), '|[[', CAST(x1 AS VARCHAR), ', ', CAST(y1 AS VARCHAR), ', ', CAST(x2 AS VARCHAR), ', ', CAST(y2 AS VARCHAR), ', ', CAST(conf AS VARCHAR), ', ', CAST(cls AS VARCHAR), ']]') AS line FROM detections",
    "detections",
)
def encode_messages(spark, sf):
    box = F.array(F.struct(*D.BOX))
    return view(spark, sf, "detections").select("frame_idx", text.encoded_message(F.col("frame_idx"), F.col("conf"), F.col("conf") / 3, F.col("conf") / 7, box).alias("line"))


@query(
    "WITH n AS (SELECT l_orderkey AS frame_idx, CAST(count(*) AS INT) AS n_patches FROM lineitem GROUP BY l_orderkey), p AS (SELECT *, CAST(unnest(range(0, n_patches)) AS INT) AS patch_id FROM n) "
    "SELECT frame_idx, patch_id, CAST(patch_id // 8 AS INT) AS batch, CAST(patch_id % 8 AS INT) AS slot, CAST(CASE WHEN patch_id // 8 = (n_patches - 1) // 8 THEN (8 - n_patches % 8) % 8 ELSE 0 END AS INT) AS padding FROM p",
)
def batch_assign(spark, sf):
    counts = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("frame_idx")).agg(F.count("*").cast("int").alias("n_patches"))
    patches = counts.select("frame_idx", "n_patches", F.explode(F.sequence(F.lit(0), F.col("n_patches") - 1)).alias("patch_id"))
    return D.batch_assign(patches, 8).select("frame_idx", "patch_id", "batch", "slot", "padding")


# Pixels, a streaming query and a document.


def _pixel_frames(spark, sf):
    """Small frames made from events: a bright square of 32 pixels on black. Events are dealt to all cores first: a file of a few MB of them makes a GB of pixels."""
    frames = view(spark, sf, "frames").repartition(4 * spark.sparkContext.defaultParallelism, "source_idx").selectExpr("source_idx", "CAST(96 + source_idx % 3 * 32 AS INT) AS w", "CAST(64 + source_idx % 2 * 32 AS INT) AS h", "3 AS channels")
    grid = frames.selectExpr("*", "CAST(source_idx * 16 % (w - 32) div 16 * 16 AS INT) AS x", "CAST(source_idx * 48 % (h - 32) div 16 * 16 AS INT) AS y")
    black, bright = "repeat(char(0), 3 * {0})", "repeat(CAST(X'E0' AS STRING), 96)"  # by bytes; no string of hex digits is made
    lit = f"concat({black.format('x')}, {bright}, {black.format('(w - x - 32)')})"
    data = f"CAST(concat({black.format('w * y')}, repeat({lit}, 32), {black.format('w * (h - y - 32)')}) AS BINARY)"
    return grid.selectExpr("source_idx", "w", "h", "channels", f"{data} AS data")


@query(
    "WITH g AS (SELECT source_idx, CAST(96 + source_idx % 3 * 32 AS INT) AS w, CAST(64 + source_idx % 2 * 32 AS INT) AS h FROM frames), "
    "c AS (SELECT source_idx, source_idx * 16 % (w - 32) // 16 * 16 AS x, source_idx * 48 % (h - 32) // 16 * 16 AS y FROM g), o AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 16), (2, 16, 0), (3, 16, 16)) AS v(rank, dx, dy)) "
    "SELECT source_idx AS frame_idx, rank, CAST(x + dx AS DOUBLE) AS x1, CAST(y + dy AS DOUBLE) AS y1, CAST(x + dx + 16 AS DOUBLE) AS x2, CAST(y + dy + 16 AS DOUBLE) AS y2, 224e0 / 255e0 AS conf, CAST(0 AS INT) AS cls FROM c, o",
    "frames",
)
def detect_images(spark, sf):
    """Boxes of small frames made from events."""
    from frametide.detector import BrightBlocks
    from frametide.plans.detect import detect
    from frametide.settings import Settings

    frames = _pixel_frames(spark, sf).withColumnRenamed("source_idx", "frame_idx")
    return detect(frames, BrightBlocks(), Settings(patch_size=64, min_overlap=16), key="frame_idx")


@query(
    "WITH g AS (SELECT source_idx, CAST(96 + source_idx % 3 * 32 AS INT) AS w, CAST(64 + source_idx % 2 * 32 AS INT) AS h FROM frames), "
    "c AS (SELECT source_idx, w, h, source_idx * 16 % (w - 32) // 16 * 16 AS x, source_idx * 48 % (h - 32) // 16 * 16 AS y FROM g), o AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 16), (2, 16, 0), (3, 16, 16)) AS v(rank, dx, dy)) "
    "SELECT source_idx AS frame_idx, rank, CAST(x + dx AS DOUBLE) AS x1, CAST(y + dy AS DOUBLE) AS y1, CAST(x + dx + 16 AS DOUBLE) AS x2, CAST(y + dy + 16 AS DOUBLE) AS y2, 224e0 / 255e0 AS conf, CAST(0 AS INT) AS cls FROM c, o",
    "frames",
)
def detect_images_global(spark, sf):
    """The same with the whole frame as one more patch: at a size of one block nothing of it is bright enough, so the boxes are those of the patches."""
    from frametide.detector import BrightBlocks
    from frametide.plans.detect import detect
    from frametide.settings import Settings

    frames = _pixel_frames(spark, sf).withColumnRenamed("source_idx", "frame_idx")
    return detect(frames, BrightBlocks(), Settings(patch_size=64, min_overlap=16, global_context=True, global_size=16), key="frame_idx")


def _streamed(spark, sf, policy):
    """The admission policy as a streaming query over the event log, drained."""
    import uuid

    from frametide.scratch import shared_folder
    from frametide.streaming.admission import admit

    base = f"{shared_folder(spark)}/admission-{uuid.uuid4().hex}"
    events = view(spark, sf, "arrivals")
    events.write.parquet(f"{base}/events")
    live = spark.readStream.schema(events.schema).parquet(f"{base}/events")
    q = admit(live, policy, 4).writeStream.option("checkpointLocation", f"{base}/state").format("parquet").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return spark.read.schema(P.OUTCOME).parquet(f"{base}/out").select("stream_id", "source_idx", "outcome", "t")


@query(_policy_sql("drop_oldest", 4), "arrivals")
def stream_admission(spark, sf):
    return _streamed(spark, sf, "drop_oldest")


@query(_policy_sql("drop_newest", 4), "arrivals")
def stream_admission_newest(spark, sf):
    return _streamed(spark, sf, "drop_newest")


@query(_policy_sql("latest_only", 1), "arrivals")
def stream_admission_latest(spark, sf):
    return _streamed(spark, sf, "latest_only")


@query(None)
def latency_trace_document(spark, sf):
    """The trace of a run as one JSON document; its counters are the sums over all parts of the run."""
    sums = [F.sum(c).alias(c) for c in ("frames_seen", "frames_written", "frames_dropped")]
    queue = view(spark, sf, "queue_runs").agg(*sums, F.max("input_fps_cap").alias("input_fps_cap"), F.max("loader_fps").alias("loader_fps"))
    named = queue.selectExpr("*", "true AS bounded_latency", "4 AS max_in_flight", "'drop_oldest' AS drop_policy")
    return M.latency_trace_document(view(spark, sf, "latency"), M.queue_control(named))
