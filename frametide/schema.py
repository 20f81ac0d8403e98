"""Schemas of the engine's tables."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2", "conf")] + [T.StructField("cls", T.IntegerType())])
DETECTIONS = T.StructType([T.StructField("frame_idx", T.LongType()), T.StructField("patch_id", T.IntegerType()), *BOX.fields])
FRAME_DOCUMENT = T.StructType(
    [
        T.StructField("frame_idx", T.LongType()),
        T.StructField("detections", T.ArrayType(T.StructType([T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("conf", T.DoubleType()), T.StructField("class", T.IntegerType())]))),
    ]
)
TILE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("patch_id", "x0", "y0", "x1", "y1")])
FRAME_EVENT = T.StructType(
    [T.StructField("stream_id", T.LongType()), T.StructField("t", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("source_idx", T.LongType())]
)
