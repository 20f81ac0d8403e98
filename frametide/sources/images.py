"""Image tables: ``path, w, h, channels, data`` (row-major bytes, blue first)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.functions.text import STREAM_PREFIXES, is_image

SCHEMA = "path string, w int, h int, channels int, data binary"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """The images of a folder (not of its subfolders), or the one image at ``path``; what can't be decoded is left out.

    Spark decodes on the executors. Results are sorted by path where they are shown, not the pixels here.
    """
    rows = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        rows = rows.filter(is_image(F.col("origin")))
    return rows.select(F.col("origin").alias("path"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("nChannels").alias("channels"), "data")


def from_array(spark: SparkSession, image: np.ndarray, path: str = "memory") -> DataFrame:
    """An image in memory as a table of one row."""
    h, w, channels = image.shape
    return spark.createDataFrame([(path, w, h, channels, bytearray(np.ascontiguousarray(image, np.uint8).tobytes()))], SCHEMA)


def shape_of(images: DataFrame) -> tuple[int, int]:
    """Width and height of the first image, from its metadata alone."""
    row = images.select("w", "h").first()
    if row is None:
        raise ValueError("the source has no frame")
    return row["w"], row["h"]


def is_stream_source(source) -> bool:
    """As :func:`frametide.functions.text.is_stream`, for one name on the driver."""
    return str(source).startswith(STREAM_PREFIXES) or str(source).isdigit()
