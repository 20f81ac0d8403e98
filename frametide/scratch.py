"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="frametide-")
    return _OWN[context.applicationId]


def deleted(spark: SparkSession, *paths: str) -> None:
    """Delete folders of any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean_own() -> None:
    for path in _OWN.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
