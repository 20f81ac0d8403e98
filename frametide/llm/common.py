"""Shared pieces of the corpus operators: scratch tables, word splitting, let-bindings."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.scratch import deleted, shared_folder

#: ASCII white space, as the contracts of the quality rules and SimHash define words.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: What separates words for exact phrase search: every ASCII character but digits and lower-case letters.
PHRASE_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows that a Python worker is handed at once. A batch of texts lies in the JVM's and the worker's memory, more than once in either.
BATCH_ROWS = 1000

_LOCAL = threading.local()


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``. When a task of it ends, what its worker has freed goes back to the system: workers live on beside later stages."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped


def released() -> None:
    """Give the system what Python, Arrow and the C library hold of freed memory, where the library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/frametide/{name}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].append(path)
    return path


def _scopes() -> list[list[str]]:
    """Of this thread: queries that run side by side don't delete each other's tables."""
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are made inside are deleted at the end; what is to outlive it is written elsewhere or before."""
    _scopes().append([])
    try:
        yield
    finally:
        dropped(spark, *_scopes().pop())


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands at most ``BATCH_ROWS`` rows at once to Python workers; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts lineage, survives lost executors and gives Catalyst the table's true size, so that it broadcasts a side
    only when that is small. Also returns the path, for :func:`dropped`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    deleted(spark, *paths)


def stretches(text, size: int, spaces) -> Iterator:
    """``text`` (str or bytes) in parts of about ``size``, cut before white space, so that no word is cut.

    ``spaces``: a compiled pattern of one white-space character. A stretch without any runs on to the next one.
    """
    at = 0
    while len(text) - at > size:
        cut = spaces.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the fast way and right for pure ASCII; other texts are translated."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def phrase_words(text: Column) -> Column:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PHRASE_BREAK), "")


def indices(array: Column) -> Column:
    """0 .. size-1; empty for an empty array (``sequence`` alone would count down)."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
