"""Sharding by histogram sort.

Rows are ordered by a key of 32 hex digits: the hash of the text and then the row's place in the table, so equal texts are
neighbours. For each boundary between shards the interval of keys that must hold it is known; a pass counts exact bytes and rows below
256 candidate keys inside every open interval, and the interval shrinks to the two candidates around the wanted number of bytes.
Passes end when each boundary has a candidate within the tolerance or its interval is a single row. Then all rows are exchanged
once. What reaches the driver is 256 rows for each boundary and pass, so it depends on the number of shards alone.

A shard that is too large for one task is dealt to several by a hash of its keys, which no group of equal texts upsets; the parts'
exact row counts are a small table whose running sums are where the parts' slots begin.

A boundary stands between texts where one lies within ``TOLERANCE`` of a shard's bytes; only a group of equal texts that
is too large for that is cut, by place, so a group of a third of all rows fills as many shards as its bytes need.

Defined results: a null text has no bytes, and its checksum is that of no bytes; null ids and repeated rows are placed
like others, rows with equal texts in the order of the table; a very long text is one row of its bytes, and its shard may exceed the
others by them; shards of an empty or tiny table may be empty; other columns pass through, and names that clash get underscores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from frametide.llm.common import free_name, table, written

SHARDS = 24
#: Of a shard's mean bytes.
TOLERANCE = 0.005
#: Rows that one task sorts have about so many bytes by the size column. A larger shard is dealt to several tasks.
PART_BYTES = 256 << 20
#: Bytes that a row counts besides its text.
ROW_BYTES = 8
#: Hex digits by which an interval shrinks in a pass.
STEP = 2
DIGITS = 32
#: Above every hex digit: a boundary ``prefix + PAST`` has all keys with that prefix below it.
PAST = "G"


@dataclass
class Boundary:
    """``want`` bytes go below it. It lies among the keys with ``prefix``, which have ``below`` bytes and ``rows`` rows below them."""

    want: float
    prefix: str = ""
    below: int = 0
    rows: int = 0
    key: str | None = None


def _refine(b: Boundary, children: list[tuple[str, int, int]], tolerance: float) -> None:
    """``children``: the prefixes inside the interval with rows, in order, and their bytes and rows."""
    below, rows = b.below, b.rows
    before = (below, rows, b.prefix if not children else children[0][0])  # nothing of the interval: its first prefix alone sorts below all its keys
    for prefix, size, n in children:
        if below + size < b.want:
            below, rows = below + size, rows + n
            before = (below, rows, prefix + PAST)
            continue
        after = (below + size, rows + n, prefix + PAST)
        nearest = min(before, after, key=lambda x: abs(x[0] - b.want))
        if abs(nearest[0] - b.want) <= tolerance or n == 1 or len(prefix) == DIGITS:
            b.below, b.rows, b.key = nearest
        else:
            b.prefix, b.below, b.rows = prefix, below, rows
        return
    b.below, b.rows, b.key = before


def splitters(rows: DataFrame, wants: list[float], tolerance: float, key: str, size: str) -> list[Boundary]:
    """Boundaries for the wanted bytes, in order. The driver gets at most 256 rows for each open interval and pass."""
    found = [Boundary(w) for w in wants]
    length = 0
    while open_ := [b for b in found if b.key is None]:
        prefixes = sorted({b.prefix for b in open_})
        part = F.substring(key, 1, length + STEP).alias("p")
        inside = rows if not length else rows.filter(F.substring(key, 1, length).isin(prefixes))
        counted = inside.groupBy(part).agg(F.sum(size).alias("size"), F.count("*").alias("n")).orderBy("p").collect()
        children: dict[str, list[tuple[str, int, int]]] = {p: [] for p in prefixes}
        for r in counted:
            children[r["p"][:length]].append((r["p"], r["size"], r["n"]))
        for b in open_:
            _refine(b, children[b.prefix], tolerance)
        length += STEP
    return found


def parts_of(total: int, shards: int, part_bytes: int) -> int:
    """Tasks for each shard."""
    return max(1, math.ceil(total / shards / part_bytes))


def shard(df: DataFrame, text: str = "text", size: str | None = None, shards: int = SHARDS, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``df`` with columns ``shard`` (int) and ``slot`` (long, gapless from 0), partitioned by shard and part.

    ``size`` names a long column of bytes; else it is the text's UTF-8 bytes plus ``ROW_BYTES``. Names that ``df`` has
    already get underscores.
    """
    columns = df.columns
    key, own, shard_, part, before = (free_name(df, x) for x in ("key__", "size__", "shard__", "part__", "before__"))
    bytes_ = F.col(size) if size else F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    hashed = F.lpad(F.hex(F.xxhash64(F.col(text)) if text in columns else F.col("text_hash")), 16, "0")
    place = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    rows, _ = written(df.withColumns({key: F.concat(hashed, place), own: bytes_}), "sharding")
    total = rows.agg(F.sum(own)).first()[0] or 0
    found = splitters(rows, [total * i / shards for i in range(1, shards)], tolerance * total / shards, key, own)
    parts = parts_of(total, shards, part_bytes)
    at = F.lit(0)
    for i, b in enumerate(found, 1):  # the last boundary below the key counts
        at = F.when(F.col(key) > b.key, i).otherwise(at)
    dealt = rows.withColumns({shard_: at, part: at * parts + F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")})
    if parts == 1:
        first, sized = F.lit(0), dealt
    else:
        counts = dealt.groupBy(shard_, part).agg(F.count("*").alias("n"))
        sums = F.coalesce(F.sum("n").over(W.partitionBy(shard_).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        first, sized = F.col(before), dealt.join(written(counts.select(part, sums.alias(before)), "part-counts")[0], part)
    exchanged = sized.repartitionById(shards * parts, part)
    place_in_part = F.row_number().over(W.partitionBy(part).orderBy(key))
    return exchanged.select(*columns, F.col(shard_).alias(free_name(df, "shard")), (first + place_in_part - 1).cast("long").alias(free_name(df, "slot")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    slim = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    placed = shard(slim, size="size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
