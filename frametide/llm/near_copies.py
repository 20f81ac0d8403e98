"""Near copies by exact similarity of five-word shingles.

Two documents are near copies if the Jaccard similarity of their sets of ``SHINGLE``-word shingles is ``SIMILAR`` or more, and
components of them belong together. Candidates are found by the Golay links of SimHash fingerprints (:mod:`frametide.llm.simhash`); as
most pairs near the threshold differ in more bits than these reach, texts that share a band of ``ROWS`` minimum hashes are candidates
too. With ``BANDS`` bands a pair at the threshold itself is missed with a chance of 1.3 in 10^7, and a more similar one with less. Each
link rests on an exact comparison of both sets, but for pairs whose sizes or odd sketches alone rule the similarity out:

* first, of each link between fingerprints, a text of either, and each text with one of its own fingerprint; further
  each document with the first of its bucket and with the ``BACK`` before it. That is linear in links and buckets;
* then, in buckets that hold documents of different components, all pairs across these. So of two candidates either both
  are in one component already or they are compared, and no size of a bucket cuts anything off. They are compared by their
  sizes and odd sketches, in arrays, and only a pair that these leave possible becomes a row. An odd sketch has the parity of the
  number of a set's hashes in each of ``CELLS`` cells; sketches differ in no more cells than the sets differ in hashes, so
  that no similar pair is lost. A bucket of more than ``BLOCK`` documents is dealt to tasks as pairs of blocks. That bounds a task,
  while the comparisons of arrays still grow with the square of what a bucket holds apart.

Defined results: words are separated by ASCII white space and lower-cased in ASCII; fewer words than a shingle give one shingle
of all words; null, empty and wordless texts are copies of each other; ids as in :mod:`frametide.llm.simhash`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametide.llm import simhash
from frametide.llm.common import frugal, scratch_path, scratch_scope, stretches, written
from frametide.llm.components import components
from frametide.llm.simhash import fingerprint

SHINGLE = 5
#: Similarity from which two documents are near copies, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 40, 5
#: Earlier documents of its bucket that each is compared with at first. What that leaves apart is compared in full.
BACK = 2
SEED = 5
#: Bytes of a text that are split into words at once.
STRETCH = 1 << 20
#: Cells of an odd sketch, and documents of a bucket that one task compares with as many others.
CELLS, BLOCK = 1024, 16_384
#: Shingles that are hashed at once, and pairs that are compared at once.
CHUNK, PAIRS = 2048, 1 << 16
SPACE = re.compile(rb"[\t-\r ]")


def shingle_hashes(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles, a stretch at a time; they may repeat."""
    import xxhash

    digest, carried, found = xxhash.xxh64_intdigest, [], False
    for part in stretches((text or "").encode("utf-8", "surrogatepass").lower(), STRETCH, SPACE):
        words = carried + part.split()
        if len(words) < SHINGLE:
            carried = words
            continue
        found = True
        yield np.array([digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(len(words) - SHINGLE + 1)], dtype=np.uint64)
        carried = words[1 - SHINGLE :]
    if carried and not found:
        yield np.array([digest(b" ".join(carried), SEED)], dtype=np.uint64)


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def distinct(text: str | None) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text)]))


def band_keys(texts: Iterator[str | None]) -> np.ndarray:
    """One key for each band, by text: ``(n, BANDS)`` signed longs."""
    factors = _factors(BANDS * ROWS)[:, None]
    least = []
    for text in texts:
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
        hashes = distinct(text)
        for at in range(0, len(hashes), CHUNK):
            np.minimum(low, (factors * hashes[None, at : at + CHUNK]).min(axis=1), out=low)
        least.append(low)
    mixed = np.array(least, dtype=np.uint64).reshape(-1, BANDS, ROWS) >> np.uint64(1)
    key = (mixed * _factors(BANDS * ROWS + ROWS)[-ROWS:]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _factors(1)
    key = (key ^ (key >> np.uint64(32))) * _factors(1)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            keys = band_keys(x.as_py() for x in part.column(2))
            prints = np.fromiter((fingerprint(x.as_py()) for x in part.column(2)), dtype=np.uint64, count=len(part))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints.view(np.int64)), _lists(list(keys))], names=["doc_id", "node", "fp", "keys"])


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of the number of distinct hashes in each cell, as the bits of signed longs."""
    cells = (hashes >> np.uint64(32)) % np.uint64(CELLS)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=CELLS).astype(np.uint8) & 1).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            rows = [distinct(x.as_py()) for x in part.column(1)]
            sizes = pa.array([len(x) for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, _lists([odd_sketch(x) for x in rows]), _lists([x.view(np.int64) for x in rows])], names=["node", "size", "odd", "shingles"])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in key order: each with the first of its key and the ``BACK`` before it."""
    key0, node0, pivot_key, pivot0 = np.empty(0, np.int64), np.empty(0, np.int64), None, None
    for batch in batches:
        if not len(batch):
            continue
        key = np.concatenate((key0, batch.column(0).to_numpy(zero_copy_only=False)))
        node = np.concatenate((node0, batch.column(1).to_numpy(zero_copy_only=False)))
        starts = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))
        pivot = node[start]
        if key[0] == pivot_key:
            pivot[start == 0] = pivot0
        i = np.arange(len(key0), len(key))
        a, b = [pivot[i]], [node[i]]
        for back in range(1, BACK + 1):
            j = i[i >= back]
            j = j[key[j] == key[j - back]]
            a.append(node[j - back])
            b.append(node[j])
        a, b = np.concatenate(a), np.concatenate(b)
        yield _pairs(a[a != b], b[a != b])
        pivot_key, pivot0 = key[-1], pivot[-1]
        key0, node0 = key[-BACK:], node[-BACK:]


def _possible(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where sets of ``n`` hashes with sketches ``x`` may be similar to those of ``m`` with ``y``, as a matrix."""
    part, whole = SIMILAR
    n, m = n[:, None], m[None, :]
    apart = np.bitwise_count((x[:, None, :] ^ y[None, :, :]).view(np.uint64)).sum(axis=2, dtype=np.int64)
    return (whole * np.minimum(n, m) >= part * np.maximum(n, m)) & ((part + whole) * apart <= (whole - part) * (n + m))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``key, low, high, root, block, node, size, odd`` in this order: the possible pairs of a key and pair of blocks whose roots differ."""

    def emit(unit: np.ndarray, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, low, high, root, block, node, size = unit
        cuts = (np.flatnonzero(root[1:] != root[:-1]) + 1).tolist()
        for start, end in zip(cuts, [*cuts[1:], len(root)]):
            step = max(1, PAIRS // start)
            for at in range(start, end, step):
                to = min(at + step, end)
                near = _possible(size[at:to], odd[at:to], size[:start], odd[:start])
                if low[0] != high[0]:
                    near &= block[at:to, None] != block[None, :start]
                i, j = np.nonzero(near)
                if len(i):
                    yield _pairs(node[at:to][i], node[j])

    held, held_odd = np.empty((7, 0), np.int64), np.empty((0, CELLS // 64), np.int64)
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)])
        odd = batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(-1, CELLS // 64)
        rows, odd = np.concatenate((held, rows), axis=1), np.concatenate((held_odd, odd))
        cuts = [0, *(np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1).tolist()]
        for start, end in zip(cuts, cuts[1:]):
            yield from emit(rows[:, start:end], odd[start:end])
        held, held_odd = rows[:, cuts[-1] :], odd[cuts[-1] :]
    yield from emit(held, held_odd)


def across(bands: DataFrame, sets: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of candidates with different roots (``of``: ``node, root``) that sizes and odd sketches leave possible."""
    keys = bands.join(of, "node").select(F.explode("keys").alias("key"), "node", "root")
    apart = keys.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    apart, _ = written(apart.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "buckets-apart")
    rows, block = keys.join(apart, "key").join(sets.select("node", "size", "odd"), "node"), F.expr("pmod(node, blocks)")
    units = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least(j, block).alias("low"), F.greatest(j, block).alias("high")))
    rows = rows.select("key", F.explode(units).alias("unit"), "root", block.alias("block"), "node", "size", "odd")
    rows = rows.select("key", "unit.low", "unit.high", "root", "block", "node", "size", "odd")
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "root", "node").mapInArrow(frugal(_across), "a long, b long").distinct()


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that the sizes and odd sketches of their sets leave possible."""
    part, whole = SIMILAR
    marks = sets.select("node", "size", "odd")
    both = pairs.join(marks.toDF("a", "n", "x"), "a").join(marks.toDF("b", "m", "y"), "b")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
    near = (whole * F.least("n", "m") >= part * F.greatest("n", "m")) & ((part + whole) * apart <= (whole - part) * (F.col("n") + F.col("m")))
    return both.filter(near).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough."""
    part, whole = SIMILAR
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    n, m = F.size("x"), F.size("y")
    return pairs.join(x, "a").join(y, "b").filter((part + whole) * F.size(F.array_intersect("x", "y")) >= part * (n + m)).select("a", "b")


def fingerprint_links(bands: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of texts (``node, fp``): each text with one of its fingerprint, and that one's with those of the linked fingerprints."""
    ones, _ = written(bands.groupBy("fp").agg(F.min("node").alias("one")), "fingerprint-texts")
    own = bands.select("fp", F.col("node").alias("x")).join(ones.withColumnRenamed("one", "y"), "fp").filter("x <> y")
    near = simhash.links(ones.select("fp")).join(ones.toDF("a", "x"), "a").join(ones.toDF("b", "y"), "b")
    return own.select("x", "y").unionByName(near.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def roots(texts: DataFrame, bands: DataFrame) -> DataFrame | None:
    """``node, root`` of the texts (``node, text``; ``bands``: ``node, first, fp, keys``, nodes distinct) that have a near copy."""
    keys = bands.select(F.explode("keys").alias("key"), "node", "first")
    neighbours = keys.repartition("key").sortWithinPartitions("key", "first", "node").mapInArrow(frugal(_neighbours), "a long, b long")
    near, _ = written(fingerprint_links(bands).unionByName(neighbours).distinct(), "candidates")
    paired, _ = written(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidate-nodes")
    if paired.isEmpty():
        return None
    sets, _ = written(texts.dropDuplicates(["node"]).join(paired, "node", "left_semi").select("node", "text").mapInArrow(frugal(_sets), "node long, size long, odd array<long>, shingles array<long>"), "shingle-sets")
    links, _ = written(verified(written(possible(near, sets), "candidates-possible")[0], sets), "near-links")
    first = components(links)
    of = paired.join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    rest, _ = written(across(bands, sets, of), "candidates-across")
    more, _ = written(verified(rest, sets), "links-across")
    return first if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, component_id, text_hash`` per document; ``component_id`` is the smallest id of its near copies."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("node"), F.col(text).alias("text"))
    path = scratch_path(spark, "near-copy-ids")
    with scratch_scope(spark):
        found = slim.mapInArrow(frugal(_bands), "doc_id long, node long, fp long, keys array<long>").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
        bands, _ = written(found, "bands")
        of = roots(slim.select("node", "text"), bands)
        ids = bands.select("node", "first")
        if of is not None:
            of = of.join(ids, "node")
            least = of.groupBy("root").agg(F.min("first").alias("least"))
            ids = ids.join(of.join(least, "root").select("node", "least"), "node", "left").select("node", F.coalesce("least", "first").alias("first"))
        ids.withColumnRenamed("first", "component_id").write.parquet(path)
    ids = spark.read.schema("node long, component_id long").parquet(path)
    return slim.select("doc_id", "node").join(ids, "node").select("doc_id", "component_id", F.col("node").alias("text_hash"))
