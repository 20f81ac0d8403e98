"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (21, 21 and 22 bits, padded to 23). The perfect binary (23, 12) Golay code
decodes a segment and each of its one-bit neighbours to codeword indices, one or six per segment; two segments that differ
in at most two bits always share an index. Of at most four differing bits, pigeonhole leaves two cases:

* no segment has more than two: the pair shares an index in every segment, so the key is the triple of indices;
* a segment has three or four: another is equal and the third differs in at most one bit, so the key is the equal
  segment with an index of the third.

Rows with equal keys are compared exactly as they stream by in key order, whole arrays at a time; within a stretch of rows those already
linked are compared no more than is needed to see it, and only a spanning forest of links is sent on. Where a bucket is larger
than ``BUCKET``, its fingerprints are instead linked by balls: each gives its 2,081 neighbours within two bits, and two fingerprints
differ in at most four bits just if they share one. Of those that share a neighbour only consecutive ones are linked, which keeps
components whole and the links linear in the bucket. Equal fingerprints are merged before anything is compared.

``BUCKET`` stands where a comparison of a whole bucket, at about a nanosecond a pair, costs as much as the 2,081 rows of a ball. The
commonest keys have 36 bits, so the mean bucket has 65 rows at 3 * 10^10 distinct fingerprints and would reach ``BUCKET`` at 7 * 10^12:
at any size that documents come in, balls are for dense groups alone.

Defined results: null, empty or wordless texts have fingerprint zero; fewer words than a shingle give one shingle of all
words; a null document id takes no part in the smallest id (a component of nulls alone has a null id); repeated rows are
each returned; a very long text is hashed a stretch at a time; of equally small ids either names the component; an empty table
gives an empty table; other columns, whatever their names, are not read by :func:`near_duplicates` and pass through :func:`keep_one`.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm.common import free_name, frugal, scratch_path, scratch_scope, stretches, table, written
from frametide.llm.components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Bytes of a text that are split into words at once.
STRETCH = 1 << 20
SPACE = re.compile(rb"[\t-\r ]")
#: Larger buckets are linked by balls. It bounds the comparisons per row, not what is found.
BUCKET = 16_384
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The text is hashed a stretch at a time, with the last words of one carried into the next."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    total, n, carried = np.zeros(64, dtype=np.int64), 0, []
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    for part in stretches(raw, STRETCH, SPACE):
        words = carried + part.split()
        if len(words) < shingle:  # at the end of a short text, or of a stretch of white space
            carried = words
            continue
        joined = b" ".join(words)
        ends = [e + i for i, e in enumerate(itertools.accumulate(map(len, words)))]
        starts = [0, *(e + 1 for e in ends[:-1])]
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        carried = words[-(shingle - 1) :] if shingle > 1 else []
    if not n and carried:
        total += np.unpackbits(np.array([digest(b" ".join(carried), SEED)], dtype="<u8").view(np.uint8), bitorder="little")
        n = 1
    return int(np.left_shift(np.uint64(1), np.flatnonzero(2 * total > n).astype(np.uint64)).sum(dtype=np.uint64)) if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=len(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word, and the error of at most three bits for each syndrome."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    bits = [remainder(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= bits[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= bits[12 + i]
    errors = np.zeros(1 << 11, np.int64)
    for n in (1, 2, 3):
        for at in itertools.combinations(range(23), n):
            s = 0
            for i in at:
                s ^= bits[i]
            errors[s] = sum(1 << i for i in at)
    return low, high, errors


def indices_near(segment: np.ndarray, tables=None) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each word and its 23 neighbours: sorted (n, 24) and a mask of the first of each value."""
    low, high, errors = tables or _golay_tables()
    near = segment[:, None] ^ np.concatenate(([0], 1 << np.arange(23)))[None, :]
    index = (near ^ errors[low[near & 0xFFF] ^ high[near >> 12]]) >> 11
    index.sort(axis=1)
    first = np.ones(index.shape, bool)
    first[:, 1:] = index[:, 1:] != index[:, :-1]
    return index, first


def _compact(index: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices in at most six columns, and how many."""
    order = np.argsort(~first, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(index, order, axis=1), first.sum(axis=1)


def fuzzy_keys(fp: np.ndarray, tables=None) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: every key of every fingerprint (int64, any order)."""
    tables = tables or _golay_tables()
    bits = fp.view(np.uint64)
    segments = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [_compact(*indices_near(s, tables)) for s in segments]
    rows, keys = [], []
    six = np.arange(6)
    for i, j in itertools.permutations(range(3), 2):
        index, n = near[j]
        r, k = np.nonzero(six[None, :] < n[:, None])
        rows.append(r)
        keys.append((i * 3 + j + 1) << 40 | segments[i][r] << 12 | index[r, k])
    (i0, n0), (i1, n1), (i2, n2) = near
    mask = (six[:, None, None] < n0[:, None, None, None]) & (six[None, :, None] < n1[:, None, None, None]) & (six[None, None, :] < n2[:, None, None, None])
    r, x, y, z = np.nonzero(mask)
    rows.append(r)
    keys.append(i0[r, x] << 24 | i1[r, y] << 12 | i2[r, z])
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _golay_tables()
    for batch in batches:
        for at in range(0, len(batch), 1024):
            fp = batch.column(0).slice(at, 1024).to_numpy(zero_copy_only=False).astype(np.int64)
            row, key = fuzzy_keys(fp, tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in itertools.combinations(range(64), 2))]
    masks = np.array(flips, dtype=np.uint64).view(np.int64)
    for batch in batches:
        for at in range(0, len(batch), 64):
            fp = batch.column(0).slice(at, 64).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ masks[None, :]).ravel()), pa.array(np.repeat(fp, len(masks)))], names=["key", "fp"])


def _runs(batches: Iterator[pa.RecordBatch], carry: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Key and fingerprint columns of rows in key order, each with the last ``carry`` rows before it; how many those are."""
    key0, fp0 = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        key = np.concatenate((key0, batch.column(0).to_numpy(zero_copy_only=False)))
        fp = np.concatenate((fp0, batch.column(1).to_numpy(zero_copy_only=False)))
        yield key, fp, len(key0)
        key0, fp0 = key[-carry:], fp[-carry:]


class _Forest:
    """Lets through only links that join what earlier ones have not: a spanning forest in place of all pairs.

    It holds the fingerprints that it has linked and starts afresh beyond ``HELD``, after which links may repeat.
    """

    HELD = 500_000

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (y := up.get(r, r)) != r:
            r = y
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def spanning(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        if len(self.up) > self.HELD:
            self.up.clear()
        kept = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                kept.append((x, y))
        return kept


def _spanning(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links of rows ``x`` and ``y`` that join two groups; ``group`` is brought up to date."""
    up: dict[int, int] = {}

    def root(g: int) -> int:
        while (h := up.get(g, g)) != g:
            up[g] = up.get(h, h)
            g = h
        return g

    kept = []
    for k, (p, q) in enumerate(zip(group[x].tolist(), group[y].tolist())):
        p, q = root(p), root(q)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append(k)
    old = np.array(sorted(up), dtype=np.int64)
    into = np.arange(len(group))
    into[old] = [root(g) for g in old.tolist()]
    group[:] = into[group]
    return x[kept], y[kept]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among equal keys, each row against the ``BUCKET`` before it; ``b`` is null for rows that have more than that."""
    forest, flagged = _Forest(), set()
    for key, fp, old in _runs(batches, BUCKET + 1):
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        group = np.arange(len(key))  # rows with one number are linked already
        i = np.arange(max(old, 1), len(key))
        for back in range(1, BUCKET + 1):
            i = i[i >= back]
            i = i[key[i] == key[i - back]]
            if not len(i):
                break
            near = (np.bitwise_count((fp[i] ^ fp[i - back]).view(np.uint64)) <= MAX_BITS) & (group[i] != group[i - back])
            if near.any():
                x = i[near]
                x, y = _spanning(group, x, x - back)
                a.append(fp[x])
                b.append(fp[y])
        large = []
        if len(i):  # rows with a full bucket of equal keys before them
            places = np.unique((i[:, None] - np.arange(BUCKET + 1)[None, :]).ravel())
            large = [x for x in np.unique(fp[places]).tolist() if x not in flagged]
            flagged.update(large)
            if len(flagged) > _Forest.HELD:
                flagged.clear()
        pairs = forest.spanning(np.concatenate(a), np.concatenate(b))
        rows = [*pairs, *((x, None) for x in large)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], names=["a", "b"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of consecutive rows with equal keys."""
    forest = _Forest()
    for key, fp, old in _runs(batches, 1):
        i = np.arange(max(old, 1), len(key))
        i = i[(key[i] == key[i - 1]) & (fp[i] != fp[i - 1])]
        pairs = forest.spanning(fp[i], fp[i - 1])
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "fp")


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``, distinct) that keep every component whole."""
    keys = prints.select("fp").mapInArrow(frugal(_key_rows), "key long, fp long")
    found, _ = written(_by_key(keys).mapInArrow(frugal(_links), "a long, b long").distinct(), "links-and-large")
    large, _ = written(found.filter("b is null").select(F.col("a").alias("fp")), "large")
    pairs = found.filter("b is not null")
    if large.isEmpty():
        return pairs
    balls = large.repartition("fp").mapInArrow(frugal(_neighbours), "key long, fp long")
    return pairs.unionByName(_by_key(balls).mapInArrow(frugal(_chains), "a long, b long"))


MEMBERS = "fp long, first long, root long"


def _members(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Each fingerprint class with the root of its component; a class without a link is its own."""
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` per document, and ``text_hash``; ``fp`` as a signed long."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    rows, _ = written(slim.mapInArrow(frugal(_fingerprints), "doc_id long, fp long, text_hash long"), "fingerprints")
    classes, _ = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    path = scratch_path(docs.sparkSession, "members")
    with scratch_scope(docs.sparkSession):
        roots = components(links(classes))
        _members(classes, roots).write.parquet(path)
    member = docs.sparkSession.read.schema(MEMBERS).parquet(path)
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    final = member.join(smallest, "root").select("fp", "component_id")
    return rows.join(final, "fp").select("doc_id", "fp", "component_id", "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", find=near_duplicates) -> DataFrame:
    """The document with the smallest id of each component that ``find`` gives, with its own columns.

    Rows that share that id and its text all stay, as do rows without an id: nothing tells which of them to prefer.
    """
    key, own = free_name(docs, "gone_id__"), free_name(docs, "gone_text__")
    found = find(docs, id_col, text)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key), F.col("text_hash").alias(own)).distinct()
    gone, _ = written(gone, "near-copies")
    return docs.join(gone, (docs[id_col].cast("long") == F.col(key)) & (F.xxhash64(docs[text]) == F.col(own)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
