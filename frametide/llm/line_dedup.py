"""Line deduplication by distinct-site spread.

For each line (a text between line feeds, known by two 64-bit hashes) a HyperLogLog sketch of the sites that carry it is
merged by aggregation. Estimates clearly above ``MIN_SITES`` mark a line as boilerplate and estimates clearly below clear it;
lines in between get an exact count of distinct sites. Boilerplate lines are then removed from every document but the one
where they come first (smallest id, then earliest place), so no content is lost altogether.

Lines of fewer than ``MIN_WORDS`` words are never boilerplate: they recur by chance.

Removal moves no text: the boilerplate lines, which are counted first, are sent to the workers, who look up each document's lines in
place. Beyond ``SENT_LINES`` of them the places to remove are joined to the documents by key instead.

Defined results: a null text stays null, has no lines and loses none; an empty text stays empty; a null site is no site; a
null id comes before all others; documents that repeat id and text, and carry the first place of a line, all keep it; a
document that loses all its lines is left with an empty text; a very long text is split where it is and costs time in proportion;
a line that stands twice in the document that keeps it is kept once; empty tables give empty tables; other columns pass through, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm.common import SPACE_RUN, dropped, free_name, indices, let, table, written

MIN_SITES = 10
MIN_WORDS = 3
#: The sketch has 2^10 registers: a relative error of about 3 %, and nearly none at so few sites.
LG_K = 10
#: Estimates within this share of ``MIN_SITES`` are counted exactly: ten times the sketch's relative error.
NEAR = 0.35
#: Boilerplate lines that are sent to the workers at most: 32 bytes each, and so 64 MB.
SENT_LINES = 2_000_000
#: Of Spark's ``xxhash64``.
SEED = 42
#: Documents whose lines a worker holds at once.
STEP = 256


def lines(docs: DataFrame, id_col: str, text: str, site: str) -> DataFrame:
    """``doc_id, k1, k2, pos, h1, h2, site`` for each line of at least ``MIN_WORDS`` words; ``k1, k2``: id and text hashed."""
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        *_keys(F.col(id_col), F.col(text)),
        F.col(site).cast("string").alias("site"),
        F.posexplode_outer(F.split(text, "\n")).alias("pos", "line"),  # not the plain generator, whose added filter splits again
    )
    worded = F.size(F.array_remove(F.split("line", SPACE_RUN), "")) >= MIN_WORDS
    return own.filter(worded).select("doc_id", "k1", "k2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), "site")


def _keys(id_: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(id_, text).alias("k1"), F.xxhash64(F.lit("doc"), text, id_).alias("k2")


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """``h1, h2, first`` of the lines (as :func:`lines` gives them) on at least ``min_sites`` sites; ``first``: the place that keeps it."""
    sketched = found.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")
    )
    # a line that stands less often than the near band begins can't be on enough sites
    low, high = min_sites * (1 - near), min_sites * (1 + near)
    rated = sketched.filter(F.col("n") >= low).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    rated, _ = written(rated.filter(F.col("sites") >= low), "line-spread")  # read by what is returned
    between = rated.filter(F.col("sites") <= high).select("h1", "h2", "first")
    exact = found.join(between.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
    counted = between.join(exact.filter(F.col("sites") >= min_sites).select("h1", "h2"), ["h1", "h2"], "left_semi")
    return rated.filter(F.col("sites") > high).select("h1", "h2", "first").unionByName(counted)


def removals(found: DataFrame, spread: DataFrame) -> DataFrame:
    """``k1, k2, gone``: the places that a document loses, for each that loses any. ``found``: its lines; ``spread``: boilerplate."""
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")))
    gone = found.drop("site").join(spread, ["h1", "h2"]).filter(later).groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    return written(gone, "lines-gone")[0]


def _in_place(spread: DataFrame):
    """A column function of id hash and text: the text without its boilerplate lines, and how many went."""
    import xxhash

    rows = spread.select("h1", "h2", F.xxhash64("first.doc_id").alias("id"), F.col("first.pos").cast("long").alias("pos")).toPandas()  # counted: at most SENT_LINES
    rows = rows.sort_values("h1", kind="stable")
    sent = spread.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy(np.int64) for c in ("h1", "h2", "id", "pos")))
    line_seed = xxhash.xxh64_intdigest(b"line", SEED)

    @F.arrow_udf("text string, removed long")
    def cut(ids: pa.Array, texts: pa.Array) -> pa.Array:
        parts, counts = [], []
        for at in range(0, len(texts), STEP):
            part = texts.slice(at, STEP)
            gone = _gone(sent.value, line_seed, ids.slice(at, STEP).to_numpy(zero_copy_only=False), part)
            if gone:
                kept = part.to_pylist()
                for doc, places in gone.items():
                    kept[doc] = "\n".join(x for j, x in enumerate(kept[doc].split("\n")) if j not in places)
                part = pa.array(kept, texts.type)
            parts.append(part)
            counts += [len(gone.get(i, ())) for i in range(len(part))]
        return pa.StructArray.from_arrays([pa.concat_arrays(parts) if parts else texts, pa.array(counts, pa.int64())], names=["text", "removed"])

    return cut.asNondeterministic()  # else a filter on what it returns would run it twice


def _gone(sent: tuple[np.ndarray, ...], line_seed: int, ids: np.ndarray, texts: pa.Array) -> dict[int, set[int]]:
    """The places of lines to remove, by row. ``sent``: of boilerplate lines the two hashes, and the id's hash and place that keep each."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    h1, h2, first_id, first_pos = sent
    own = [x.as_buffer().to_pybytes().split(b"\n") if x.is_valid else () for x in texts]
    sizes = np.array([len(x) for x in own], dtype=np.int64)
    hashes = np.fromiter((digest(y, SEED) for x in own for y in x), dtype=np.uint64, count=int(sizes.sum())).view(np.int64)
    at = np.searchsorted(h1, hashes)
    hits = np.flatnonzero(h1[np.minimum(at, len(h1) - 1)] == hashes) if len(h1) else ()
    starts = np.concatenate(([0], np.cumsum(sizes)))
    gone: dict[int, set[int]] = {}
    for i in hits:
        doc = int(np.searchsorted(starts, i, side="right")) - 1
        pos, k = int(i - starts[doc]), int(at[i])
        second = np.uint64(digest(own[doc][pos], line_seed)).view(np.int64)
        while k < len(h1) and h1[k] == hashes[i]:
            if h2[k] == second and not (first_id[k] == ids[doc] and first_pos[k] == pos):
                gone.setdefault(doc, set()).add(pos)
            k += 1
    return gone


def without(text: Column, gone: Column) -> Column:
    """The text without its lines at the places ``gone``."""
    return let(F.split(text, "\n"), lambda ln: F.array_join(F.transform(F.array_except(indices(ln), gone), lambda i: F.get(ln, i)), "\n"))


def clean(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, removed: str | None = None, sent_lines: int = SENT_LINES
) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and their number in ``removed`` where a name is given."""
    found = lines(docs, id_col, text, site)
    spread, path = written(boilerplate(found, min_sites), "boilerplate")
    if spread.count() <= sent_lines:
        cut = free_name(docs, "cut__")
        both = docs.withColumn(cut, _in_place(spread)(F.xxhash64(F.col(id_col)), F.col(text)))
        dropped(docs.sparkSession, path)
        new, n = F.col(cut)["text"], F.col(cut)["removed"]
        return both.select(*(new.alias(c) if c == text else F.col(c) for c in docs.columns), *([n.alias(removed)] if removed else []))
    # the documents that lose lines are a share of the corpus, so both sides grow with it; keys are hashes of id and text, and so none is hot
    k1, k2, gone = (free_name(docs, x) for x in ("k1__", "k2__", "gone__"))
    lost = removals(found, spread).toDF(k1, k2, gone)
    a, b = _keys(F.col(id_col), F.col(text))
    joined = docs.withColumns({k1: a, k2: b}).join(lost, [k1, k2], "left")
    columns = [F.when(F.col(gone).isNull(), F.col(text)).otherwise(without(F.col(text), F.col(gone))).alias(c) if c == text else F.col(c) for c in docs.columns]
    if removed:
        columns.append(F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed))
    return joined.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return clean(docs, removed="n_removed").select("doc_id", "text", "n_removed")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (
  SELECT r, doc_id, source, p, s[p] AS line
  FROM (SELECT r, doc_id, source, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM d)
), w AS (
  SELECT *, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 3 AS worded FROM l
), b AS (
  SELECT line, min({'d': doc_id, 'p': p}) AS first FROM w WHERE worded GROUP BY line HAVING count(DISTINCT source) >= 10
), k AS (
  SELECT w.r, w.p, w.line, b.line IS NOT NULL AND NOT (w.doc_id = b.first.d AND w.p = b.first.p) AS gone
  FROM w LEFT JOIN b ON b.line = w.line AND w.worded
), t AS (
  SELECT r, string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone) AS text, count(*) FILTER (WHERE gone) AS n FROM k GROUP BY r
)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, CAST(coalesce(t.n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN t ON t.r = d.r
"""
