"""Benchmark decontamination by a positional inverted index.

Postings ``(term, doc_key, pos)`` of the training texts are stored as a table. The test items are cut into windows of ``WINDOW`` words,
each distinct window being looked up once. The posting list of a window's rarest term leads: shifted by the term's place it
says where the window may begin; the list of the second rarest is probed for the place that belongs to it, by term, document and
place. What survives is compared word by word with the document, a row for each place. The rarest terms are known
exactly: document-side counts of every test term come from a pass over all texts.

A hot term leads only where a window has no rarer one. Then its list is joined with the windows that it leads, which Catalyst broadcasts by their
stored size or joins by shuffle, where AQE splits the term; the probes' keys hold document and place, and so none is hot.

Only postings of anchor terms are stored by :func:`contaminated`, since no other list is ever probed; :func:`build_index`
stores all terms where none are given.

Defined results: a null or empty text has no words and is never hit; null or wordless items are never found; an item of
fewer than ``WINDOW`` words is one window; repeated documents are each reported; repeated items (same id and text) count
once; an item id that repeats with different texts is one item in ``n_items``; a null item id is not listed, but its
words are hit; equally rare terms lead in the order of the terms and places. A very long text or item has a row for each place and
window, and what one row holds of it grows with it in proportion. Empty tables give empty results or documents without hits.
Other columns, whatever their names, are not read, and pass through :func:`keep_clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from frametide.llm.common import free_name, phrase_words, scratch_path, scratch_scope, table, written

WINDOW = 10


def _keys(id_: Column, text: Column) -> tuple[Column, Column]:
    """Of rows that repeat the same. Lists go by the first; should two rows collide there, each is still compared with its own words."""
    return F.xxhash64(id_, text), F.xxhash64(F.lit("doc"), text, id_)


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``doc_key, doc_id, words``."""
    return docs.select(_keys(F.col(id_col), F.col(text))[0].alias("doc_key"), F.col(id_col).alias("doc_id"), phrase_words(F.col(text)).alias("words"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """Postings ``term, doc_key, pos``; of ``terms`` (one column ``term``, distinct) alone where given.

    Catalyst broadcasts ``terms`` when its stored size allows it and joins by shuffle beyond that.
    """
    # the outer generator, as the plain one would add a filter on the number of words and so split twice
    postings = keyed(docs, id_col, text).select("doc_key", F.posexplode_outer("words").alias("pos", "term")).filter("term is not null")
    if terms is not None:
        postings = postings.join(terms, "term", "left_semi")
    return postings.select("term", "doc_key", "pos")


def item_windows(items: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item_id, words``: the windows of every item, each once."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), phrase_words(F.col(text)).alias("w")).filter(F.size("w") > 0).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).distinct()


def anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per window its rarest term and the next: ``win, size, term, off, term2, off2`` (the last two null for a single word).

    ``windows``: ``win, words``; ``counts``: ``term, n``. A term that is missing occurs nowhere, and so do its windows, which are left out.
    """
    words = windows.select("win", F.size("words").alias("size"), F.posexplode("words").alias("off", "term")).join(counts, "term", "left")
    one = F.struct("n", "term", "off")
    ranked = words.groupBy("win", "size").agg(F.array_sort(F.collect_list(one)).alias("a"), F.max(F.col("n").isNull()).alias("missing"))  # a window's words
    first, second = F.get("a", F.lit(0)), F.get("a", F.lit(1))
    return ranked.filter(~F.col("missing")).select("win", "size", first["term"].alias("term"), first["off"].alias("off"), second["term"].alias("term2"), second["off"].alias("off2"))


def places(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """``doc_key, start, size``: where a window's rarest terms stand in a document as they do in the window. Rows may repeat."""
    led = index.join(anchored, "term").select("doc_key", (F.col("pos") - F.col("off")).alias("start"), "size", "term2", "off2").filter("start >= 0")
    probe = index.select("doc_key", F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    both = led.filter("term2 is not null").withColumn("pos2", F.col("start") + F.col("off2")).join(probe, ["doc_key", "term2", "pos2"], "left_semi")
    return both.select("doc_key", "start", "size").unionByName(led.filter("term2 is null").select("doc_key", "start", "size"))


def _covered(spans: Column) -> Column:
    """How many places the spans ``start, size`` cover; they are sorted."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def hits(docs: DataFrame, items: DataFrame, id_col: str, text: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """``doc_key, doc_key2, n_hit, items`` of every document that holds a window, as a stored table."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    path = scratch_path(spark, "hits")
    with scratch_scope(spark):
        members, _ = written(item_windows(items, item_id, item_text, window).withColumn("win", F.xxhash64("words")), "item-windows")
        windows = members.select("win", "words").distinct()
        vocabulary, _ = written(members.select(F.explode("words").alias("term")).distinct(), "vocabulary")
        counts, _ = written(build_index(slim, "doc_id", "text", vocabulary).groupBy("term").agg(F.count("*").alias("n")), "term-counts")
        # two windows with one hash would share anchors; the words tell them apart below, and so the anchors go by both
        anchored, _ = written(anchors(windows.withColumn("win", F.struct("win", F.xxhash64(F.reverse("words")))), counts).drop("win").distinct(), "anchors")
        terms, _ = written(anchored.select(F.explode(F.array("term", "term2")).alias("term")).filter("term is not null").distinct(), "anchor-terms")
        index, _ = written(build_index(slim, "doc_id", "text", terms), "postings")
        found, _ = written(places(index, anchored).groupBy("doc_key").agg(F.collect_set(F.struct("start", "size")).alias("at")), "places")
        keys, _ = written(found.select("doc_key"), "place-keys")  # a table of its own, so that Catalyst knows its size and moves no text for a few of them
        a, b = _keys(F.col("doc_id"), F.col("text"))
        texts = slim.select(a.alias("doc_key"), b.alias("doc_key2"), "text").join(keys, "doc_key", "left_semi")
        texts = texts.groupBy("doc_key", "doc_key2").agg(F.first("text").alias("text")).join(found, "doc_key")  # rows that repeat are compared once
        own = texts.select("doc_key", "doc_key2", "at", phrase_words(F.col("text")).alias("w"))
        pieces = F.transform("at", lambda x: F.struct(x["start"].alias("start"), F.slice(F.col("w"), x["start"] + 1, x["size"]).alias("words")))
        pieces = own.select("doc_key", "doc_key2", F.explode_outer(pieces).alias("p")).select("doc_key", "doc_key2", "p.*").withColumn("win", F.xxhash64("words"))
        same, _ = written(pieces.join(windows, ["win", "words"]), "same")
        spans = same.groupBy("doc_key", "doc_key2").agg(F.sort_array(F.collect_set(F.struct("start", F.size("words").alias("size")))).alias("s"))
        spans = spans.select("doc_key", "doc_key2", _covered(F.col("s")).alias("n_hit"))
        names = same.select("doc_key", "doc_key2", "win", "words").distinct().join(members, ["win", "words"])
        names = names.groupBy("doc_key", "doc_key2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        out = spans.join(names, ["doc_key", "doc_key2"])
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items`` (the ids of the items found, as sorted strings)."""
    found = hits(docs, items, id_col, text, item_id, item_text, window)
    a, b = _keys(F.col(id_col), F.col(text))
    own = docs.select(a.alias("doc_key"), b.alias("doc_key2"), F.col(id_col).alias("doc_id"), F.size(phrase_words(F.col(text))).cast("long").alias("n_words"))
    out = own.join(found, ["doc_key", "doc_key2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with their own columns."""
    k1, k2 = free_name(docs, "doc_key__"), free_name(docs, "doc_key2__")
    found = hits(docs, items, id_col, text, item_id, item_text, window).select(F.col("doc_key").alias(k1), F.col("doc_key2").alias(k2))
    a, b = _keys(docs[id_col], docs[text])
    return docs.join(found, (a == F.col(k1)) & (b == F.col(k2)), "left_anti")


def proximity_matches(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """``phrase_id, doc_key, pos``: the first term of a phrase stands at ``pos``, and each later term k at ``pos + k`` give or
    take ``slop`` places (0: the exact phrase).

    ``phrases``: ``phrase_id, words`` (at least one). ``index`` holds every term of the phrases (:func:`build_index`). The
    lists are intersected from the term with the fewest postings; a null or wordless phrase matches nothing.
    """
    terms = phrases.select("phrase_id", F.posexplode("words").alias("k", "term"), F.size("words").alias("n"))
    counts = index.groupBy("term").agg(F.count("*").alias("postings"))
    ranked = terms.join(counts, "term").withColumn("rank", F.row_number().over(W.partitionBy("phrase_id").orderBy("postings", "k")))
    rarest = ranked.filter("rank = 1").join(index, "term").select("phrase_id", "n", "doc_key", F.col("k").alias("k0"), F.col("pos").alias("p0"))
    near = F.explode(F.sequence(F.col("p0") - F.col("k0") - slop, F.col("p0") - F.col("k0") + slop)).alias("start")
    starts = rarest.select("phrase_id", "n", "doc_key", near).distinct()
    first = terms.filter("k = 0").select("phrase_id", F.col("term").alias("t0"))
    starts = starts.join(first, "phrase_id").join(index.select("doc_key", F.col("term").alias("t0"), F.col("pos").alias("start")), ["doc_key", "t0", "start"])
    each = starts.join(terms.select("phrase_id", "k", "term"), "phrase_id").join(index, ["doc_key", "term"])
    each = each.filter((F.abs(F.col("pos") - F.col("start") - F.col("k")) <= slop) & ((F.col("k") > 0) | (F.col("pos") == F.col("start"))))
    full = each.groupBy("phrase_id", "doc_key", "start", "n").agg(F.size(F.collect_set("k")).alias("have"))
    return full.filter("have = n").select("phrase_id", "doc_key", F.col("start").alias("pos"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), b AS (
  SELECT item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw
), dw AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS t
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), hit AS (
  SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.t = dw.t
), places AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r
), its AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.r = d.r LEFT JOIN its ON its.r = d.r
"""
