"""Host-level quality rules.

Each document is measured by built-in functions alone; rule failures are counted by host, the hosts' failure rates are
shrunk towards the corpus by an empirical beta prior, and the verdict on a host is joined back to its documents.

A host is judged against the fitted prior: it is rejected where its shrunk rate is more than ``SIGMAS`` of the prior's standard deviations
above the prior's mean, but never at ``LEAST_RATE`` or less and always above ``MAX_HOST_RATE``.

Defined results: a null text has no words and fails; a null host is a host of its own whose verdict is always good; an
empty table gives an empty table; repeated rows are judged one by one; a very long text is measured in its own row, in time that
grows as sorting its windows does; extra columns, whatever their names, are not read by :func:`judge` and pass through :func:`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm.common import free_name, indices, let, space_words, table, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected when the shrunk share of its documents that fail a rule is so far above the prior's mean,
SIGMAS = 3.0
#: but not at this or less, and above that whatever the prior.
LEAST_RATE, MAX_HOST_RATE = 0.3, 0.5
#: The prior weighs at least as much as so many documents, so that one failure doesn't reject a host.
LEAST_PRIOR = 4.0
SYMBOLS = "#*$%&|<>"


def _windows(words: Column, value) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: value(*(F.get(words, i + k) for k in range(WINDOW))))


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows found twice or more.

    Window hashes find the few texts where any window can repeat; only these compare the windows themselves.
    """

    def covered(starts: Column) -> Column:
        # sorted starts: each window adds what the next one does not cover
        return F.aggregate(
            indices(starts),
            F.lit(0),
            lambda acc, i: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - F.get(starts, i), F.lit(WINDOW))),
        )

    def exact(w: Column) -> Column:
        texts = _windows(w, lambda *x: F.concat_ws(" ", *x))
        ordered = F.transform(texts, lambda t, i: F.struct(t.alias("t"), i.alias("i")))

        def starts(s: Column) -> Column:
            same = F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when((x["t"] == F.get(s, i + 1)["t"]) | ((i > 0) & (x["t"] == F.get(s, F.greatest(i - 1, F.lit(0)))["t"])), x["i"]),
                ),
                lambda p: p.isNotNull(),
            )
            return let(F.sort_array(same), covered)

        return let(F.sort_array(ordered), starts)

    def any_repeat(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashes, lambda h: let(_windows(h, lambda *x: F.xxhash64(*x)), lambda s: F.size(F.array_distinct(s)) < F.size(s)))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(F.when(any_repeat(words), exact(words)).otherwise(0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and a column ``m``: a struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, all long."""
    body = F.coalesce(docs[text], F.lit(""))

    def of(w: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return let(
            lines,
            lambda ln: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                F.size(ln).cast("long").alias("n_lines"),
                (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
            ),
        )

    return docs.withColumn("m" if "m" not in docs.columns else free_name(docs, "m"), let(space_words(docs[text]), of))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def any_failed(m: Column) -> Column:
    """The rules whose failures count against a host: the base rules, symbols, repeated lines and odd word lengths."""
    return (
        base_failed(m)
        | (10 * m["n_symbols"] > m["n_words"])
        | (10 * m["n_dup_lines"] > 3 * m["n_lines"])
        | (m["word_chars"] < 2 * m["n_words"])
        | (m["word_chars"] > 15 * m["n_words"])
    )


def host_verdicts(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """One row per host: ``host, n_docs, n_failed, host_rate, host_ok``. ``host_rate`` is shrunk by a beta prior.

    The prior is fitted by moments. Its mean m is the corpus rate; its variance is what the hosts' rates vary, weighted by their documents,
    less what binomial chance alone makes of it: (S - m (1 - m) (H - 1)) / (N - sum n^2 / N - (H - 1)) with S = sum n (f / n - m)^2. Then
    a + b = m (1 - m) / v - 1, at least ``LEAST_PRIOR``. Only this one row of prior figures reaches the driver.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    p = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count("*").alias("h"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff")).first()
    total = p["n"] or 1.0
    m = (p["f"] or 0.0) / total
    spread, base = (p["ff"] or 0.0) - total * m * m, total - (p["nn"] or 0.0) / total - (p["h"] - 1)
    v = max(0.0, (spread - m * (1 - m) * (p["h"] - 1)) / base) if base > 0 else 0.0
    strength = max(LEAST_PRIOR, m * (1 - m) / v - 1) if v > 0 else max(LEAST_PRIOR, total)
    limit = min(MAX_HOST_RATE, max(LEAST_RATE, m + SIGMAS * v**0.5))
    shrunk = (F.col("n_failed") + m * strength) / (F.col("n_docs") + strength)
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (F.col("host").isNull() | (shrunk <= limit)).alias("host_ok"))


def _with_verdicts(judged: DataFrame, host: str, failed: str) -> tuple[DataFrame, str, str]:
    """``judged`` with the host's rate and verdict, and the names of these two columns. Verdicts are stored
    first, so Catalyst broadcasts them by their true size; where they are too many, no aggregate stands over the join and AQE splits a
    hot host."""
    key, rate, ok = (free_name(judged, x) for x in ("verdict_host__", "host_rate__", "host_ok__"))
    verdicts = host_verdicts(judged, host, failed).select(F.col("host").alias(key), F.col("host_rate").alias(rate), F.col("host_ok").alias(ok))
    verdicts, _ = written(verdicts, "host-verdicts")
    return judged.join(verdicts, judged[host] == F.col(key), "left").drop(key), rate, ok


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: the id, its measures, ``base_failed``, the host's shrunk rate and ``kept``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    m = F.col("m")
    stats, _ = written(
        measures(slim).select("doc_id", "host", "m.*", base_failed(m).alias("base_failed"), any_failed(m).alias("any_failed")), "quality"
    )
    joined, rate, ok = _with_verdicts(stats, "host", "any_failed")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(ok, F.lit(True))).alias("kept"),
        F.col(rate).alias("host_rate"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their own columns. Texts are measured once and written once, then filtered."""
    columns = docs.columns
    with_m = measures(docs, text)
    m = F.col(with_m.columns[-1])
    base, bad = free_name(docs, "base_failed__"), free_name(docs, "any_failed__")
    judged, _ = written(with_m.select(*columns, base_failed(m).alias(base), any_failed(m).alias(bad)), "quality-docs")
    joined, _, ok = _with_verdicts(judged, host, bad)
    return joined.filter(~F.col(base) & F.coalesce(ok, F.lit(True))).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("host_rate")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r
), m AS (
  SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ln) AS BIGINT) AS n_lines, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.r = d.r
), j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), k AS (
  SELECT *, base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS bad FROM j
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE bad) AS f FROM k GROUP BY source
), q AS (
  SELECT sum(n) AS n, sum(f) / sum(n) AS m, count(*) AS h, sum(n * n) AS nn, sum(f * f / n) AS ff FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(f AS DOUBLE) AS f FROM h)
), e AS (SELECT *, n - nn / n - (h - 1) AS base, ff - n * m * m - m * (1 - m) * (h - 1) AS over_ FROM q
), g AS (SELECT *, CASE WHEN base > 0 THEN greatest(0.0, over_ / base) ELSE 0.0 END AS v FROM e
), p AS (SELECT m, v, CASE WHEN v > 0 THEN greatest(4.0, m * (1 - m) / v - 1) ELSE greatest(4.0, n) END AS s, least(0.5, greatest(0.3, m + 3.0 * sqrt(v))) AS lim FROM g
), hv AS (SELECT source, (f + m * s) / (n + s) <= lim AS ok FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(hv.ok, true) AS kept
FROM k LEFT JOIN hv ON hv.source = k.source
"""
