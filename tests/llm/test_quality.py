import random
import re

from frametide.llm import quality

SCHEMA = "doc_id long, text string, source string, m int, host_ok__ string"
LONG = "The quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree"


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


TEXTS = [
    None, "", " \t\n ", "one", "a b c d e", "a b c d e a b c d e", "a b c d e f a b c d e x a b c d e", LONG, f"{LONG}\n{LONG}\n\n \nother line",
    "x " * 300, "é ü ß # $ % <tag> & é", "a\nb\na\n a\na\r\na\r", "w " * 4 + "z", ("q r s t u v " * 7).strip(), " ".join(f"w{i}" for i in range(20000)), "nbsp\u00a0joined words\u2003here",
]


def test_measures_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "s", 0, "x") for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        n, chars, symbols, dup, rep = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), t
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)


def test_host_verdicts_shrink_and_reach_documents(spark):
    junk = " ".join(f"#$w{i}" for i in range(20))  # symbols in every word, but no repeats
    rows = [(i, junk, "bad") for i in range(60)] + [(100 + i, LONG, "good") for i in range(60)] + [(200, LONG, "bad"), (300, junk, "new"), (301, LONG, None), (302, junk, None), (303, "short", "good")]
    rows += [(400 + i, LONG, f"h{i % 9}") for i in range(90)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(got) == len(rows)
    assert not got[200].kept and not got[200].base_failed  # a good text on a rejected host
    assert got[100].kept and not got[303].kept and got[303].base_failed
    assert got[300].kept  # one failure is not enough against the prior
    assert got[301].kept and got[302].kept  # no host, no verdict
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_empty_and_single_host(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quality.judge(df).count() == 0 and quality.keep_good(df).count() == 0
    one = spark.createDataFrame([(1, LONG, "s", 0, "x"), (1, LONG, "s", 0, "x")], SCHEMA)
    assert [r.kept for r in quality.judge(one).collect()] == [True, True]


def test_query_and_sql_where_hosts_decide(spark, tmp_path):
    """One host in thirty fails far more often than the prior allows; small hosts are shrunk."""
    import duckdb

    rng = random.Random(2)
    good, bad = "a text of more than ten plain words that is fine as it stands number {}", "# $ % & a text of ten and some words that is full of symbols {}"
    rows = [(1000 * h + i, (bad if rng.random() < (0.45 if h == 7 else 0.1) else good).format(i), f"h{h}") for h in range(30) for i in range(60)]
    rows += [(90_000, bad.format(1), "small"), (90_001, "too short", "h1"), (90_002, bad.format(2), None), (90_003, None, "h2")]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, m int, host_ok__ string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = quality.query(spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({quality.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    gone = {r.doc_id // 1000 for r in got.collect() if not r.kept and not r.base_failed}
    assert gone == {7}
