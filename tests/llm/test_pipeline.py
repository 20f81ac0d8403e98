import corpus_pipeline as P

from frametide.llm import packing
from test_packing import ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the answer to this question is given by the seventh rule of the second list of all known rules"


def prose(seed, n=120):
    return " ".join(f"word{(i * 7919 + seed * 104729) % 99991}" for i in range(n))


def test_stages_and_run(spark, tmp_path):
    foot = "subscribe to our weekly letter"
    docs = [(i, prose(i) + f"\n{foot}", "en", f"s{i % 15}", 0) for i in range(30)]
    docs += [(100, prose(3) + "\nanother last line here", "en", "s1", 0), (101, prose(50) + " " + ITEM, "en", "s2", 0), (102, "too short", "en", "s3", 0), (103, None, None, None, None), (104, prose(60), None, None, None), (105, "x y z w v " * 40, "en", "s4", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, left, str(tmp_path))
        assert out.columns == left.columns
        seen[name] = {r.doc_id: r.text for r in out.collect()}
        out.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
    assert set(seen["quality rules"]) == {*range(30), 100, 101, 104}
    assert {i for i, t in seen["line dedup"].items() if foot in t} == {0}
    assert set(seen["near duplicates"]) == {*range(30), 101, 104}
    assert set(seen["decontamination"]) == {*range(30), 104}
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(ids(t)) // 4 + 1 for i, t in seen["decontamination"].items()}
    assert sorted((r.doc_id, r.start) for r in got) == sorted((i, s) for i, t in seen["decontamination"].items() for s in starts(len(ids(t)) // 4 + 1))


def starts(n):
    at = 0
    for p in packing.pieces(n):
        yield at
        at += p


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_oracle_sql_of_operators(spark, sf):
    import duckdb

    from frametide.llm import registry
    from test_catalog import plain

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        got = registry.QUERIES[name](spark, sf)
        cols = sorted(got.columns)
        result = c.execute(sql)
        names = [d[0] for d in result.description]
        want = [tuple(dict(zip(names, r))[x] for x in cols) for r in result.fetchall()]
        assert plain(tuple(r[x] for x in cols) for r in got.collect()) == plain(want), name
