"""Every registered query against its SQL on DuckDB."""

from collections import Counter

import duckdb
import pytest

from frametide import catalog

TABLES = ("lineitem", "events", "orders")


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return Counter(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = [tuple(dict(zip(names, r))[c] for c in cols) for r in result.fetchall()]
    assert plain(tuple(r[c] for c in cols) for r in got.collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_streamed_admission_equals_the_replay(spark, sf):
    def rows(df):
        return sorted(map(tuple, df.select("stream_id", "source_idx", "outcome").collect()))

    assert rows(catalog.QUERIES["stream_admission"](spark, sf)) == rows(catalog.QUERIES["drop_oldest"](spark, sf))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_emission_is_registered_over_all_frames(spark, sf):
    frames = catalog.view(spark, sf, "frames").filter("source_idx % 7 <> 3").count()
    assert frames > 500 and catalog.QUERIES["ordered_emit_all"](spark, sf).count() == frames
    assert catalog.QUERIES["ordered_emit"](spark, sf).count() == 500
