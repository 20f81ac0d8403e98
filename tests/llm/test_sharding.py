import zlib
from collections import Counter

import pytest

from frametide.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, key__ int"


def check(spark, rows, shards=6, tolerance=0.005, slack=None, **o):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = S.shard(df, shards=shards, tolerance=tolerance, **o)
    assert out.columns == [*df.columns, "shard_", "slot"]
    got = out.collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(rows, key=key)
    sizes, slots, homes = {}, {}, {}
    for r in got:
        sizes[r.shard_] = sizes.get(r.shard_, 0) + len((r.text or "").encode()) + 8
        slots.setdefault(r.shard_, []).append(r.slot)
        homes.setdefault(r.text, set()).add(r.shard_)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    if slack is not None:
        mean = sum(sizes.values()) / shards
        assert max(abs(sizes.get(k, 0) - mean) for k in range(shards)) <= slack
    return sizes, homes


def test_sizes_are_near_equal(spark):
    rows = [(i, f"text {i} " * (i * 7 % 30 + 1)) for i in range(600)]
    longest = max(len(t) + 8 for _, t in rows)
    check(spark, rows, slack=longest)


def test_a_group_of_a_third_is_spread_and_small_groups_stay(spark):
    rows = [(i, "the same text again and again") for i in range(400)] + [(1000 + i, f"pair {i // 2} of texts " * 3) for i in range(400)]
    sizes, homes = check(spark, rows, tolerance=0.05, slack=200)
    assert len(homes["the same text again and again"]) >= 2
    assert sum(len(h) > 1 for t, h in homes.items() if t.startswith("pair")) <= 2


def test_repeats_nulls_and_parts(spark):
    rows = [(1, "again")] * 200 + [(None, None)] * 50 + [(2, ""), (3, None), (4, "x" * 5000)]
    check(spark, rows)
    sizes, _ = check(spark, [(i, f"some text {i}") for i in range(500)], part_bytes=300, slack=80)
    assert len(sizes) == 6


@pytest.mark.parametrize("rows", [[], [(1, "only")], [(1, None), (2, "b")]])
def test_tiny(spark, rows):
    check(spark, rows)


def test_query_against_sorted_rows(spark, sf):
    """All rows sorted by the hash of their text: shards follow that order, each boundary is within the tolerance of the
    wanted bytes or cuts a group of equal texts as near as a row allows, and slots count the rows of a shard in order."""
    from pyspark.sql import functions as F

    hashes = {r.doc_id: r.h for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lpad(F.hex(F.xxhash64("text")), 16, "0").alias("h")).collect()}
    got = sorted(S.query(spark, sf).collect(), key=lambda r: (r.shard, r.slot))
    order = [hashes[r.doc_id] for r in got]
    assert order == sorted(order)
    assert [r.slot for r in got] == [i for n in Counter(r.shard for r in got).values() for i in range(n)]
    total = sum(r["size"] for r in got)
    groups = {}
    for r in got:
        groups.setdefault(hashes[r.doc_id], []).append(r["size"])
    for k in range(1, S.SHARDS):
        want, below = total * k / S.SHARDS, sum(r["size"] for r in got if r.shard < k)
        ends = [0]
        for h in sorted(groups):
            ends.append(ends[-1] + sum(groups[h]))
        off = abs(below - want)
        if off > S.TOLERANCE * total / S.SHARDS:  # then no boundary between texts is that near, and this is the nearest row
            rows, at = [0], 0
            for h in sorted(groups):
                for size in groups[h]:
                    at += size
                    rows.append(at)
            assert off == min(abs(x - want) for x in rows)
        elif below not in ends:
            assert min(abs(x - want) for x in ends) > S.TOLERANCE * total / S.SHARDS


@pytest.mark.parametrize("total", [10**12, 10**13, 10**14])
def test_parts_are_bounded_at_any_size(total):
    parts = S.parts_of(total, 24, S.PART_BYTES)
    mean = total / 24 / parts
    assert S.PART_BYTES / 2 < mean <= S.PART_BYTES
    # keys are dealt by hash: of a shard with documents of 4 kB the largest part is near the mean
    n = mean / 4096
    assert n + 6 * n**0.5 < 2 * S.PART_BYTES / 4096


def test_a_very_long_text(spark):
    rows = [(i, "short") for i in range(50)] + [(99, "long " * 200_000)]
    sizes, homes = check(spark, rows)
    assert len(homes["long " * 200_000]) == 1


def test_query_columns(spark, sf):
    got = S.query(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(text)
    assert all(r["size"] == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
