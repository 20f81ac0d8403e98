import itertools
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from frametide.llm import simhash as H
from frametide.llm.components import components

SCHEMA = "doc_id long, text string"


def brute_fp(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints):
    """The smallest member of each fingerprint's component."""
    up = {f: f for f in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(up), 2):
        if bin(a ^ b).count("1") <= 4:
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {f: root(f) for f in up}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB éÉ\t\n\v\u00a0\u2003x", max_size=60))
def test_fingerprint(text):
    assert H.fingerprint(text) == brute_fp(text)


@pytest.mark.parametrize("stretch", [1, 2, 7, 50])
def test_long_texts_by_stretches(monkeypatch, stretch):
    monkeypatch.setattr(H, "STRETCH", stretch)
    for text in ("a bb ccc dddd eeeee ff g hhh", "  lead and   trail \n\n", "one", "one two three", "x" * 200 + " y z", " " * 99 + "a b c d e" + " " * 99, "\n".join(f"w{i}" for i in range(300))):
        assert H.fingerprint(text) == brute_fp(text)


def test_golay_code_is_perfect_and_neighbours_share_an_index():
    low, high, errors = H._golay_tables()
    assert len(set(errors.tolist())) == 2048 and max(bin(e).count("1") for e in errors.tolist()) == 3
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    index, first = H.indices_near(words)
    assert set(first.sum(axis=1).tolist()) == {1, 6}
    sets = [set(r) for r in index.tolist()]
    for i, j in ((a, b) for a in range(23) for b in range(a, 23)):
        other, _ = H.indices_near(words[:20] ^ ((1 << i) | (1 << j)))
        assert all(s & set(o) for s, o in zip(sets, other.tolist()))


def test_keys_meet_for_every_split_of_four_errors():
    rng = random.Random(5)
    for a, b, c in itertools.product(range(5), repeat=3):
        if a + b + c > 4:
            continue
        for _ in range(20):
            x, y = rng.getrandbits(64), 0
            for (at, n), k in zip(H.SEGMENTS, (a, b, c)):
                for bit in rng.sample(range(n), k):
                    y ^= 1 << (at + bit)
            row, key = H.fuzzy_keys(np.array([x, x ^ y], dtype=np.uint64).view(np.int64))
            assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


@pytest.mark.parametrize("bucket", [64, 3])
def test_components_of_planted_fingerprints(spark, monkeypatch, bucket):
    """Dense groups, chains and strangers; with a small bucket the dense ones go by balls."""
    monkeypatch.setattr(H, "BUCKET", bucket)
    rng = random.Random(bucket)
    prints = {rng.getrandbits(64) for _ in range(40)}
    center = rng.getrandbits(64)
    for _ in range(120):
        prints.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))))
    x = rng.getrandbits(64)
    for _ in range(12):  # a chain whose ends are far apart
        prints.add(x)
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {r.node: r.root for r in components(H.links(df)).collect()}
    want = brute_roots(prints)
    groups, mine = {}, {}
    for p in prints:
        groups.setdefault(want[p], set()).add(p)
        mine.setdefault(got.get(signed(p), signed(p)), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_query_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    near = base.replace("word200 ", "other ")
    rows = [(5, base), (3, base.upper().replace("WORD", "Word")), (9, near), (1, None), (2, ""), (4, " \n"), (7, "one two"), (8, "one  two"), (7, "one two"), (None, "lonely text here"), (None, base)]
    got = H.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = brute_roots({brute_fp(t) for _, t in rows})
    smallest = {}
    for i, t in rows:
        r = want[brute_fp(t)]
        smallest[r] = min((x for x in (smallest.get(r), i) if x is not None), default=None)
    assert sorted((r.doc_id or -1, r.fp, r.component_id or -1) for r in got) == sorted((i or -1, signed(brute_fp(t)), smallest[want[brute_fp(t)]] or -1) for i, t in rows)


def test_keep_one_keeps_columns_and_one_of_each(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y"), (3, "another text", 7, "z")], "doc_id long, text string, gone_id__ int, fp string")
    got = H.keep_one(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert H.near_duplicates(df).count() == 0 and H.keep_one(df).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), max_size=25))
def test_components_against_union_find(spark, pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = sorted((root(a), root(b)))
            up[q] = p
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
