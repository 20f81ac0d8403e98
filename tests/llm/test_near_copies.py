import itertools
import random

import corpus_pipeline
import numpy as np
import pytest

from frametide.llm import near_copies as N
from frametide.llm import simhash

SCHEMA = "doc_id long, text string"


def brute_set(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c.lower() if c.isascii() else c for c in text or "").split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_roots(rows):
    sets, up = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            up[root(j)] = root(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), k) if x is not None), default=None)
    return [least[root(i)] for i in range(len(rows))]


def changed(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.getrandbits(40)}"
    return " ".join(words)


def planted():
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.getrandbits(30)}" for _ in range(n)]
    texts = [" ".join(prose(60)) for _ in range(20)]
    base = prose(150)
    texts += [changed(rng, base, rng.randrange(0, 8)) for _ in range(80)]  # links and pairs below 0.8 in one bucket
    for edits in (1, 3, 6):
        one = prose(300)
        texts += [" ".join(one), changed(rng, one, edits), " ".join(one).upper()]
    texts += [None, "", " \n", "one two", "one  two", "one two three", texts[0], texts[30]]
    order = rng.sample(range(1000), len(texts))
    return list(zip(order, texts)) + [(None, texts[1]), (None, "lonely"), (order[5], texts[5])]


@pytest.mark.parametrize("back, block", [(2, 16_384), (1, 16_384), (1, 7)])
def test_components_against_brute_force(spark, monkeypatch, back, block):
    monkeypatch.setattr(N, "BACK", back)
    monkeypatch.setattr(N, "BLOCK", block)
    rows = planted()
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    hashes = {r.text: r.h for r in spark.createDataFrame(rows, SCHEMA).selectExpr("text", "xxhash64(text) h").collect()}
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, ((r.doc_id, r.text_hash, r.component_id) for r in got))) == sorted(map(key, ((i, hashes[t], c) for (i, t), c in zip(rows, brute_roots(rows)))))


def test_stage_takes_pairs_that_differ_in_more_than_four_bits(spark):
    rng = random.Random(8)
    rows = []
    while len(rows) < 24:
        one = [f"w{rng.getrandbits(30)}" for _ in range(200)]
        pair = " ".join(one), changed(rng, one, 3)
        if (simhash.fingerprint(pair[0]) ^ simhash.fingerprint(pair[1])).bit_count() > 4:
            rows += [(len(rows) + 1, pair[0]), (len(rows) + 2, pair[1])]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(1, 24, 2))


def test_sketches_leave_each_similar_pair_possible():
    rng = np.random.default_rng(4)
    lost = kept = 0
    for size in (3, 40, 300, 5000):
        sets = [np.empty(0, np.uint64)]
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for share in np.linspace(0.5, 1, 40):
            own = rng.integers(0, 1 << 63, size - int(share * size), dtype=np.uint64)
            sets.append(np.unique(np.concatenate((base[: int(share * size)], own))))
        n, x = np.array([len(s) for s in sets]), np.array([N.odd_sketch(s) for s in sets])
        near = N._possible(n, x, n, x)
        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            similar = 5 * both >= 4 * (n[i] + n[j] - both)
            lost += similar and not near[i, j]
            kept += size == 300 and not similar and near[i, j]
    assert lost == 0 and kept < 40  # of 820 pairs of 300 hashes few that are not similar pass


def test_pairs_across_are_those_between_roots_whatever_the_block(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.getrandbits(30)}" for _ in range(150)]
    texts = [changed(rng, base, rng.randrange(1, 6)) for _ in range(60)]
    sets = [N.distinct(t) for t in texts]
    nodes = list(range(60))
    bands = spark.createDataFrame([(i, [1, 2 + i % 2]) for i in nodes], "node long, keys array<long>")
    found = spark.createDataFrame([(i, len(sets[i]), N.odd_sketch(sets[i]).tolist()) for i in nodes], "node long, size long, odd array<long>")
    of = spark.createDataFrame([(i, i // 4) for i in nodes], "node long, root long")
    got = []
    for block in (16_384, 7):
        monkeypatch.setattr(N, "BLOCK", block)
        got.append(sorted(map(tuple, N.across(bands, found, of).collect())))
    pairs = [(i, j) for i, j in itertools.combinations(nodes, 2) if i // 4 != j // 4 and not (i - j) % 2]
    by_columns = sorted(map(tuple, N.possible(spark.createDataFrame(pairs, "a long, b long"), found).collect()))
    assert by_columns == [x for x in got[0] if not (x[0] - x[1]) % 2]  # the column form is the same rule
    similar = {(i, j) for i, j in itertools.combinations(nodes, 2) if i // 4 != j // 4 and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert got[0] == got[1] and similar and similar <= set(got[0])


def test_stretches(monkeypatch):
    texts = ["a bb ccc dddd eeeee ff g hhh", "one", "", "x" * 200 + " y z", " " * 99 + "a b c d e f" + " " * 99]
    whole = [np.concatenate([[], *N.shingle_hashes(t)]).tolist() for t in texts]
    for n in (1, 7, 50):
        monkeypatch.setattr(N, "STRETCH", n)
        assert [np.concatenate([[], *N.shingle_hashes(t)]).tolist() for t in texts] == whole


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_golay_links_of_fingerprints_give_candidates(spark, monkeypatch):
    import random

    import corpus_pipeline
    from frametide.llm import near_copies, simhash

    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(12)]
    texts += [t + f" tail{k}" for t in texts[:6] for k in range(4)] + [texts[0].upper(), None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    prints = [simhash.fingerprint(t) for t in texts]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    bands = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "node long, fp long")

    def reach(pairs):
        up = list(range(len(texts)))
        for a, b in [*pairs] * len(texts):
            up[a] = up[b] = min(up[a], up[b])
        return up

    found = [tuple(r) for r in near_copies.fingerprint_links(bands).select("a", "b").collect()]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= simhash.MAX_BITS]
    assert reach(found) == reach(want) and len({*reach(found)}) < len(texts) - 20

    called, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints: called.append(1) or links(prints))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert called and kept == [*range(12), len(texts) - 2]
