import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frametide.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, doc_key__ int, words string", "item_id long, text string, extra int"


def words(t):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered) if w]


def brute(text, items, window=10):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        x = words(t)
        k = min(window, len(x))
        for a in range(len(x) - k + 1) if k else ():
            for b in range(len(w) - k + 1):
                if w[b : b + k] == x[a : a + k]:
                    hit |= set(range(b, b + k))
                    if i is not None:
                        found.add(str(i))
    return len(w), len(hit), sorted(found)


def run(spark, docs, items, window=10):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = D.contaminated(d, b, window=window).collect()
    assert sorted(((r.doc_id or -1), r.n_words, r.n_hit, r["items"]) for r in got) == sorted(((i or -1), *brute(t, items, window)) for i, t in docs)
    kept = D.keep_clean(d, b, window=window)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((i or -1, t or "") for i, t in docs if not brute(t, items, window)[1])


PASSAGE = " ".join(f"term{i}" for i in range(14))


def test_planted_cases(spark):
    docs = [
        (1, f"before it {PASSAGE} after it"), (2, PASSAGE.upper().replace(" ", " -- ")), (3, " ".join(PASSAGE.split()[:9])), (4, " ".join(PASSAGE.split()[2:12]) + " x"),
        (5, None), (6, ""), (7, "says hello there friend"), (8, "hello there friend hello there friend"), (8, "hello there friend hello there friend"), (9, PASSAGE + " " + PASSAGE), (None, PASSAGE), (10, "é É term0 É"), (11, "nothing at all"),
        (12, " ".join(PASSAGE.split()[:10] + ["gap"] + PASSAGE.split()[10:])),
    ]
    items = [(1, PASSAGE), (2, "Hello, there friend!"), (3, None), (4, "..."), (5, "é É"), (10, PASSAGE), (10, PASSAGE), (None, PASSAGE), (2, "absent words here")]
    run(spark, docs, items)


def test_repeating_words_and_periodic_items(spark):
    docs = [(1, "a b " * 20), (2, "a a a a a"), (3, "b a b a b a b a b a b a c"), (4, "a " * 400)]
    items = [(1, "a b " * 6), (2, "a a a"), (3, "b a b a b a b a b a b")]
    run(spark, docs, items)


def test_one_word_texts_and_long_items_take_time_in_proportion(spark):
    items = spark.createDataFrame([(1, "a " * 40_000), (2, PASSAGE)], "item_id long, text string")
    took = []
    for n in (100_000, 1_000_000):
        docs = spark.createDataFrame([(1, "a " * n), (2, f"x a a a {PASSAGE} a"), (3, "a " * 9)], "doc_id long, text string")
        began = time.time()
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.contaminated(docs, items).collect()}
        took.append(time.time() - began)
        assert got == {1: (n, n, ["1"]), 2: (19, 14, ["2"]), 3: (9, 0, [])}
    assert took[1] < 10 * took[0]


def test_empty_tables(spark):
    run(spark, [], [(1, PASSAGE)])
    run(spark, [(1, PASSAGE)], [])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=25).map(" ".join), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("abcd"), max_size=9).map(" ".join), max_size=4))
def test_against_brute_force(spark, texts, items):
    run(spark, list(enumerate(texts)), list(enumerate(items)), window=4)


@pytest.mark.parametrize("slop", [0, 2])
def test_proximity(spark, slop):
    texts = ["the quick brown fox jumps", "quick red brown the fox", "brown quick fox", "quick quick brown fox brown"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    phrases = [(0, ["quick", "brown", "fox"]), (1, ["fox"]), (2, ["absent", "fox"]), (3, ["quick", "brown"])]
    index = D.build_index(docs)
    got = {(r.phrase_id, r.doc_key, r.pos) for r in D.proximity_matches(index, spark.createDataFrame(phrases, "phrase_id long, words array<string>"), slop).collect()}
    keys = {r.doc_id: r.doc_key for r in D.keyed(docs, "doc_id", "text").collect()}
    want = set()
    for p, ws in phrases:
        for i, t in enumerate(texts):
            w = t.split()
            for s, first in enumerate(w):
                if first == ws[0] and all(any(abs(j - s - k) <= slop and w[j] == x for j in range(len(w))) for k, x in enumerate(ws)):
                    want.add((p, keys[i], s))
    assert got == want
