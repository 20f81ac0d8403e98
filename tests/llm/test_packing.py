import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from frametide.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return P.WordEncoder(PATH)


def ids(text):
    return np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() if text else b""


@settings(deadline=None)  # the first text loads the tokenizer
@given(st.text(max_size=80))
def test_any_text_has_the_tokenizers_ids(text):
    test_any_text_has_the_tokenizers_ids.encoder = getattr(test_any_text_has_the_tokenizers_ids, "encoder", None) or P.WordEncoder(PATH)
    assert test_any_text_has_the_tokenizers_ids.encoder(text) == ids(text)


@pytest.mark.parametrize("text", ["Hello’s IT'S don't ²½ ΑΣ", "a\x1cb\x85c\u00a0d", "x <|endoftext|> y", "<|startoftext|>", "K Å ﬁ İ e\u0301", "''s !'s 12,5 “q”", "naïve ÜBER straße ñ", "日本語 123"])
def test_odd_texts(encoder, text):
    assert encoder(text) == ids(text)


@pytest.mark.parametrize("stretch", [1, 5, 40])
def test_long_texts_by_stretches(encoder, monkeypatch, stretch):
    monkeypatch.setattr(P, "STRETCH", stretch)
    for text in ("it's  a   text\nof some words. Don't!", "no-break " * 9, "e \u0301x é\u0301 日本 語", "x" * 300, "a\u00a0b " * 20):
        assert encoder(text) == ids(text)


def test_a_full_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(P, "KNOWN_WORDS", 3)
    e = P.WordEncoder(PATH)
    text = "some words that do not fit in so small a memory as this"
    assert e(text) == ids(text) and len(e.plain) <= 3


@given(st.integers(0, 100_000))
def test_pieces(n):
    got = P.pieces(n)
    assert sum(got) == n and all(x & (x - 1) == 0 and 0 < x <= 2048 for x in got)
    assert len([x for x in got if x < 2048]) == len({x for x in got if x < 2048})


def test_pack_round_trip(spark, tmp_path):
    rows = [(1, "Some text. " * 900), (2, None), (3, ""), (2, "twice"), (2, "twice"), (None, "no id"), (4, " \n"), (5, "w " * 2047), (6, "word " * 30000)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, ids string, start int")
    got = P.pack(df, PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    want = Counter()
    for i, t in rows:
        whole, at = ids(t) + np.array([1], "<u4").tobytes(), 0
        for n in P.pieces(len(whole) // 4):
            want[i, at, whole[4 * at : 4 * (at + n)], len(whole) // 4] += 1
            at += n
    assert Counter((r.doc_id, r.start, bytes(r.ids), r.doc_tokens) for r in got) == want
    assert all(r.length == 1 << r.bucket == 1 << (r.sequence_id >> 59) for r in got)
    in_files = P.pack(df, PATH, with_ids=False).withColumn("p", F.spark_partition_id()).collect()
    for p in {r.p for r in in_files}:
        assert (own := [r.bucket for r in in_files if r.p == p]) == sorted(own)
    P.write_buckets(P.pack(df, PATH), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == len(got) and {r["length"] for r in back.select("length").distinct().collect()} == {r["length"] for r in got}
    assert P.pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, PATH, longest=1000)


def test_a_worker_gives_memory_back_when_its_task_ends(spark, monkeypatch):
    from frametide.llm import common, packing

    calls = []
    monkeypatch.setattr(common, "released", lambda: calls.append(1))
    twice = common.frugal(lambda batches: (2 * x for x in batches))
    assert list(twice(iter([1, 2]))) == [2, 4] and calls == [1]
    cut = twice(iter([1, 2]))
    assert next(cut) == 2
    cut.close()
    assert calls == [1, 1]
    used, frugal = [], packing.frugal
    monkeypatch.setattr(packing, "frugal", lambda run: used.append(1) or frugal(run))
    packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "unused")
    assert used == [1]
