"""Power-of-two packing.

A document's ids are cut into pieces of ``MAX_TOKENS`` and then of the binary digits of the rest, largest first; every
piece is a sequence of its own, of a power-of-two length, so no sequence crosses documents and nothing is padded.

Equal lengths are bucketed: sequences are numbered within their bucket, whose number (the power of two) leads a sequence's id, and each
task puts out its pieces bucket by bucket, so that files hold each bucket as one run of rows and a batch of equal lengths is read
from neighbouring rows. :func:`write_buckets` makes a folder of each bucket.

Documents are encoded word by word with a bounded memory of known words, which gives the tokenizer's own ids: its model
works on one pre-token at a time. Texts with characters outside the plain set go through the tokenizer's own normalizer and
pre-tokenizer, and texts that hold a special token through the tokenizer as a whole.

Defined results: a null or empty text is the end id alone, one piece of length one; repeated rows and ids give separate
sequences; a null id is kept; a very long text is encoded a stretch at a time, unless it holds a special token; pieces of one length are in
the order of the table; an empty table gives no pieces; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm.common import frugal, stretches, table

MAX_TOKENS = 2048
END_ID = 1
#: Known words of each kind per Python worker; beyond this the memory starts afresh. It bounds memory, not results.
KNOWN_WORDS = 300_000

#: Characters of a text that are split at once. Pre-tokens never hold white space, so cuts there change nothing.
STRETCH = 1 << 20

# How the tokenizer file splits a normalized text, for lower-case ASCII and Latin-1 letters.
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
BREAK = re.compile("[ \\t\\n\\r]")
NOT_PLAIN = re.compile("[^\t-\r -~ß-öø-ÿ]")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a letter: printable Latin-1 stands for itself, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(256 + i) for i, b in enumerate(others)}


class _Known(dict):
    """Ids of pre-tokens, found as they are first asked for. ``spelled``: keys are in byte letters already."""

    def __init__(self, model, spelled: bool) -> None:
        self.tokenize, self.letters, self.spelled = model.tokenize, _byte_letters(), spelled

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        spelled = word if self.spelled or word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.tokenize(spelled))
        self[word] = ids
        return ids


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.plain, self.other = _Known(self.tokenizer.model, False), _Known(self.tokenizer.model, True)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(text) > STRETCH:
            return b"".join(map(self._encode, stretches(text, STRETCH, BREAK)))
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        lowered = text.lower()
        if NOT_PLAIN.search(lowered):
            return b"".join([self.other[w] for w, _ in self.split(self.normalize(text))])
        return b"".join(map(self.plain.__getitem__, PLAIN_SPLIT.findall(lowered)))


def pieces(n: int, longest: int = MAX_TOKENS) -> list[int]:
    """``n`` as whole ``longest`` pieces and then its binary digits, largest first. ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _packer(path: str, longest: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = WordEncoder(path), np.array([end_id], dtype="<u4").tobytes()
        # a partition numbers its own sequences, in each bucket: 4 bits of the bucket, 23 of the partition, 36 of the number
        numbers = [k << 59 | TaskContext.get().partitionId() << 36 for k in range(longest.bit_length())]

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(x, t) for x, t in zip(out, types)]
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
        types = [*[pa.int64()] * 7, pa.int32()]
        if with_ids:
            names, types = [*names, "ids"], [*types, pa.binary()]
        out: list[list] = [[] for _ in names]
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py()) + end
                doc, total, start = doc_id.as_py(), len(ids) // 4, 0
                for length in pieces(total, longest):
                    part = ids[4 * start : 4 * (start + length)]
                    bucket = length.bit_length() - 1
                    row = (doc, start, length, zlib.crc32(part), total, numbers[bucket], 0, bucket)
                    for column, value in zip(out, (*row, part) if with_ids else row):
                        column.append(value)
                    start += length
                    numbers[bucket] += 1
                held += len(ids)
                if len(out[0]) >= 10_000 or held > 1 << 25:
                    held = 0
                    yield flush()
        if out[0]:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", longest: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket`` and, with ``with_ids``, ``ids``.

    ``length`` is 2 to the power of ``bucket``. Rows are in order of their sequences within each partition. ``ids`` are unsigned little-endian 32-bit. The path must be readable on every executor. No
    shuffle: a task packs the documents it reads, so a lost task is simply run again and numbers the same sequences.
    """
    if longest & (longest - 1) or not 1 <= longest <= 1 << 15:
        raise ValueError("longest must be a power of two, and 32768 at most")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids binary" * with_ids
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(frugal(_packer(tokenizer_path, longest, end_id, with_ids)), schema).sortWithinPartitions("sequence_id")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the pieces by length, ``length=1/`` to ``length=2048/``, so that a batch is read from one bucket."""
    packed.write.partitionBy("length").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
