"""The corpus pipeline: documents in, packed pieces out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents.

Defined results: an empty table passes every stage empty; nulls, empty and very long texts, repeated rows and further
columns are handled as each operator states. A document that a stage leaves without a word, though it had some, goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm import decontaminate, line_dedup, near_copies as shingled, packing, quality, simhash
from frametide.llm.common import dropped, free_name, scratch_path, scratch_scope, small_batches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or stand on a rejected host go."""
    return quality.keep_good(docs)


def line_spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from all documents but their first; so do documents that were nothing else."""
    lost = free_name(docs, "lost__")
    cleaned = line_dedup.clean(docs, removed=lost)
    return cleaned.filter((F.col(lost) == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).withColumn("n_chars", F.when(F.col(lost) == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word similarity of 0.8 or more; found by Golay links of SimHash fingerprints and by MinHash bands) the document with the smallest id stays."""
    return simhash.keep_one(docs, find=shingled.near_duplicates)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths; the columns of the packing query."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_spread),
    ("near duplicates", near_copies),
    ("decontamination", benchmark_passages),
    ("packing", packed),
]
#: SQL can express neither the components nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents. A stage's scratch tables, and its input if that was a stage's output, go when it is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        with scratch_scope(spark), small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        dropped(spark, *before)
        docs, before = spark.read.parquet(path), [path]
    return docs
