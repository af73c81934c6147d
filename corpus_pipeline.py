"""The corpus pipeline: documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and gives the columns of documents; the last
adds the token ids. Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, mixing, near_texts, suffix_dedup, toxicity
from quillstone.llm.common import drop, table, written

#: Bytes of a passage that the suffix-array stage removes wherever it occurs twice: some 45 words.
PASSAGE = 240


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of ``labels`` predicts to be toxic go; all others stay as they are, nulls, empty texts and repeats too."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.

    Null and empty texts are a group; of equal documents the smallest id stays, a null id last; an empty table stays empty.
    """
    return near_texts.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice or more are cut from the texts; every document stays."""
    return suffix_dedup.without_repeats(docs, PASSAGE)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each source that the mix takes: documents taken whole, in part or twice; those without words stay as they are."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; ``text`` is what they decode to, a null text becomes empty; every row stays."""
    found = bpe.encode(docs, decoded_col="__decoded")
    return found.select(*(F.col("__decoded").cast("string").alias("text") if c == "text" else c for c in docs.columns), "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("suffix_array_dedup", without_repeated_passages),
    ("mixing", mixed_to_weights),
    ("byte_bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(*before)  # each stage's rows are written, so what it read can go
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
