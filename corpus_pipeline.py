"""A corpus pipeline of four stages: toxicity, near-duplicates, repeated passages, packing.

Each stage gets what the one before it kept, as a written table; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import nearcopies, packing, substring, toxicity
from lodestar.llm.common import stored, table, tidy
from lodestar.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on ``labels``, doesn't reject."""
    chain = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    tidy(spark)
    return toxicity.reject(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8: its smallest doc_id."""
    return nearcopies.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that windows occurring elsewhere cover."""
    return substring.remove_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 2048 tokens."""
    packed = packing.pack(spark, docs, tokenizer("word_bpe_49k.json"), end_id=0, capacity=2048)
    tidy(spark)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: The stages need a trained model, XXH64 and a tokenizer, which SQL has none of; tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
