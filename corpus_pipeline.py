"""A training corpus from ``documents``: toxic documents go, exact copies go, one document
of each class of near copies stays, the sources are mixed to their weights, and what is
taken is encoded for training.

Every stage is ``f(spark, docs, sf_dir)``; its result is written as Parquet to the shared
folder and read again as the next stage's ``docs``, so a lost executor costs at most the
running stage. All stages but the last return the columns of ``documents``.

Nulls, repeated rows and empty tables are handled as the operators' docstrings say: a null
text is an empty text and passes the filters, rows without an id are dropped as exact copies
like any others but never as near copies, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.llm import exact_dedup, mixing, ngram_join, sentencepiece_codec, toxicity
from tracegraph.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, trained on the labels outside its held-out part."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the smallest id of each class stays."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rows are repeated or left out as the mix takes them."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ``(doc_id, n_tokens, ids, exact)``; ``exact``: decoding gives the text back."""
    coded = sentencepiece_codec.round_trip(docs)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

#: a trained model, components and a vocabulary are beyond SQL: the tests compare run() with
#: a brute-force version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
