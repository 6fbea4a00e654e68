"""The training-corpus pipeline: five stages over ``documents``, each on what the one before kept.

1. quality: documents that the kernel classifier scores below its threshold go.
2. lines: boilerplate lines of many sites go from the texts; documents stay, n_chars follows.
3. near_copies: of each group of near copies (five words, Jaccard 0.8) the row with the smallest doc_id stays.
4. mix: sources are brought to target weights; a document appears as often as it is taken.
5. pieces: texts are encoded, decoded again and compared.

Every stage but the last returns the columns of ``documents``; the last adds ``ids``,
``n_ids`` and ``round_trip``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelab.llm import jaccard_join, line_spread, mixing, pieces, quality_kernel
from sitelab.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_kernel.accepted_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_spread.cleaned_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_text(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(pieces.default_model())
    coded = pieces.round_trips(docs, vocabulary)
    added = [F.col("ids"), F.size("ids").cast("long").alias("n_ids"), "round_trip"]
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("ids", "n_ids", "round_trip")]
    return coded.select(*kept, *added)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: Learned scores, Newton steps and piece lattices have no SQL form; the tests run each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    return functools.reduce(
        lambda kept, stage: stored(stage[1](spark, kept, sf_dir), "corpus"), STAGES, docs
    )
