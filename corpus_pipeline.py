"""From raw documents to training tokens: five stages, each a table that the next one reads.

Every stage works on all that its predecessor kept. All but the last return the columns of documents.
The near-duplicate stage links texts whose shingles of five words have a Jaccard similarity of 0.8 at least, by
operator 1's anchors over longer fingerprints and a check of the whole sets; the operator's own query keeps its
contract, fingerprints of three words at two differing bits. SQL has no byte pair merges, so there is no
ORACLE_SQL; tests/llm compares the rows with a brute-force version.

Defined results: stages decide row by row, also where doc_ids are null or repeat. A null text, or one without
letters, goes in the first stage. Of equal texts one row stays, of similar ones one; the mix leaves out texts
without words and repeats rows of sources that need several epochs. An empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import byte_bpe, exact_dedup, language_id, mixing, simhash
from tallyspark.llm.common import materialize
from tallyspark.llm.queries import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language with at least even odds, go."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (null first); exactly one row of each."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts the row with the smallest doc_id stays (null last); exactly one row of each."""
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a repeated epoch repeats rows."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of a round trip, a row for each copy."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
