"""Documents to training tokens: quality rules, near duplicates, secrets, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import bpe, likeness, mixing, quality, secrets
from lodestat.llm.common import ready, saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    ready(spark)
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, Jaccard of 0.8 or more) the document with the least id."""
    ready(spark)
    return likeness.deduplicate(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    ready(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each document and pass."""
    ready(spark)
    return mixing.mix_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: the number of its tokens and hashes of them and of what they decode to."""
    ready(spark)
    return bpe.token_digests(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("secret scans", secret_scans), ("mixing sources", mix_sources), ("byte-level BPE", byte_bpe)]

#: The fingerprints, automata, draws and merges have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
