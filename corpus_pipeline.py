"""From raw documents to a mixed, encoded corpus: five stages, each one operator of ``vecdrift.llm``.

Every stage takes all rows its predecessor kept and returns the columns of ``documents`` (the last one: what it reads
back from the written blocks). ``run`` writes each stage's rows to shared storage before the next one reads them.

The stages are models, graphs and hash orders that SQL cannot express, so ``ORACLE_SQL`` is None. Tests hold each stage
on its own input: toxicity against the planted labels, near copies against brute force, decontamination and mixing
against the operators' digests (which are themselves tested by brute force), tokens against the plain library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecdrift.llm import decontaminate, mixing, simhash, token_output, toxicity
from vecdrift.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (linked fingerprints, then five-word similarity 0.8): that of least doc_id."""
    return simhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 as read back from the compressed blocks."""
    return token_output.digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
