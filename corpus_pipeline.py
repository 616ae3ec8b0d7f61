"""Corpus cleaning: quality, repeated lines, near duplicates, benchmark passages, tokens.

Every stage takes the documents that its predecessor kept, whole. Extra columns, whatever their names, go through unchanged.
An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, lines, quality, simhash
from tessera.llm.common import materialize
from tessera.llm.registry import QUALITY_AT, table, vocabulary


#: Similarity of five-word shingle sets from which a text is a copy of another, for the line stage and the near-duplicate stage
#: alike: what the one leaves to the other, the other takes.
COPY = 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null and empty texts are scored as texts without words. Rows that repeat an id, and rows of a
    null id, are scored each."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"), QUALITY_AT)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines and sentences are cut out of the texts, but for their first occurrence by doc_id. Copies of whole
    texts (a similarity of 0.8 or more to the text they repeat) keep what they share with it: the next stage judges them by the
    same similarity, and couldn't by what the runs would leave. No row goes: a text may
    become empty. Null texts and rows of a null id stay as they are; rows that repeat an id lose a run only where all
    of them hold it."""
    return lines.dedup_runs(docs, copies=COPY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest id. Null and empty texts are copies of each other;
    rows of a null id stay, and all rows that repeat a kept id."""
    return simhash.drop_near_duplicates(docs, least=COPY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go, every row by its text. Null and empty texts stay; null items and those of
    fewer than eight tokens remove nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row, of a null or repeated id too; null and empty texts
    have no ids."""
    return bpe.encode_documents(docs, vocabulary(), with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("lines", cut_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# SQL can't express the classifier, runs of lines, SimHash or BPE; the tests compare with brute force instead
ORACLE_SQL = None
