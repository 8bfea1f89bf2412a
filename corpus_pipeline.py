"""A corpus from raw documents to a token store, in five stages, each of which works on all that the one before it kept.

All stages take null, empty and very long texts, rows that repeat a doc_id or each other, null doc_ids, empty tables, and further columns of any name, which they keep. What each case gives is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, mixing, quality, simhash, token_store
from tracewell.llm.common import materialise, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go. Null and empty texts are scored like any other, by features that are all zero; whole texts count, however long; rows with equal texts get equal scores and stay or go together. Without labels
    every score is 0.5 and all stay. An empty table stays empty."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays, that with the least (doc_id, text digest), null doc_ids last. Of rows equal in both one stays. Texts without words (null, empty) are one group, with fingerprint 0; of ties no row is preferred by its other columns."""
    return simhash.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go (a hit word, and hits 5 % of the words or more). Null and empty texts have no words and stay, as does everything if the benchmark is empty; rows with equal texts stay or go together."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents repeat once an epoch, and the last of each source is cut at its budget. A null source is a source. Documents without words (null, empty) have size 0, of which nothing can be taken, and go; rows equal in doc_id, source and text
    are taken as one document with the words of all. Ties of the random keys go by doc_id, then text."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token store: written in ascending doc_id order (null first) and read back. Null and empty texts are the end id alone; rows that share a doc_id are ordered by the roots of their chunks; equal rows are interchangeable. Other columns are not stored."""
    return token_store.token_store(docs)


STAGES = [("quality", keep_good), ("near_dedup", keep_distinct), ("decontamination", decontaminated), ("mixing", mixed), ("token_store", tokens)]

#: The classifier's scores, the SimHash components and the token ids are beyond SQL; tests compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
