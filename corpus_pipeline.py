"""From raw documents to packed token sequences: rules, near copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlore.llm.common import DOCUMENT_COLUMNS, documents
from rowlore.llm.packing import pack_documents
from rowlore.llm.quality_rules import judge
from rowlore.llm.queries import trusted
from rowlore.llm.secret_scan import redact_documents
from rowlore.llm.simhash import drop_near_copies
from rowlore.llm.suffixes import without_earlier_passages
from rowlore.plans.sizing import materialize


def _recounted(docs: DataFrame) -> DataFrame:
    """The columns of `documents`, n_chars as the texts are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; texts stay as they are."""
    return judge(docs.select(*DOCUMENT_COLUMNS), trusted(spark, sf_dir)).filter("kept").select(*DOCUMENT_COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies stays; so do rows without doc_id."""
    return drop_near_copies(docs.select(*DOCUMENT_COLUMNS))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has are cut out; a document may be left with an empty text."""
    return _recounted(without_earlier_passages(docs.select(*DOCUMENT_COLUMNS)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; no document goes."""
    return _recounted(redact_documents(docs.select(*DOCUMENT_COLUMNS)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack_documents(docs.select(*DOCUMENT_COLUMNS))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]
# Tokenising and hashed weights are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
