"""The operators of this subpackage as queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlore.llm import quality_model, toxicity
from rowlore.llm.chat import FORMAT_SQL, format_conversations
from rowlore.llm.common import documents
from rowlore.llm.lines import LINES_SQL, dedup_lines
from rowlore.llm.near_vectors import near_vectors
from rowlore.llm.packing import pack_documents
from rowlore.llm.phrases import PHRASES_SQL, mine_phrases
from rowlore.llm.pieces import encode_decode
from rowlore.llm.prefix_trie import TRIE_SQL, prefix_trie
from rowlore.llm.quality_rules import judge
from rowlore.llm.secret_scan import find_secrets
from rowlore.llm.simhash import near_groups
from rowlore.llm.suffixes import without_earlier_passages

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir)).drop("found")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_earlier_passages(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that labels call good: the target of the likelihood ratio."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(documents(spark, sf_dir).select("doc_id", "text"), trusted(spark, sf_dir))
    return found.drop("text")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_model.score(docs, quality_model.fit(docs, labels(spark, sf_dir)))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(documents(spark, sf_dir))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def all_queries() -> dict[str, Query]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and name[2].isdigit()}


NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
reached(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least
"""


def all_sql() -> dict[str, str]:
    return {
        "op8_chat_format": FORMAT_SQL, "op10_near_vectors": NEAR_VECTORS_SQL, "op11_phrases": PHRASES_SQL,
        "op12_line_dedup": LINES_SQL, "op13_prefix_trie": TRIE_SQL,
    }
