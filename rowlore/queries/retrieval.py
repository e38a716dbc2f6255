"""Record retrieval: V1-V6, C7, J5, F21, A7, T9, T10."""

from pyspark.sql import functions as F

from rowlore.operators.retrieve import list_records, records_by, similar, similar_batch
from rowlore.operators.searchable import VectorIndex
from rowlore.plans.answer import context_blocks, search_multi_filter
from rowlore.plans.sizing import scratch_dir
from rowlore.queries.book import (
    PART_COLUMNS, VECTORS, Book, as_record_form, customers, documents, load, load_spread, parts, vectors,
)

BOOK = Book()
# The question of the single-question queries: a fixed parameter.
QUESTION = [((i * 7) % 13 - 6) / 10 for i in range(64)]
QUESTION_SQL = "[" + ", ".join(str(x) for x in QUESTION) + "]::DOUBLE[]"
SCORE = f"(1 + list_cosine_similarity(embedding::DOUBLE[], {QUESTION_SQL})) / 2"
HYBRID = [{"lang": "EN", "data.label": ["1", "2", "3"]}, {"source": ["src1", "SRC2"], "data.label": 7}]
HYBRID_SQL = "lower(lang) = 'en' AND label IN (1, 2, 3) OR source IN ('src1', 'src2') AND label = 7"


def top_sql(where: str, limit: str, floor: str = "true", table: str = "embeddings") -> str:
    return f"""SELECT vec_id, label, round(score, 6) AS score FROM (SELECT *, {SCORE} AS score FROM {table} WHERE {where}
  ORDER BY round({SCORE}, 10) DESC, vec_id {limit}) WHERE {floor}"""


def shown(df):
    return df.select("vec_id", "label", F.round("score", 6).alias("score"))


@BOOK.query("vector_topk", top_sql("true", "LIMIT 5"))
def q_vector_topk(spark, sf):
    return shown(similar(load(spark, sf, "embeddings"), QUESTION, record_id="vec_id"))


@BOOK.query("vector_topk_index", top_sql("true", "LIMIT 5"))
def q_vector_topk_index(spark, sf):
    """The same through an index of blocks around pivots, which reads those only that can hold a hit."""
    index = VectorIndex(spark, scratch_dir(spark, "vectors"), "vec_id").build(load(spark, sf, "embeddings"))
    return shown(index.search(QUESTION)[0])


def hybrid_search(spark, sf, limit=20):
    return shown(similar(vectors(spark, sf), QUESTION, limit, HYBRID, record_id="vec_id"))


@BOOK.query("vector_hybrid", top_sql(HYBRID_SQL, "LIMIT 20", table=VECTORS))
def q_vector_hybrid(spark, sf):
    return hybrid_search(spark, sf)


@BOOK.query("vector_unlimited", top_sql("true", ""))
def q_vector_unlimited(spark, sf):
    return shown(similar(load(spark, sf, "embeddings"), QUESTION, 0, record_id="vec_id"))


@BOOK.query("vector_min_relevance", top_sql("true", "LIMIT 50", "score >= 0.6"))
def q_vector_min_relevance(spark, sf):
    return shown(similar(load(spark, sf, "embeddings"), QUESTION, 50, least=0.6, record_id="vec_id"))


@BOOK.query("vector_topk_batch", """
SELECT question_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 10) DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS question_id, r.vec_id, (1 + list_cosine_similarity(r.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2 AS score
    FROM embeddings q, embeddings r)) WHERE rank <= 5""")
def q_vector_topk_batch(spark, sf):
    """Every stored vector asked against all of them."""
    stored = load_spread(spark, sf, "embeddings")
    questions = stored.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question_vector"))
    found = similar_batch(stored, questions, 5, record_id="vec_id")
    return found.select("question_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@BOOK.query("list_records", """
SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE lower(c_mktsegment) IN ('building', 'machinery') AND lower(r_name) = 'asia' ORDER BY c_custkey LIMIT 100""")
def q_list_records(spark, sf):
    filters = {"data.c_mktsegment": ["building", "machinery"], "region": "asia"}
    return list_records(customers(spark, sf), filters, 100, ("c_custkey",)).select("c_custkey", "c_name")


def part_records(spark, sf):
    return as_record_form(parts(spark, sf), "part", "p_partkey", PART_COLUMNS)


def by_sql(where: str) -> str:
    return f"""SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey + 2 AS INTEGER) AS row_number, p_name
  FROM part WHERE {where} ORDER BY p_partkey LIMIT 100"""


@BOOK.query("records_by_schema", by_sql("true"))
def q_records_by_schema(spark, sf):
    old = part_records(spark, sf).withColumn("schema_id", F.array("schema_id"))
    found = records_by(old, "schema_id", "schema_part")
    return found.select("id", "row_number", F.try_variant_get("data", "$.p_name", "string").alias("p_name"))


@BOOK.query("records_by_batch", by_sql("p_partkey % 4 = 3"))
def q_records_by_batch(spark, sf):
    found = records_by(part_records(spark, sf), "import_batch_id", "batch_3")
    return found.select("id", "row_number", F.try_variant_get("data", "$.p_name", "string").alias("p_name"))


@BOOK.query("search_multi_filter", f"""
WITH q AS (SELECT label AS question_id, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label),
f AS (SELECT question_id, 0 AS ordinal, ['en', 'fr', 'de', 'es'][question_id % 4 + 1] AS lang, NULL AS source FROM q
  UNION ALL SELECT question_id, 1, NULL, 'src' || question_id FROM q UNION ALL SELECT question_id, 2, NULL, NULL FROM q WHERE question_id % 2 = 0),
scored AS (SELECT f.question_id, f.ordinal, v.vec_id, (1 + list_cosine_similarity(v.embedding::DOUBLE[], q.qv::DOUBLE[])) / 2 AS score
  FROM f JOIN q USING (question_id) JOIN {VECTORS} v ON (f.lang IS NULL OR v.lang = f.lang) AND (f.source IS NULL OR v.source = f.source)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, ordinal ORDER BY round(score, 10) DESC, vec_id) AS rank FROM scored)
SELECT question_id, vec_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 15
QUALIFY row_number() OVER (PARTITION BY question_id, vec_id ORDER BY ordinal, rank) = 1""")
def q_search_multi_filter(spark, sf):
    """One question per label, each with two or three filters over all vectors."""
    # A column, as in a stored table, not a constant the optimizer could fold the join key to.
    stored = vectors(spark, sf).withColumn("collection", F.when(F.col("vec_id").isNotNull(), "vec"))
    questions = load(spark, sf, "embeddings").groupBy(F.col("label").alias("question_id")).agg(
        F.min_by("embedding", "vec_id").alias("question_vector")
    ).withColumn("collection", F.lit("vec"))
    n = F.col("question_id")
    lang = F.element_at(F.array(*[F.lit(x) for x in ("EN", "fr", "DE", "es")]), n % 4 + 1)
    asked = F.array(
        F.struct(F.lit(0).alias("ordinal"), F.lit("lang").alias("key"), F.array(lang).alias("values")),
        F.struct(F.lit(1).alias("ordinal"), F.lit("source").alias("key"), F.array(F.concat(F.lit("src"), n.cast("string"))).alias("values")),
    )
    empty = F.struct(F.lit(2).alias("ordinal"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<string>").alias("values"))
    filters = questions.select(
        "question_id", F.inline(F.when(n % 2 == 0, F.array_append(asked, empty)).otherwise(asked))
    )
    hits = search_multi_filter(
        stored, questions, filters, 15, data_map=F.create_map(F.lit("label"), F.col("label").cast("string")), document="vec_id"
    )
    return hits.select("question_id", "vec_id", "ordinal", "rank", F.round("score", 6).alias("score"))


@BOOK.query("answer_context", """
WITH hits AS (SELECT lang AS question_id, doc_id, source, text, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT question_id, (rank - 1) // 64 AS block, min(rank) AS first_row, count(*) AS "rows",
  md5(string_agg('ROW ' || rank || ': [' || source || ' #' || doc_id || '] ' || text, chr(10) ORDER BY rank)) AS context,
  coalesce(string_agg('- file_' || source || ' #' || doc_id, chr(10) ORDER BY rank) FILTER (rank <= 100), '') AS sources
FROM hits GROUP BY question_id, block""")
def q_answer_context(spark, sf):
    """All documents of each language, the longest first, as context in blocks; a hundred of them named as sources."""
    hits = documents(spark, sf).select(
        F.col("lang").alias("question_id"), (-F.col("n_chars")).alias("rank"), "doc_id", "source", "text",
        F.create_map(F.lit("file"), F.array(F.concat(F.lit("file_"), "source"))).alias("tags"),
    )
    blocks = context_blocks(hits, 100, "doc_id", ("rank",))
    return blocks.select("question_id", "block", "first_row", "rows", F.md5("context").alias("context"), "sources")
