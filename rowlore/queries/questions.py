"""Questions over the catalog and the records: T6, T7, T13, T14."""

from datetime import datetime

from pyspark.sql import functions as F

from rowlore.functions.sentences import row_sentence
from rowlore.operators.store import RecordStore
from rowlore.operators.text import chunk_text, embed_text
from rowlore.plans.answer import ask_documents, ask_tabular, derive_filters, rank_datasets
from rowlore.plans.ingest import ingest_tabular, store_schemas
from rowlore.plans.prompts import TEMPLATES
from rowlore.plans.sizing import materialize, scratch_dir, spread
from rowlore.queries.book import PART_COLUMNS, Book, as_record_form, catalog, catalog_columns_sql, cells_sql, load, load_spread, parts

BOOK = Book()
WIDTH = 64
QUESTION_SQL = "'Show every ' || lower(p_type) || ' item named ' || p_name || ' of brand ' || p_brand || ' with a size of ' || p_size"
WORDS = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: t <> '')"
NAME_WORDS = "list_filter(string_split_regex(lower(replace({c}, '_', ' ')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: t <> '')"


def part_questions(spark, sf):
    """One question per part."""
    question = F.concat(
        F.lit("Show every "), F.lower("p_type"), F.lit(" item named "), "p_name", F.lit(" of brand "), "p_brand",
        F.lit(" with a size of "), F.col("p_size").cast("string"),
    )
    return load_spread(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), question.alias("question"))


@BOOK.query("rank_datasets", f"""
WITH c AS ({catalog_columns_sql()}),
w AS (SELECT dataset, word, max(weight) AS weight FROM (
  SELECT dataset, unnest({NAME_WORDS.format(c='dataset')}) AS word, 3 AS weight FROM c
  UNION ALL SELECT dataset, unnest({NAME_WORDS.format(c='col')}), 2 FROM c
  UNION ALL SELECT dataset, unnest({WORDS.format(c='v')}), 1 FROM (SELECT dataset, unnest(vals) AS v FROM c)) GROUP BY ALL),
q AS (SELECT p_partkey AS question_id, unnest(list_distinct({WORDS.format(c=QUESTION_SQL)})) AS word FROM part)
SELECT question_id, dataset AS dataset_name, CAST(sum(weight) AS BIGINT) AS score,
  CAST(row_number() OVER (PARTITION BY question_id ORDER BY sum(weight) DESC, dataset) AS INTEGER) AS rank
FROM q JOIN w USING (word) GROUP BY question_id, dataset QUALIFY rank <= 3""")
def q_rank_datasets(spark, sf):
    return rank_datasets(part_questions(spark, sf), catalog(spark, sf))


@BOOK.query("derive_filters", f"""
WITH c AS ({catalog_columns_sql(('part',))}),
v AS (SELECT 'data.' || col AS key, value, array_to_string({WORDS.format(c='value')}, ' ') AS phrase
  FROM (SELECT col, unnest(vals) AS value FROM c) WHERE len({WORDS.format(c='value')}) > 0),
q AS (SELECT p_partkey AS question_id, ' ' || array_to_string({WORDS.format(c=QUESTION_SQL)}, ' ') || ' ' AS text FROM part),
m AS (SELECT question_id, key, string_agg(DISTINCT value, '|' ORDER BY value) AS vals, row_number() OVER (PARTITION BY question_id ORDER BY key) AS n,
    count(*) OVER (PARTITION BY question_id) AS fields FROM q JOIN v ON contains(text, ' ' || phrase || ' ') GROUP BY question_id, key)
SELECT question_id, CAST(0 AS INTEGER) AS ordinal, key, vals AS "values" FROM m
UNION ALL SELECT question_id, CAST(n AS INTEGER), key, vals FROM m WHERE fields > 1
UNION ALL SELECT question_id, 0, NULL, NULL FROM q WHERE question_id NOT IN (SELECT question_id FROM m)""")
def q_derive_filters(spark, sf):
    asked = part_questions(spark, sf).withColumn("dataset_name", F.lit("part"))
    found = derive_filters(asked, catalog(spark, sf, ("part",)))
    return found.select("question_id", "ordinal", "key", F.array_join("values", "|").alias("values"))


def part_records(spark, sf):
    """Parts as searchable records of one collection, embedded by their sentence."""
    df = spread(parts(spark, sf))
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in PART_COLUMNS])
    text = row_sentence(F.lit("part"), F.col("p_partkey") + 2, entries)
    records = as_record_form(df.withColumn("text", text), "part", "p_partkey", PART_COLUMNS, "text")
    return records.withColumn("collection", F.lit("tabular")).withColumn("embedding", embed_text(F.col("text"), WIDTH))


def bag_sql(rows: str) -> str:
    """Rows (id, bucket, w): the default embedding of rows (id, text)."""
    return f"""SELECT id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS w FROM (
  SELECT id, ('0x' || substr(md5(word), 1, 7))::BIGINT % {WIDTH} AS bucket, count(*) AS n
  FROM (SELECT id, unnest({WORDS.format(c='text')}) AS word FROM ({rows})) GROUP BY ALL)"""


def prompt_sql(question: str) -> str:
    """Context, sources and prompt of hits (question_id, n, source, id, text) numbered from 1."""
    template = TEMPLATES["answer"].replace("'", "''")
    return f"""replace(replace(replace('{template}', '{{sources}}', coalesce(sources, '')), '{{context}}', coalesce(context, '')),
  '{{question}}', {question})"""


CONTEXT_SQL = """SELECT question_id, CAST(count(*) AS INTEGER) AS hits,
  string_agg('ROW ' || n || ': [' || source || ' #' || id || '] ' || text, chr(10) ORDER BY n) AS context,
  string_agg('- ' || source || ' #' || id, chr(10) ORDER BY n) FILTER (n <= {limit}) AS sources FROM hits GROUP BY question_id"""

ASKED_SQL = "SELECT DISTINCT p_brand || '/' || p_type AS question_id, 'Which ' || lower(p_type) || ' part has the brand ' || p_brand AS question FROM part"
PART_SENTENCE_SQL = "'Record from worksheet part, row ' || (p_partkey + 2) || ': ' || " + " || ' ' || ".join(
    f"'{c} is ' || {c} || '.'" for c in PART_COLUMNS
)


@BOOK.query("ask_tabular", f"""
WITH c AS ({catalog_columns_sql()}), q AS ({ASKED_SQL}),
w AS (SELECT dataset, word, max(weight) AS weight FROM (
  SELECT dataset, unnest({NAME_WORDS.format(c='dataset')}) AS word, 3 AS weight FROM c
  UNION ALL SELECT dataset, unnest({NAME_WORDS.format(c='col')}), 2 FROM c
  UNION ALL SELECT dataset, unnest({WORDS.format(c='v')}), 1 FROM (SELECT dataset, unnest(vals) AS v FROM c)) GROUP BY ALL),
best AS (SELECT question_id, dataset FROM (SELECT question_id, unnest(list_distinct({WORDS.format(c='question')})) AS word FROM q) JOIN w USING (word)
  GROUP BY question_id, dataset QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY sum(weight) DESC, dataset) = 1),
v AS (SELECT dataset, col, value, array_to_string({WORDS.format(c='value')}, ' ') AS phrase
  FROM (SELECT dataset, col, unnest(vals) AS value FROM c) WHERE len({WORDS.format(c='value')}) > 0),
m AS (SELECT question_id, col, list(DISTINCT lower(value)) AS vals, row_number() OVER (PARTITION BY question_id ORDER BY col) AS n,
    count(*) OVER (PARTITION BY question_id) AS fields FROM q JOIN best USING (question_id) JOIN v USING (dataset)
  WHERE contains(' ' || array_to_string({WORDS.format(c='question')}, ' ') || ' ', ' ' || phrase || ' ') GROUP BY question_id, col),
f AS (SELECT question_id, 0 AS ordinal, col, vals FROM m UNION ALL SELECT question_id, n, col, vals FROM m WHERE fields > 1
  UNION ALL SELECT question_id, 0, NULL, NULL FROM q WHERE question_id NOT IN (SELECT question_id FROM m)),
size AS (SELECT question_id, ordinal, count(col) AS wanted FROM f GROUP BY ALL),
met AS (SELECT question_id, ordinal, CAST(seq AS VARCHAR) AS id, count(*) AS got FROM f JOIN ({cells_sql('part', 'p_partkey', PART_COLUMNS)}) x
  ON x.col = f.col AND list_contains(f.vals, lower(x.v)) GROUP BY ALL),
found AS (SELECT question_id, ordinal, id FROM met JOIN size USING (question_id, ordinal) WHERE got = wanted
  UNION ALL SELECT question_id, ordinal, CAST(p_partkey AS VARCHAR) FROM size, part WHERE wanted = 0),
texts AS (SELECT CAST(p_partkey AS VARCHAR) AS id, {PART_SENTENCE_SQL} AS text FROM part),
rb AS ({bag_sql('SELECT id, text FROM texts')}), qb AS ({bag_sql('SELECT question_id AS id, question AS text FROM q')}),
rn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM rb GROUP BY id), qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qb GROUP BY id),
dots AS (SELECT question_id, ordinal, found.id, coalesce(sum(rb.w * qb.w), 0) AS dot FROM found JOIN rb ON rb.id = found.id
  LEFT JOIN qb ON qb.id = found.question_id AND qb.bucket = rb.bucket GROUP BY ALL),
ranked AS (SELECT question_id, ordinal, dots.id, row_number() OVER (PARTITION BY question_id, ordinal
    ORDER BY round((1 + dot / rn.norm / qn.norm) / 2, 10) DESC, dots.id) AS rank FROM dots JOIN rn ON rn.id = dots.id JOIN qn ON qn.id = question_id),
once AS (SELECT * FROM ranked WHERE rank <= 20 QUALIFY row_number() OVER (PARTITION BY question_id, id ORDER BY ordinal, rank) = 1),
hits AS (SELECT question_id, id, text, 'part.parquet' AS source, row_number() OVER (PARTITION BY question_id ORDER BY ordinal, rank) AS n FROM once JOIN texts USING (id)),
ctx AS ({CONTEXT_SQL.format(limit=20)})
SELECT question_id, dataset AS dataset_name, hits, md5(context) AS context, md5({prompt_sql('question')}) AS prompt
FROM q LEFT JOIN best USING (question_id) LEFT JOIN ctx USING (question_id)""")
def q_ask_tabular(spark, sf):
    """One question per brand and type, answered from all parts."""
    asked = load(spark, sf, "part").select("p_brand", "p_type").distinct()
    question = F.concat(F.lit("Which "), F.lower("p_type"), F.lit(" part has the brand "), "p_brand")
    questions = asked.select(
        F.concat_ws("/", "p_brand", "p_type").alias("question_id"), question.alias("question"), F.lit("tabular").alias("collection")
    ).withColumn("question_vector", embed_text(F.col("question"), WIDTH))
    done = ask_tabular(questions, part_records(spark, sf), catalog(spark, sf), 20)
    return done.select("question_id", "dataset_name", "hits", F.md5("context").alias("context"), F.md5("prompt").alias("prompt"))


@BOOK.query("ingest_and_ask", """
SELECT p_brand || '/' || p_type AS question_id, 'parts' AS dataset_name, CAST(count(*) AS INTEGER) AS hits, CAST(count(*) AS INTEGER) AS lines FROM part GROUP BY ALL""")
def q_ingest_and_ask(spark, sf):
    """Parts as CSV files, ingested, stored, and asked for by brand and type from the store."""
    root = scratch_dir(spark, "ask")
    part = load(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    part.write.option("header", True).csv(f"{root}/in")
    done = ingest_tabular(spark, f"{root}/in", "csv", "parts", datetime(2024, 1, 5), "tabular", width=WIDTH)
    store = RecordStore(spark, f"{root}/store")
    store.create("tabular", WIDTH, 4)
    store.upsert("tabular", done.records)
    asked = part.select("p_brand", "p_type").distinct().select(
        F.concat_ws("/", "p_brand", "p_type").alias("question_id"), F.concat(F.lit("Which parts of "), "p_type", F.lit(" are by "), "p_brand").alias("question"),
        F.lit("tabular").alias("collection"), "p_brand", "p_type",
    )
    fields = F.create_map(F.lit("data.p_brand"), F.array("p_brand"), F.lit("data.p_type"), F.array("p_type"))
    filters = asked.select("question_id", F.lit(0).alias("ordinal"), F.explode(fields).alias("key", "values"))
    questions = asked.select("question_id", "question", "collection", embed_text(F.col("question"), WIDTH).alias("question_vector"))
    records = store.read("tabular").withColumn("collection", F.when(F.col("id").isNotNull(), "tabular"))
    schemas = materialize(store_schemas(None, done.schemas), "schemas")
    found = ask_tabular(questions, records, schemas, 0, filters, strict=True)
    return found.select("question_id", "dataset_name", "hits", F.size(F.split("context", "\nROW ")).alias("lines"))


@BOOK.query("ask_documents", f"""
WITH chunks AS (SELECT doc_id || '-' || i AS id, source, array_to_string(toks[i * 900 + 1 : i * 900 + 1000], ' ') AS text
  FROM (SELECT doc_id, source, toks, unnest(range(CAST(ceil(greatest(len(toks) - 1000, 0) / 900.0) AS BIGINT) + 1)) AS i
    FROM (SELECT doc_id, source, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda t: t <> '') AS toks FROM documents) WHERE len(toks) > 0)),
cb AS ({bag_sql('SELECT id, text FROM chunks')}), qb AS ({bag_sql('SELECT item_id AS id, text FROM benchmark')}),
cn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM cb GROUP BY id), qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qb GROUP BY id),
dots AS (SELECT qb.id AS question_id, cb.id, sum(cb.w * qb.w) AS dot FROM cb JOIN qb USING (bucket) GROUP BY ALL),
ranked AS (SELECT question_id, dots.id, row_number() OVER (PARTITION BY question_id ORDER BY round((1 + dot / cn.norm / qn.norm) / 2, 10) DESC, dots.id) AS n
  FROM dots JOIN cn ON cn.id = dots.id JOIN qn ON qn.id = question_id),
hits AS (SELECT question_id, n, id, source, text FROM ranked JOIN chunks USING (id) WHERE n <= 5),
ctx AS ({CONTEXT_SQL.format(limit=5)})
SELECT item_id AS question_id, hits, md5(context) AS context, md5({prompt_sql('text')}) AS prompt FROM benchmark LEFT JOIN ctx ON question_id = item_id""")
def q_ask_documents(spark, sf):
    """Every benchmark text asked against the chunks of all documents."""
    chunks = chunk_text(load_spread(spark, sf, "documents", "doc_id", "source", "text")).select(
        F.concat_ws("-", "doc_id", "chunk_number").alias("id"), "source", "chunk_text",
        F.create_map(F.lit("file"), F.array("source")).alias("tags"), embed_text(F.col("chunk_text"), WIDTH).alias("embedding"),
    )
    questions = load(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"), embed_text(F.col("text"), WIDTH).alias("question_vector")
    )
    done = ask_documents(questions, chunks)
    return done.select("question_id", "hits", F.md5("context").alias("context"), F.md5("prompt").alias("prompt"))
