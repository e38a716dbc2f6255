"""Document text: T1-T5, T8, T12."""

from pyspark.sql import functions as F

from rowlore.operators.text import (
    DROPPED_ELEMENTS, ENTITIES, chunk_text, complete_batch, embed_text, extract_text, summarize,
)
from rowlore.plans.prompts import KNOWN, TEMPLATES, UNKNOWN, build_prompt, parse_dataset_reply
from rowlore.queries.book import Book, load, load_spread

BOOK = Book()
TOKENS = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda t: t <> '')"
WORDS = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: t <> '')"
WIDTH = 64


@BOOK.query("chunk_text", f"""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_number, md5(array_to_string(toks[i * 900 + 1 : i * 900 + 1000], ' ')) AS chunk,
  CAST(len(toks[i * 900 + 1 : i * 900 + 1000]) AS INTEGER) AS token_count
FROM (SELECT doc_id, toks, unnest(range(CAST(ceil(greatest(len(toks) - 1000, 0) / 900.0) AS BIGINT) + 1)) AS i
  FROM (SELECT doc_id, {TOKENS} AS toks FROM documents) WHERE len(toks) > 0)""")
def q_chunk_text(spark, sf):
    return chunk_text(load_spread(spark, sf, "documents", "doc_id", "text")).select(
        "doc_id", "chunk_number", F.md5("chunk_text").alias("chunk"), "token_count"
    )


def extract_sql() -> str:
    text = "html"
    for e in DROPPED_ELEMENTS:
        text = f"regexp_replace({text}, '(?is)<{e}\\b[^>]*>.*?</{e}\\s*>', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, entity, char.replace("'", "''"))
    return f"SELECT page_id, trim(regexp_replace({text}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages"


@BOOK.query("extract_text", extract_sql())
def q_extract_text(spark, sf):
    return load_spread(spark, sf, "pages", "page_id", "html").select("page_id", extract_text(F.col("html"), True).alias("text"))


@BOOK.query("summarize_extractive", f"""
WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: trim(x)),
    lambda x: len({WORDS.format(c='x')}) > 0)) AS sentence, unnest(range(10000000)[1:len(list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: trim(x)),
    lambda x: len({WORDS.format(c='x')}) > 0))]) AS position FROM documents),
t AS (SELECT doc_id, position, unnest(list_distinct({WORDS.format(c='sentence')})) AS term FROM s),
n AS (SELECT term, count(*) AS n FROM t GROUP BY term),
scored AS (SELECT doc_id, position, sum(n)::DOUBLE / count(*) AS score FROM t JOIN n USING (term) GROUP BY ALL),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) <= 3)
SELECT doc_id, string_agg(sentence, '. ' ORDER BY position) || '.' AS summary FROM best JOIN s USING (doc_id, position) GROUP BY doc_id""".replace(
    "unnest(range(10000000)[1:len(", "unnest(range(len(").replace("> 0))]) AS position", "> 0)))) AS position"))
def q_summarize_extractive(spark, sf):
    return summarize(load_spread(spark, sf, "documents", "doc_id", "text"), "doc_id")


@BOOK.query("embed_text", f"""
WITH b AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 7))::BIGINT % {WIDTH} AS bucket, count(*) AS n
  FROM (SELECT doc_id, unnest({WORDS.format(c='text')}) AS w FROM documents) GROUP BY ALL)
SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS weight FROM b""")
def q_embed_text(spark, sf):
    docs = load_spread(spark, sf, "documents", "doc_id", "text").select("doc_id", embed_text(F.col("text"), WIDTH).alias("e"))
    cells = docs.select("doc_id", F.posexplode("e").alias("bucket", "w")).where(F.col("w") != 0)
    return cells.select("doc_id", "bucket", F.round(F.col("w").cast("double"), 5).alias("weight"))


PROMPT = TEMPLATES["answer"].replace("'", "''")


@BOOK.query("build_prompt", f"""
SELECT conv_id, turn, md5(replace(replace(replace('{PROMPT}', '{{sources}}', role), '{{context}}', text), '{{question}}', 'turn ' || turn)) AS prompt FROM conversations""")
def q_build_prompt(spark, sf):
    prompt = build_prompt("answer", F.concat(F.lit("turn "), F.col("turn").cast("string")), F.col("text"), F.col("role"))
    return load(spark, sf, "conversations").select("conv_id", "turn", F.md5(prompt).alias("prompt"))


REPLY = """CASE c_custkey % 7 WHEN 0 THEN '["' || c_mktsegment || '", "other"]' WHEN 1 THEN '[]'
  WHEN 2 THEN '```json' || chr(10) || '["' || c_mktsegment || '"]' || chr(10) || '```' WHEN 3 THEN c_name WHEN 4 THEN 'None'
  WHEN 5 THEN '["none"]' ELSE '```' || c_name || '```' END"""


@BOOK.query("parse_dataset_reply", """
SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 2) THEN c_mktsegment WHEN c_custkey % 7 IN (3, 6) THEN c_name END AS dataset FROM customer""")
def q_parse_dataset_reply(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", F.expr(REPLY).alias("reply"))
    return df.select("c_custkey", parse_dataset_reply(F.col("reply")).alias("dataset"))


@BOOK.query("complete_batch", f"""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '{KNOWN}: ROW 1: ' || c_name || ' | ROW 2: ' || c_mktsegment
  ELSE '{UNKNOWN}' END AS completion FROM customer""")
def q_complete_batch(spark, sf):
    rows = F.concat(F.lit("Records:\nROW 1: "), "c_name", F.lit("\n  ROW 2: "), "c_mktsegment", F.lit("\nSources:"))
    prompt = F.when(F.col("c_acctbal") > 0, rows).otherwise("Records:")
    prompts = load(spark, sf, "customer").select("c_custkey", prompt.alias("prompt"))
    return complete_batch(prompts).select("c_custkey", "completion")
