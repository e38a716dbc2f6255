"""Scalar operators: P1-P8, P10-P19."""

from pyspark.sql import functions as F

from rowlore.functions.maps import entries_to_map, entries_to_variant
from rowlore.functions.names import (
    decode_id, effective_dataset_name, encode_id, normalize_column, normalize_filter_key, normalize_header, row_key,
    sanitize_name,
)
from rowlore.functions.sentences import parse_key_values, parse_sentences, row_sentence
from rowlore.functions.values import (
    BOOLEAN_PATTERN, INTEGER_PATTERN, first_scalar, format_cell, infer_type, typed_value, typed_variant,
    validate_value,
)
from rowlore.operators.records import assemble_record, enrich_payload, extract_lineage, project_record
from rowlore.queries.book import (
    CUSTOMER_COLUMNS, PART_COLUMNS, SPELLED, Book, as_record_form, customers, date_sql, load, load_spread, number_sql, spelled, type_sql,
)

BOOK = Book()


@BOOK.query("normalize_header", """
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}]', '_', 'g'), '_+', '_', 'g'), '_')
  AS header FROM conversations""")
def q_normalize_header(spark, sf):
    return load_spread(spark, sf, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", normalize_header(F.col("text")).alias("header"))


@BOOK.query("normalize_column", """
SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(url || html, '([a-z])([A-Z])', '\\1_\\2', 'g')),
  '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM pages""")
def q_normalize_column(spark, sf):
    return load_spread(spark, sf, "pages", "page_id", "url", "html").select("page_id", normalize_column(F.concat("url", "html")).alias("name"))


@BOOK.query("normalize_filter_key", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'data.' || lower(regexp_replace(p_name || p_type, '([a-z])([A-Z])', '\\1_\\2', 'g'))
  ELSE p_name || p_type END AS key FROM part""")
def q_normalize_filter_key(spark, sf):
    key = F.concat(F.when(F.col("p_size") % 2 == 0, "data.").otherwise(""), "p_name", "p_type")
    return load(spark, sf, "part").select("p_partkey", normalize_filter_key(key).alias("key"))


@BOOK.query("infer_value_type", f"SELECT event_id, {type_sql('v')} AS kind FROM {SPELLED}")
def q_infer_value_type(spark, sf):
    return spelled(spark, sf).select("event_id", infer_type(F.col("v")).alias("kind"))


INT_SQL = f"(regexp_matches(v, '{INTEGER_PATTERN}') AND TRY_CAST(trim(v) AS INTEGER) IS NOT NULL)"


@BOOK.query("to_typed_value", f"""
SELECT event_id, kind, CASE WHEN kind = 'boolean' THEN CAST(trim(v) AS BOOLEAN) END AS b,
  CASE WHEN kind = 'int' THEN CAST(trim(v) AS INTEGER) END AS i,
  CASE WHEN kind = 'double' THEN CAST(replace(trim(v), ',', '') AS DOUBLE) END AS d,
  CASE WHEN kind = 'string' THEN v END AS s
FROM (SELECT *, CASE WHEN v IS NULL OR v = 'NULL' OR v = '' THEN 'null'
  WHEN regexp_matches(v, '{BOOLEAN_PATTERN}') THEN 'boolean' WHEN {INT_SQL} THEN 'int'
  WHEN {number_sql('v')} THEN 'double' ELSE 'string' END AS kind FROM {SPELLED})""")
def q_to_typed_value(spark, sf):
    t = spelled(spark, sf).select("event_id", typed_value(F.col("v")).alias("t"))
    return t.select("event_id", F.col("t.type").alias("kind"), "t.b", "t.i", "t.d", "t.s")


VALID_KIND = "CASE event_type WHEN 'view' THEN 'number' WHEN 'click' THEN 'Boolean' WHEN 'error' THEN 'date' WHEN 'signup' THEN 'string' ELSE 'other' END"


@BOOK.query("validate_value", f"""
SELECT event_id, CASE WHEN v IS NULL THEN true WHEN k = 'number' THEN {number_sql('v')}
  WHEN k = 'Boolean' THEN regexp_matches(v, '{BOOLEAN_PATTERN}') WHEN k = 'date' THEN {date_sql('v')} ELSE true END AS valid
FROM (SELECT *, {VALID_KIND} AS k FROM {SPELLED})""")
def q_validate_value(spark, sf):
    return spelled(spark, sf).select("event_id", validate_value(F.col("v"), F.expr(VALID_KIND)).alias("valid"))


@BOOK.query("format_cell", """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') WHEN 2 THEN CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END
  WHEN 3 THEN o_orderpriority WHEN 4 THEN '' WHEN 5 THEN '#N/A'
  ELSE lpad(CAST(o_orderkey % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 3600 // 60 AS VARCHAR), 2, '0')
    || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS cell FROM orders""")
def q_format_cell(spark, sf):
    n = F.col("o_orderkey") % 7
    kinds = ["date", "number", "boolean", "text", "blank", "error"]
    raws = [
        (F.unix_date(F.to_date("o_orderdate")) + 25569).cast("string"), F.col("o_totalprice").cast("string"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0"), F.col("o_orderpriority"),
        F.lit(None).cast("string"), F.lit("#N/A"),
    ]
    kind, raw = F.lit("time"), (F.col("o_orderkey") % 86400 / 86400).cast("string")
    for i in range(6):
        kind, raw = F.when(n == i, kinds[i]).otherwise(kind), F.when(n == i, raws[i]).otherwise(raw)
    typed = load(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), raw.alias("raw"))
    return typed.select("o_orderkey", format_cell(F.col("kind"), F.col("raw")).alias("cell"))


@BOOK.query("encode_id", """
SELECT doc_id, md5(replace(base64(encode(text)), '=', '_')) AS encoded, md5(text) AS decoded, '' AS malformed FROM documents""")
def q_encode_id(spark, sf):
    coded = load_spread(spark, sf, "documents", "doc_id", "text").select("doc_id", encode_id(F.col("text")).alias("e"))
    bad = decode_id(F.concat(F.lit("%%"), "e"))
    return coded.select(
        "doc_id", F.md5("e").alias("encoded"), F.md5(decode_id(F.col("e"))).alias("decoded"), bad.alias("malformed")
    )


@BOOK.query("project_record", """
SELECT CAST(c_custkey AS VARCHAR) AS id, 'customer.parquet' AS file, c_mktsegment AS segment, c_acctbal AS balance,
  'schema_customer' AS schema_id, 'batch_' || (c_custkey % 4) AS import_batch_id FROM customer""")
def q_project_record(spark, sf):
    records = as_record_form(customers(spark, sf), "customer", "c_custkey", CUSTOMER_COLUMNS)
    shown = project_record(records.withColumn("embedding", F.array(F.lit(0.0))))
    return shown.select(
        "id", "file", F.col("tags.segment")[0].alias("segment"),
        F.try_variant_get("data", "$.c_acctbal", "double").alias("balance"), "schema_id", "import_batch_id",
    )


def part_sentences(spark, sf):
    entries = F.array(*[
        F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in PART_COLUMNS
    ])
    text = row_sentence(
        F.lit("part"), F.col("p_partkey") + 2, entries, F.lit("schema_part"),
        F.concat(F.lit("batch_"), (F.col("p_partkey") % 4).cast("string")),
    )
    return load_spread(spark, sf, "part").select("*", text.alias("text"))


PART_TEXT = "'Record from worksheet part, row ' || (p_partkey + 2) || ': schema_id is schema_part. import_batch_id is batch_' || (p_partkey % 4) || '. ' || " + " || ' ' || ".join(
    f"'{c} is ' || {c} || '.'" for c in PART_COLUMNS
)


@BOOK.query("row_sentence", f"SELECT p_partkey, {PART_TEXT} AS text FROM part")
def q_row_sentence(spark, sf):
    return part_sentences(spark, sf).select("p_partkey", "text")


@BOOK.query("parse_sentence", """
SELECT 'part' AS worksheet, CAST(p_partkey + 2 AS INTEGER) AS row_number, 'schema_part' AS schema_id,
  'batch_' || (p_partkey % 4) AS import_batch_id, p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
def q_parse_sentence(spark, sf):
    found = parse_sentences(part_sentences(spark, sf).select("text"))
    typed = found.select(
        F.col("parsed_worksheet").alias("worksheet"), F.col("parsed_row").alias("row_number"),
        entries_to_map(F.col("parsed_source")).alias("s"), entries_to_variant(F.col("parsed"), typed_variant).alias("d"),
    )
    kinds = {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}
    return typed.select(
        "worksheet", "row_number", "s.schema_id", "s.import_batch_id",
        *[F.try_variant_get("d", f"$.{c}", k).alias(c) for c, k in kinds.items()],
    )


@BOOK.query("parse_key_value", """
SELECT CAST(p_partkey + 2 AS INTEGER) AS row_number, 'part' AS worksheet, p_type AS note, p_name AS part_name,
  p_size AS part_size, p_brand AS part_brand FROM part""")
def q_parse_key_value(spark, sf):
    text = F.concat(
        F.lit("Worksheet: part, Row: "), (F.col("p_partkey") + 2).cast("string"), F.lit("\n_note: "), "p_type",
        F.lit("\nPart Name: "), "p_name", F.lit("\nno colon here\npartSize: "), F.col("p_size").cast("string"),
        F.lit("\nPart Brand: "), "p_brand",
    )
    found = parse_key_values(load_spread(spark, sf, "part").select(text.alias("text"))).withColumn(
        "d", entries_to_variant(F.col("parsed"), typed_variant)
    )
    return found.select(
        F.col("parsed_row").alias("row_number"), F.col("parsed_worksheet").alias("worksheet"),
        entries_to_map(F.col("parsed_source"))["_note"].alias("note"),
        *[F.try_variant_get("d", f"$.part_{c}", k).alias(f"part_{c}") for c, k in (("name", "string"), ("size", "int"), ("brand", "string"))],
    )


@BOOK.query("extract_lineage", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 't_' || c_mktsegment WHEN 1 THEN 'p_' || c_mktsegment ELSE 'r_' || c_mktsegment END AS schema_id,
  CASE c_custkey % 4 WHEN 0 THEN 'pb_' || c_nationkey WHEN 1 THEN 'pb_' || c_nationkey WHEN 2 THEN 'tb_' || c_nationkey ELSE 'rb_' || c_nationkey END AS import_batch_id
FROM customer""")
def q_extract_lineage(spark, sf):
    n, seg, nat = F.col("c_custkey") % 4, F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    text = F.when(n == 0, F.concat(F.lit("schema_id is t_"), seg, F.lit(". import_batch_id is tb_"), nat, F.lit("."))).when(
        n == 2, F.concat(F.lit("X is 1. import_batch_id is tb_"), nat, F.lit(". Y is 2."))
    )
    payload = F.when(n == 0, F.to_variant_object(F.create_map(F.lit("import_batch_id"), F.concat(F.lit("pb_"), nat)))).when(
        n == 1, F.to_variant_object(F.create_map(
            F.lit("schema_id"), F.concat(F.lit("p_"), seg), F.lit("import_batch_id"), F.concat(F.lit("pb_"), nat)
        ))
    )
    row = F.to_variant_object(F.create_map(
        F.lit("schema_id"), F.array(F.concat(F.lit("r_"), seg), F.lit("x")), F.lit("import_batch_id"), F.array(F.concat(F.lit("rb_"), nat))
    ))
    df = load(spark, sf, "customer").select("c_custkey", text.alias("t"), payload.alias("p"), row.alias("d"))
    return extract_lineage(df, F.col("t"), F.col("p"), F.col("d")).select("c_custkey", "schema_id", "import_batch_id")


@BOOK.query("enrich_payload", """
SELECT p_partkey, p_name AS text, '{"p_brand":"' || p_brand || '","p_size":' || p_size || '}' AS tabular_data,
  '{"_rowNumber":"' || (p_partkey + 2) || '"}' AS source_info, 'schema_part' AS schema_id, 'batch_' || (p_partkey % 4) AS import_batch_id
FROM part""")
def q_enrich_payload(spark, sf):
    given = load(spark, sf, "part").select(
        "p_partkey", F.to_variant_object(F.create_map(F.lit("text"), "p_name", F.lit("schema_id"), F.lit("old"))).alias("payload"),
        F.to_variant_object(F.struct("p_brand", "p_size")).alias("data"),
        F.create_map(F.lit("_rowNumber"), (F.col("p_partkey") + 2).cast("string")).alias("source"),
        F.lit("schema_part").alias("schema_id"), F.concat(F.lit("batch_"), (F.col("p_partkey") % 4).cast("string")).alias("import_batch_id"),
    )
    rich = given.select(
        "p_partkey",
        enrich_payload(F.col("payload"), F.col("data"), F.col("source"), F.col("schema_id"), F.col("import_batch_id")).alias("p"),
    )
    names = ("text", "tabular_data", "source_info", "schema_id", "import_batch_id")
    return rich.select("p_partkey", *[F.try_variant_get("p", f"$.{n}", "string").alias(n) for n in names])


@BOOK.query("sanitize_name", r"""
SELECT page_id, regexp_replace(url, '[\\/:*?"<>|\x00-\x1f]+', '_', 'g') AS name FROM pages""")
def q_sanitize_name(spark, sf):
    return load(spark, sf, "pages").select("page_id", sanitize_name(F.col("url")).alias("name"))


@BOOK.query("assemble_record", """
SELECT replace(base64(encode('part-' || p_partkey)), '=', '_') AS id, p_name, p_size, 'part' AS worksheet,
  CAST(p_partkey + 2 AS VARCHAR) AS row_number, CASE WHEN p_size > 25 THEN 'given' ELSE 'schema_part' END AS schema_id,
  'batch_' || (p_partkey % 4) AS source_batch, p_type AS type_tag, CAST(1 AS INTEGER) AS tag_count FROM part""")
def q_assemble_record(spark, sf):
    df = part_sentences(spark, sf).withColumn(
        "tags", F.create_map(F.lit("type"), F.array("p_type"), F.lit("__custom_tabular_data_tag"), F.array(F.lit("x")))
    )
    made = assemble_record(
        df.select("p_partkey", "p_size", "text", "tags"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")),
        schema_id=F.when(F.col("p_size") > 25, "given").otherwise(""),
    )
    return made.select(
        "id", F.try_variant_get("data", "$.p_name", "string").alias("p_name"),
        F.try_variant_get("data", "$.p_size", "int").alias("p_size"),
        F.col("source")["_worksheet"].alias("worksheet"), F.col("source")["_rowNumber"].alias("row_number"),
        "schema_id", F.col("source")["import_batch_id"].alias("source_batch"),
        F.col("tags.type")[0].alias("type_tag"), F.size("tags").alias("tag_count"),
    )


@BOOK.query("row_key", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, sha256('lineitem|lineitem.parquet||' || l_orderkey || '|' || l_linenumber) AS id FROM lineitem""")
def q_row_key(spark, sf):
    key = row_key(F.lit("lineitem"), F.lit("lineitem.parquet"), F.lit(None), F.col("l_orderkey"), F.col("l_linenumber"))
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", key.alias("id")
    )


DATASET_NAMES = "CASE doc_id % 6 WHEN 0 THEN 'Default' WHEN 1 THEN 'tabular' WHEN 2 THEN 'my-Index' WHEN 3 THEN 'servers' WHEN 4 THEN 'a-name-longer-than-twenty' END"


@BOOK.query("effective_dataset_name", f"""
SELECT doc_id, CASE WHEN doc_id % 6 = 3 THEN 'servers' ELSE source END AS dataset FROM documents""")
def q_effective_dataset_name(spark, sf):
    file = F.concat("source", F.lit("."), "lang", F.lit(".csv"))
    return load(spark, sf, "documents").select(
        "doc_id", effective_dataset_name(F.expr(DATASET_NAMES), file).alias("dataset")
    )


@BOOK.query("first_scalar", """
SELECT event_id, CASE event_id % 3 WHEN 2 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS scalar FROM events""")
def q_first_scalar(spark, sf):
    n = F.col("event_id") % 3
    v = (
        F.when(n == 0, F.to_variant_object(F.array("event_type", F.lit("x"))))
        .when(n == 1, F.col("event_type").cast("variant"))
        .otherwise(F.col("user_id").cast("variant"))
    )
    return load(spark, sf, "events").select("event_id", v.alias("v")).select("event_id", first_scalar(F.col("v")).alias("scalar"))
