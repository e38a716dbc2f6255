"""The column catalog and value summaries: A1-A6, C1-C10, J1, J2."""

from pyspark.sql import functions as F

from rowlore.operators.aggregates import dedup_first, filterable_fields, top_data_values, top_tag_values
from rowlore.operators.catalog import (
    catalog_text, common_values, describe_all, extract_schema, infer_column_types, latest_schemas, list_datasets,
    list_fields, merge_schema, schema_for_record, to_cells, validate_params,
)
from rowlore.plans.ingest import store_schemas
from rowlore.queries.book import (
    CUSTOMER_COLUMNS, CUSTOMERS, DESCRIBED, PART_COLUMNS, Book, as_record_form, catalog, catalog_columns_sql,
    cells_sql, columns_sql, customers, load, parts, type_sql,
)

BOOK = Book()
EVENT_KEY, EVENT_COLUMNS = DESCRIBED["events"]


@BOOK.query("top_values_data", """
SELECT json_extract_string(props, '$.k') AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def q_top_values_data(spark, sf):
    return top_data_values(load(spark, sf, "events").select(F.try_parse_json("props").alias("data")), "k")


@BOOK.query("top_values_tag", f"SELECT n_name AS value, count(*) AS count FROM {CUSTOMERS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q_top_values_tag(spark, sf):
    return top_tag_values(customers(spark, sf), "nation")


@BOOK.query("filterable_fields", f"""
SELECT kind, field, records FROM (SELECT unnest([{', '.join(f"'{c}'" for c in CUSTOMER_COLUMNS)}]) AS field, 'data' AS kind
  UNION ALL SELECT unnest(['segment', 'nation', 'region']), 'tag'), (SELECT count(*) AS records FROM customer)""")
def q_filterable_fields(spark, sf):
    records = as_record_form(customers(spark, sf), "customer", "c_custkey", CUSTOMER_COLUMNS)
    return filterable_fields(records).select("kind", "field", "records")


def event_cells(spark, sf):
    return to_cells(load(spark, sf, "events"), EVENT_COLUMNS, F.col(EVENT_KEY))


@BOOK.query("infer_column_types", f"SELECT CAST(position AS INTEGER) AS position, col AS \"column\", kind AS data_type FROM ({columns_sql('events', EVENT_KEY, EVENT_COLUMNS)})")
def q_infer_column_types(spark, sf):
    return infer_column_types(event_cells(spark, sf))


@BOOK.query("common_values", f"""
SELECT col AS "column", array_to_string(vals, '|') AS common_values FROM ({columns_sql('events', EVENT_KEY, EVENT_COLUMNS)})""")
def q_common_values(spark, sf):
    return common_values(event_cells(spark, sf)).select("column", F.array_join("common_values", "|").alias("common_values"))


@BOOK.query("extract_schema", f"""
SELECT CAST(position AS INTEGER) AS position, col AS name, col AS normalized_name, kind AS data_type,
  array_to_string(vals, '|') AS common_values FROM ({columns_sql('part', 'p_partkey', PART_COLUMNS)})""")
def q_extract_schema(spark, sf):
    return extract_schema(load(spark, sf, "part"), PART_COLUMNS, "p_partkey").select(
        "position", "name", "normalized_name", "data_type", F.array_join("common_values", "|").alias("common_values")
    )


def merge_sql(previous: str, cells: str, fold) -> str:
    """The fold of new cells into previous columns, as set aggregates."""
    return f"""
WITH prev AS ({previous}), cells AS ({cells}),
new AS (SELECT {fold('col')} AS k, coalesce(v, '') AS v, min(seq) AS seq, arg_min(col, (seq, position)) AS col,
  CASE WHEN bool_and(v IS NULL) THEN 'string' ELSE min({type_sql('v')}) END AS t FROM cells GROUP BY ALL),
sight AS (SELECT k, v, min(seq) AS seq FROM (SELECT k, v, seq FROM new UNION ALL
  SELECT {fold('col')}, unnest(vals), CAST(unnest(range(len(vals))) AS BIGINT) - len(vals) FROM prev) GROUP BY ALL),
kept AS (SELECT k, string_agg(v, '|' ORDER BY seq, v) AS vals FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, v DESC) AS rn FROM sight)
  WHERE rn <= 10 GROUP BY k),
cols AS (SELECT k, arg_min(t, seq) AS first_type, list(DISTINCT t) FILTER (t <> 'string') AS ts, arg_min(col, seq) AS col FROM new GROUP BY k)
SELECT coalesce(p.col, c.col) AS name, {fold('coalesce(p.col, c.col)')} AS k,
  CASE WHEN coalesce(p.kind, first_type) <> 'string' AND len(list_distinct(list_append(coalesce(ts, []), coalesce(p.kind, first_type)))) > 1
    THEN 'string' ELSE coalesce(p.kind, first_type) END AS data_type, coalesce(kept.vals, '') AS common_values
FROM cols c FULL JOIN (SELECT *, {fold('col')} AS k FROM prev) p ON c.k = p.k LEFT JOIN kept ON kept.k = coalesce(c.k, p.k)"""


MERGED_COLUMNS = [*PART_COLUMNS, "p_note"]
NOTED = "(SELECT *, CASE WHEN p_size > 40 THEN CAST(p_size AS VARCHAR) WHEN p_size > 20 THEN 'TRUE' ELSE p_brand END AS p_note FROM part)"


def previous_columns(spark, sf):
    return extract_schema(load(spark, sf, "part"), PART_COLUMNS, "p_partkey").select(
        "position", "name", "normalized_name", "data_type", "common_values"
    )


def noted_parts(spark, sf):
    note = F.when(F.col("p_size") > 40, F.col("p_size").cast("string")).when(F.col("p_size") > 20, "TRUE").otherwise(F.col("p_brand"))
    return load(spark, sf, "part").withColumn("p_note", note)


@BOOK.query("merge_schema", f"""
SELECT name, data_type, common_values FROM ({merge_sql(
    f"SELECT position, col, kind, vals FROM ({columns_sql('part', 'p_partkey', PART_COLUMNS)})",
    cells_sql(NOTED, 'p_partkey', MERGED_COLUMNS), lambda c: f'lower({c})')})""")
def q_merge_schema(spark, sf):
    """Rows with one more column folded into the columns known before."""
    cells = to_cells(noted_parts(spark, sf), MERGED_COLUMNS, F.col("p_partkey"))
    return merge_schema(previous_columns(spark, sf), cells).select(
        "name", "data_type", F.array_join("common_values", "|").alias("common_values")
    )


SNAKE = "trim(regexp_replace(regexp_replace(lower(regexp_replace({c}, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '_')"
CAMEL = {"p_name": "pName", "p_type": "P Type", "p_size": "PSize", "p_brand": "p-brand"}


@BOOK.query("update_schema", f"""
SELECT name, data_type, common_values FROM ({merge_sql(
    f"SELECT position, col, kind, vals FROM ({columns_sql('part', 'p_partkey', PART_COLUMNS)})",
    "SELECT seq, position, CASE col WHEN 'p_name' THEN 'pName' WHEN 'p_type' THEN 'P Type' WHEN 'p_size' THEN 'PSize' WHEN 'p_brand' THEN 'p-brand' ELSE col END AS col, v FROM ("
    + cells_sql(NOTED, 'p_partkey', [*CAMEL, 'p_note']) + ")", lambda c: SNAKE.format(c=c))})""")
def q_update_schema(spark, sf):
    """In place: columns also match by their normalised name."""
    cells = to_cells(noted_parts(spark, sf), [*CAMEL, "p_note"], F.col("p_partkey"))
    renamed = cells.replace(CAMEL, subset=["column"])
    return merge_schema(previous_columns(spark, sf), renamed, match_normalized=True).select(
        "name", "data_type", F.array_join("common_values", "|").alias("common_values")
    )


@BOOK.query("dedup_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) = 1""")
def q_dedup_first(spark, sf):
    items = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return dedup_first(items, "l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).drop("l_suppkey")


def order_schemas(spark, sf):
    """Every order as one import of its priority's dataset."""
    return load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("dataset_name"), F.format_string("schema_%010d", "o_orderkey").alias("id"),
        F.concat(F.lit("file_"), F.col("o_custkey").cast("string")).alias("source_file"),
        F.col("o_orderdate").alias("import_date"), F.col("o_totalprice").alias("price"),
    )


@BOOK.query("schema_lookup", """
SELECT o_orderpriority AS dataset_name, format('schema_{:010d}', o_orderkey) AS id, o_totalprice AS price FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def q_schema_lookup(spark, sf):
    return latest_schemas(order_schemas(spark, sf)).select("dataset_name", "id", "price")


@BOOK.query("list_datasets", "SELECT o_orderpriority AS dataset_name FROM orders")
def q_list_datasets(spark, sf):
    return list_datasets(order_schemas(spark, sf))


@BOOK.query("schema_for_record", """
SELECT p_partkey, CASE WHEN p_size % 7 <> 0 AND p_type <> 'SMALL' THEN p_type END AS dataset_name FROM part""")
def q_schema_for_record(spark, sf):
    df = parts(spark, sf)
    schemas = df.where(F.col("p_type") != "SMALL").groupBy("p_type").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("schema_"), "p_type").alias("id"), F.col("p_type").alias("dataset_name"), "n"
    )
    link = F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("schema_"), "p_type")).otherwise("gone")
    records = df.select("p_partkey", link.alias("schema_id"))
    return schema_for_record(records, schemas).select("p_partkey", "schema.dataset_name")


@BOOK.query("validate_params", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'data.p_name' WHEN 1 THEN 'p_size' WHEN 2 THEN 'data.P_Size' WHEN 3 THEN 'nothing'
  WHEN 4 THEN 'data.x' ELSE 'data.p_retailprice' END AS valid_key,
 CASE p_partkey % 6 WHEN 2 THEN 'Value ''' || p_name || ''' is not valid for field ''P_Size'' of type ''number''.'
  WHEN 3 THEN 'Field ''nothing'' not found in schema for dataset ''part''.'
  WHEN 4 THEN 'No schema found for dataset ''' || p_type || '''. Parameters not validated.' END AS warning FROM part""")
def q_validate_params(spark, sf):
    n = F.col("p_partkey") % 6
    key = F.element_at(F.array(*[F.lit(k) for k in ("data.P_NAME", "P_SIZE", "data.P_Size", "nothing", "data.x", "data.P_RetailPrice")]), (n + 1).cast("int"))
    value = F.when(n == 1, F.col("p_size").cast("string")).when(n == 5, F.col("p_retailprice").cast("string")).otherwise(F.col("p_name"))
    params = load(spark, sf, "part").select(
        "p_partkey", F.when(n == 4, F.col("p_type")).otherwise("part").alias("dataset_name"), key.alias("key"), value.alias("value")
    )
    return validate_params(params, catalog(spark, sf)).select("p_partkey", "valid_key", "warning")


def examples_sql(n: int) -> str:
    return f"""CASE WHEN len(vals) > 0 THEN ' (e.g., ' || array_to_string(list_transform(vals[1:{n}], lambda x: '"' || x || '"'), ', ') || ')' ELSE '' END"""


@BOOK.query("describe_schema", f"""
SELECT dataset AS dataset_name, 'Dataset: ' || dataset || chr(10) || 'Data fields:' || chr(10) ||
  string_agg('- data.' || col || {examples_sql(5)}, chr(10) ORDER BY col) || chr(10) || 'Tag fields:' || chr(10) ||
  '- project' || chr(10) || '- application' || chr(10) || '- environment' || chr(10) || '- status' AS description
FROM ({catalog_columns_sql()}) GROUP BY dataset""")
def q_describe_schema(spark, sf):
    return describe_all(catalog(spark, sf)).select("dataset_name", "description")


@BOOK.query("describe_all_schemas", f"""
SELECT dataset AS dataset_name, string_agg('- ' || col || {examples_sql(3)}, chr(10) ORDER BY position) AS fields
FROM ({catalog_columns_sql()}) GROUP BY dataset""")
def q_describe_all_schemas(spark, sf):
    return catalog(spark, sf).select("dataset_name", list_fields(F.col("columns")).alias("fields"))


@BOOK.query("catalog_text", """
WITH e AS (SELECT *, row_number() OVER (ORDER BY dataset_name, id) AS n FROM (
  SELECT o_orderpriority AS dataset_name, format('schema_{:010d}', o_orderkey) AS id, 'price_' || o_custkey AS col FROM orders))
SELECT (n - 1) // 64 AS block, min(n) AS first_row, count(*) AS "rows",
  string_agg('Dataset: ' || dataset_name || chr(10) || '- ' || col, chr(10) || chr(10) ORDER BY n) AS description FROM e GROUP BY block""")
def q_catalog_text(spark, sf):
    """The text of a catalog with an entry for every order, in blocks."""
    column = F.struct(
        F.concat(F.lit("price_"), F.col("source_file").substr(F.lit(6), F.lit(20))).alias("normalized_name"), F.array().cast("array<string>").alias("common_values")
    )
    entries = order_schemas(spark, sf).withColumn("columns", F.array(column))
    return catalog_text(entries, brief=True)


@BOOK.query("store_schema", """
SELECT format('schema_{:010d}', o_orderkey) AS id, CASE WHEN o_orderstatus = 'F' THEN 'new_' || o_custkey ELSE 'file_' || o_custkey END AS file,
  'schema' AS document_type FROM orders""")
def q_store_schema(spark, sf):
    """Entries of filled orders are imported again and replace their first version."""
    base = order_schemas(spark, sf).withColumn("file", F.lit("")).withColumn(
        "metadata", F.create_map(F.lit("document_type"), F.lit("x"))
    ).withColumn("status", F.lit(None).cast("string"))
    first = store_schemas(None, base)
    orders = load(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    again = orders.select(F.format_string("schema_%010d", "o_orderkey").alias("id"), F.concat(F.lit("new_"), F.col("o_custkey").cast("string")).alias("_f"))
    new = base.join(again, "id").withColumn("file", F.col("_f")).drop("_f")
    stored = store_schemas(first, new)
    return stored.select("id", "file", F.col("metadata.document_type").alias("document_type"))
