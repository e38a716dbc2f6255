"""A registry of queries and the tables they share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlore.functions.values import BOOLEAN_PATTERN, DATE_PATTERN, NUMBER_PATTERN
from rowlore.operators.catalog import collect_columns, describe_cells, to_cells
from rowlore.plans.sizing import materialize, spread


class Book:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def query(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def load_spread(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    """The same for CPU-heavy work: the columns wanted, on all cores even when the file is small."""
    df = load(spark, sf, table)
    return spread(df.select(*columns) if columns else df)


def tags_of(**columns: str) -> Column:
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), F.array(F.col(c)))])


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with segment, nation and region tags; nation and region are 30 rows in all."""
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    df = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return df.withColumn("tags", tags_of(segment="c_mktsegment", nation="n_name", region="r_name"))


CUSTOMERS = """(SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").withColumn("tags", tags_of(brand="p_brand", type="p_type"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").withColumn("tags", tags_of(lang="lang", source="source"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with the tags of the document of the same number."""
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    df = load(spark, sf, "embeddings").join(docs, "vec_id")
    return df.withColumn("tags", tags_of(lang="lang", source="source"))


VECTORS = "(SELECT e.*, d.lang, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"


def as_record_form(df: DataFrame, table: str, key: str, columns: list[str], *more: str) -> DataFrame:
    """A typed table in the generic record layout."""
    return df.select(
        F.lit(table).alias("dataset"),
        F.col(key).cast("string").alias("id"),
        F.lit(f"{table}.parquet").alias("file"),
        F.lit(table).alias("worksheet"),
        (F.col(key) + 2).cast("int").alias("row_number"),
        "tags",
        F.to_variant_object(F.struct(*columns)).alias("data"),
        F.lit(f"schema_{table}").alias("schema_id"),
        F.concat(F.lit("batch_"), (F.col(key) % 4).cast("string")).alias("import_batch_id"),
        *more,
    )


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


# Tables the catalog queries describe: key and columns of each.
DESCRIBED = {
    "part": ("p_partkey", PART_COLUMNS),
    "customer": ("c_custkey", CUSTOMER_COLUMNS),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]),
    "events": ("event_id", ["event_id", "user_id", "event_type", "value", "props"]),
}


def catalog(spark: SparkSession, sf: str, tables: tuple[str, ...] = tuple(DESCRIBED)) -> DataFrame:
    """A stored catalog with one entry per table, derived from its rows."""
    samples = [
        to_cells(load(spark, sf, t), columns, F.col(key).cast("bigint")).withColumn(
            "dataset_name", F.lit(t)
        )
        for t in tables
        for key, columns in [DESCRIBED[t]]
    ]
    cells = reduce(DataFrame.unionByName, samples)
    nested = collect_columns(describe_cells(cells, by=("dataset_name",)), ("dataset_name",))
    full = nested.select(
        F.lit("tabular").alias("collection"), F.concat(F.lit("schema_"), "dataset_name").alias("id"), "dataset_name",
        F.concat("dataset_name", F.lit(".parquet")).alias("source_file"),
        F.concat("dataset_name", F.lit(".parquet")).alias("file"),
        F.lit("2024-01-01").cast("timestamp").alias("import_date"), F.lit("batch_0").alias("import_batch_id"),
        F.create_map(F.lit("document_type"), F.lit("schema")).alias("metadata"), "columns",
    )
    return materialize(full, "catalog")


def catalog_columns_sql(tables: tuple[str, ...] = tuple(DESCRIBED)) -> str:
    """One row per catalog column: dataset, position, col, kind, vals (list of up to ten values)."""
    return "\nUNION ALL\n".join(f"SELECT '{t}' AS dataset, * FROM ({columns_sql(t, *DESCRIBED[t])})" for t in tables)


def columns_sql(table: str, key: str, columns: list[str]) -> str:
    return f"""
WITH cells AS (SELECT *, {type_sql('v')} AS t FROM ({cells_sql(table, key, columns)})),
votes AS (SELECT position, col, count(*) FILTER (t = 'string' AND coalesce(v, '') <> '') AS s, count(*) FILTER (t = 'number' AND coalesce(v, '') <> '') AS n,
  count(*) FILTER (t = 'boolean' AND coalesce(v, '') <> '') AS b, count(*) FILTER (t = 'date' AND coalesce(v, '') <> '') AS d FROM cells GROUP BY ALL),
seen AS (SELECT position, v, min(seq) AS seq FROM cells WHERE coalesce(v, '') <> '' GROUP BY ALL),
firsts AS (SELECT position, list(v ORDER BY seq, v) AS vals FROM (
  SELECT *, row_number() OVER (PARTITION BY position ORDER BY seq, v) AS rn FROM seen) WHERE rn <= 10 GROUP BY position)
SELECT position, col, CASE WHEN s = greatest(s, n, b, d) THEN 'string' WHEN n = greatest(s, n, b, d) THEN 'number'
  WHEN b = greatest(s, n, b, d) THEN 'boolean' ELSE 'date' END AS kind, coalesce(vals, []) AS vals
FROM votes LEFT JOIN firsts USING (position)"""


def cells_sql(table: str, key: str, columns: list[str]) -> str:
    """The table's cells in long form: seq, position, column, value."""
    return "\nUNION ALL\n".join(
        f"SELECT {key} AS seq, {i} AS position, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {table}"
        for i, c in enumerate(columns)
    )


def number_sql(v: str) -> str:
    return f"(regexp_matches({v}, '{NUMBER_PATTERN}') AND TRY_CAST(replace(trim({v}), ',', '') AS DOUBLE) IS NOT NULL)"


def date_sql(v: str) -> str:
    return f"""(regexp_matches({v}, '{DATE_PATTERN}') AND coalesce(TRY_CAST(trim({v}) AS TIMESTAMP),
      try_strptime(trim({v}), '%m/%d/%Y %H:%M'), try_strptime(trim({v}), '%m/%d/%Y')) IS NOT NULL)"""


def type_sql(v: str) -> str:
    return f"""CASE WHEN {v} IS NULL THEN 'string' WHEN regexp_matches({v}, '{BOOLEAN_PATTERN}') THEN 'boolean'
      WHEN {number_sql(v)} THEN 'number' WHEN {date_sql(v)} THEN 'date' ELSE 'string' END"""


# Text in many spellings, taken from the columns of every event.
def spelled(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id") % 12
    text = (
        F.when(n == 0, F.col("user_id").cast("string"))
        .when(n == 1, F.col("event_type"))
        .when(n == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(n == 3, F.date_format("ts", "M/d/yyyy H:mm"))
        .when(n == 4, F.concat(F.lit("  "), F.when(F.col("value") > 10, "TRUE").otherwise("False")))
        .when(n == 5, F.lit("NULL"))
        .when(n == 6, F.lit(""))
        .when(n == 7, F.col("value").cast("string"))
        .when(n == 8, F.concat(F.col("user_id").cast("string"), F.lit(",000.5")))
        .when(n == 9, F.concat(F.col("user_id").cast("string"), F.lit("000000000000")))
        .when(n == 10, F.concat(F.col("user_id").cast("string"), F.lit("d")))
    )
    return load_spread(spark, sf, "events").select("event_id", "event_type", text.alias("v"))


SPELLED = """(SELECT event_id, event_type, CASE event_id % 12 WHEN 0 THEN CAST(user_id AS VARCHAR)
  WHEN 1 THEN event_type WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN strftime(ts, '%-m/%-d/%Y %-H:%M')
  WHEN 4 THEN '  ' || CASE WHEN value > 10 THEN 'TRUE' ELSE 'False' END WHEN 5 THEN 'NULL' WHEN 6 THEN ''
  WHEN 7 THEN CAST(value AS VARCHAR) WHEN 8 THEN CAST(user_id AS VARCHAR) || ',000.5'
  WHEN 9 THEN CAST(user_id AS VARCHAR) || '000000000000' WHEN 10 THEN CAST(user_id AS VARCHAR) || 'd' END AS v
  FROM events)"""
