"""The filter language: F1-F22, T11."""

from pyspark.sql import functions as F

from rowlore.model import FuzzyMatch
from rowlore.operators.catalog import validate_params
from rowlore.operators.filter_table import filter_table_match, filter_templates, pack_filters
from rowlore.operators.filters import (
    data_filter, exclude_catalog, strict_recheck, tag_filter, where_filters,
)
from rowlore.operators.searchable import write_searchable
from rowlore.plans.sizing import scratch_dir, spread
from rowlore.queries.book import CUSTOMERS, PART_COLUMNS, Book, as_record_form, catalog, customers, documents, load, parts

BOOK = Book()
C_OUT = ("c_custkey", "c_name", "c_mktsegment")
C_COLS = ", ".join(C_OUT)
P_OUT = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")
P_COLS = ", ".join(P_OUT)


def on_customers(name, where, filters, fuzzy=FuzzyMatch(), **how):
    @BOOK.query(name, f"SELECT {C_COLS} FROM {CUSTOMERS} WHERE {where}")
    def run(spark, sf):
        return where_filters(customers(spark, sf), filters, fuzzy, **how).select(*C_OUT)


def on_parts(name, where, filters, fuzzy=FuzzyMatch(), **how):
    @BOOK.query(name, f"SELECT {P_COLS} FROM part WHERE {where}")
    def run(spark, sf):
        return where_filters(parts(spark, sf), filters, fuzzy, **how).select(*P_OUT)


on_customers("filter_exact", "c_mktsegment = 'BUILDING'", {"data.c_mktsegment": "BUILDING"}, FuzzyMatch(case_insensitive=False))
on_customers("filter_exact_ci", "lower(c_mktsegment) = 'building'", {"data.c_mktsegment": "Building"})
on_customers("filter_like", "lower(c_name) LIKE 'customer#%1_5'", {"data.c_name": "Customer#%1_5"})
on_parts("filter_fuzzy_like", "lower(p_name) LIKE '%s%ri%'", {"data.p_name": "S Ri"}, FuzzyMatch(True, "LIKE"))
on_parts("filter_fuzzy_contains", "contains(lower(p_name), 'll b')", {"data.p_name": "LL B"}, FuzzyMatch(True, "CONTAINS"))
on_parts("filter_min_length", "lower(p_type) = 'ec' OR contains(lower(p_type), 'promo')",
         {"data.p_type": ["ec", "Promo"]}, FuzzyMatch(True, "CONTAINS", 3))
on_parts("filter_any_of", "lower(p_brand) IN ('brand#1', 'brand#2') OR lower(p_brand) LIKE '%3'",
         {"data.p_brand": ["Brand#1", "BRAND#2", "%3", None, ""]})
on_parts("filter_typed", "p_size = 7 AND p_retailprice = 900.1 OR p_size = 11", [{"data.p_size": 7, "data.p_retailprice": 900.1}, {"data.p_size": 11}])
on_customers(
    "filter_or_of_ands",
    "(lower(c_mktsegment) IN ('building', 'machinery') AND lower(c_name) LIKE '%00001%') OR (lower(r_name) = 'asia' AND c_nationkey = 7)",
    [{"data.c_mktsegment": ["building", "machinery"], "data.c_name": "%00001%", "data.c_acctbal": None}, {},
     {"region": "Asia", "data.c_nationkey": "7"}],
)
on_customers("filter_tag", "lower(r_name) = 'europe'", {"region": "Europe"})
on_customers("filter_tag_any_of", "lower(n_name) IN ('nation_3', 'nation_17')", {"nation": ["Nation_3", "NATION_17", None]})
on_customers("filter_tag_exact", "r_name = 'ASIA' AND n_name = 'NATION_2' OR r_name = 'Asia'",
             [{"region": "ASIA", "nation": "NATION_2"}, {"region": "Asia"}], exact_case_tags=True)
on_customers("filter_hybrid_keys", "lower(r_name) = 'africa' AND lower(c_mktsegment) = 'household' AND lower(c_name) LIKE '%7%'",
             {"region": "AFRICA", "data.c_mktsegment": "household", "data.c_name": "%7%"})
on_customers("filter_builder", "lower(c_mktsegment) = 'furniture' OR lower(n_name) = 'nation_9'",
             [data_filter("c_mktsegment", "Furniture"), tag_filter("nation", "nation_9")])


@BOOK.query("filter_shadow", f"SELECT {C_COLS} FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def q_filter_shadow(spark, sf):
    """Equality without case on a table written with shadow columns: it reaches the scan."""
    path = scratch_dir(spark, "searchable")
    write_searchable(load(spark, sf, "customer"), path, ("c_mktsegment",), ("c_name",))
    return where_filters(spark.read.parquet(path), {"data.c_mktsegment": ["Building", "MACHINERY"]}).select(*C_OUT)


@BOOK.query("filter_tag_typed", "SELECT p_partkey, p_size FROM part WHERE p_size = 12")
def q_filter_tag_typed(spark, sf):
    df = load(spark, sf, "part").withColumn("tags", F.create_map(F.lit("size"), F.array(F.col("p_size").cast("string"))))
    return where_filters(df, {"size": 12}).select("p_partkey", "p_size")


@BOOK.query("exclude_schema_docs", "SELECT doc_id, lang FROM documents WHERE source <> 'src0' AND lower(lang) = 'fr'")
def q_exclude_schema_docs(spark, sf):
    docs = documents(spark, sf).withColumn("document_type", F.when(F.col("source") == "src0", "schema"))
    return where_filters(exclude_catalog(docs, F.col("document_type")), {"lang": "FR"}).select("doc_id", "lang")


@BOOK.query("strict_recheck", f"SELECT {P_COLS} FROM part WHERE lower(p_name) = 'red bolt'")
def q_strict_recheck(spark, sf):
    loose = where_filters(parts(spark, sf), {"data.p_name": "bolt"}, FuzzyMatch(True, "CONTAINS"))
    return strict_recheck(loose, {"data.p_name": "Red Bolt"}).select(*P_OUT)


@BOOK.query("filter_typed_records", "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size = 7 AND p_retailprice = 900.1 OR p_size = 11 OR p_partkey = 5")
def q_filter_typed_records(spark, sf):
    """Typed values on generic records; a neighbour that only a double would confuse is not matched."""
    big = F.col("p_partkey") + F.lit(9007199254740992 - 4)
    rows = as_record_form(parts(spark, sf).withColumn("big", big), "part", "p_partkey", [*PART_COLUMNS, "big"])
    filters = [{"data.p_size": 7, "data.p_retailprice": 900.1}, {"data.p_size": 11}, {"data.big": 9007199254740993}]
    return where_filters(rows, filters).select("id")


@BOOK.query("filter_validated", f"""
SELECT p.p_partkey, f.asked FROM part p JOIN (SELECT DISTINCT p_brand AS b, p_size AS s, p_brand || '/' || p_size AS asked FROM part) f
  ON lower(p.p_brand) = lower(f.b) AND p.p_size = f.s""")
def q_filter_validated(spark, sf):
    """A filter for each brand and size in use, its keys checked and renamed by the catalog, all answered in one scan."""
    df, schemas = parts(spark, sf), catalog(spark, sf, ("part",))
    found = df.select("p_brand", "p_size").distinct().select(F.concat_ws("/", "p_brand", "p_size").alias("asked"), "p_brand", "p_size")
    asked = F.create_map(F.lit("data.P_BRAND"), F.col("p_brand"), F.lit("data.P_Size"), F.col("p_size").cast("string"))
    params = found.select("asked", F.lit("part").alias("dataset_name"), F.explode(asked).alias("key", "value"))
    named = validate_params(params, schemas).select("asked", F.col("valid_key").alias("key"), F.array("value").alias("values"))
    packed = pack_filters(named.withColumn("collection", F.lit("part")), ("asked",), partition="collection")
    # The catalog names fields as headers do; records are asked by those names.
    data = F.create_map(*[x for c in ("p_brand", "p_size") for x in (F.lit(c), F.col(c).cast("string"))])
    records = df.withColumn("collection", F.lit("part"))
    return filter_table_match(records, packed, "asked", data_map=data, record_id="p_partkey").select("p_partkey", "asked")


REPLIES = """(SELECT p_partkey, CASE p_partkey % 6
  WHEN 0 THEN '[{"data.p_type": "' || p_type || '"}, {"brand": ["' || p_brand || '", 5, "x"]}]'
  WHEN 1 THEN '{"data.p_name": "' || p_name || '", "data.p_size": 5, "flag": true}'
  WHEN 2 THEN '[{}]' WHEN 3 THEN 'no json: ' || p_name WHEN 4 THEN '{}'
  ELSE '[{}, {"data.p_name": ["%' || p_name || '%"]}]' END AS reply FROM part)"""


@BOOK.query("filter_templates", """
SELECT p_partkey, 0 AS ordinal, 'data.p_type' AS key, p_type AS "values" FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT p_partkey, 1, 'brand', p_brand || '|x' FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT p_partkey, 0, 'data.p_name', p_name FROM part WHERE p_partkey % 6 = 1
UNION ALL SELECT p_partkey, 0, NULL, NULL FROM part WHERE p_partkey % 6 IN (2, 3, 4)
UNION ALL SELECT p_partkey, 0, 'data.p_name', '%' || p_name || '%' FROM part WHERE p_partkey % 6 = 5""")
def q_filter_templates(spark, sf):
    load(spark, sf, "part").createOrReplaceTempView("_part_replies")
    replies = spark.sql(f"SELECT * FROM {REPLIES.replace('FROM part', 'FROM _part_replies')}")
    rows = filter_templates(replies, "reply", ("p_partkey",))
    return rows.select("p_partkey", "ordinal", "key", F.array_join("values", "|").alias("values"))


@BOOK.query("filter_table_match", """
SELECT f.filter_id, p.p_partkey FROM part p JOIN (SELECT DISTINCT p_brand || '/' || p_type AS filter_id, p_brand AS b, p_type AS t FROM part) f
  ON lower(p.p_brand) = lower(f.b) AND lower(p.p_type) IN (lower(f.t), 'promo')
  AND (lower(p.p_name) LIKE '%b_l%' OR contains(lower(p.p_name), lower('ring')))""")
def q_filter_table_match(spark, sf):
    """One filter per brand and type found in the table, answered in one scan."""
    df = spread(parts(spark, sf))
    found = df.select("p_brand", "p_type").distinct().withColumn("filter_id", F.concat_ws("/", "p_brand", "p_type"))
    asked = {
        "data.p_brand": F.array(F.upper("p_brand")),
        "type": F.array("p_type", F.lit("Promo")),
        "data.pName": F.array(F.lit("%B_l%"), F.lit("%RING%")),
    }
    pairs = F.explode(F.create_map(*[x for k, v in asked.items() for x in (F.lit(k), v)])).alias("key", "values")
    conditions = found.select("filter_id", pairs, F.lit("part").alias("collection"))
    packed = pack_filters(conditions, ("filter_id",), partition="collection")
    data = F.create_map(*[x for c in ("p_brand", "p_name") for x in (F.lit(c), F.col(c))])
    return filter_table_match(
        df.withColumn("collection", F.lit("part")), packed, data_map=data, record_id="p_partkey"
    ).select("filter_id", "p_partkey")
