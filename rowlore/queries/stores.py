"""The record store: S8-S15, J6."""

from pyspark.sql import functions as F

from rowlore.operators.aggregates import batch_count
from rowlore.operators.store import RecordStore
from rowlore.plans.sizing import scratch_dir
from rowlore.queries.book import Book, load

BOOK = Book()


def order_records(df, seq: int, price: str = "o_totalprice"):
    return df.select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").cast("string").alias("id"),
        F.lit("orders.parquet").alias("file"), F.lit("orders").alias("worksheet"),
        (F.col("o_orderkey") + 2).cast("int").alias("row_number"),
        F.to_variant_object(F.create_map(F.lit("price"), F.expr(price))).alias("data"),
        F.concat(F.lit("batch_"), F.col("o_orderstatus")).alias("import_batch_id"), F.lit(seq).cast("bigint").alias("ingest_seq"),
    )


def filled_store(spark, sf):
    """All orders, then the filled ones again with a new price."""
    store = RecordStore(spark, scratch_dir(spark, "store"))
    store.create("orders", 64, 4)
    orders = load(spark, sf, "orders")
    store.upsert("orders", order_records(orders, 1))
    store.upsert("orders", order_records(orders.where(F.col("o_orderstatus") == "F"), 2, "o_totalprice + 1"))
    return store


@BOOK.query("upsert_records", """
SELECT o_orderpriority AS dataset, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS price,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS ingest_seq FROM orders""")
def q_upsert_records(spark, sf):
    stored = filled_store(spark, sf).read("orders")
    return stored.select("dataset", "id", F.try_variant_get("data", "$.price", "double").alias("price"), "ingest_seq")


def after_delete(spark, sf):
    store = filled_store(spark, sf)
    gone = order_records(load(spark, sf, "orders").where(F.col("o_orderstatus") == "P"), 3)
    store.delete("orders", gone.select("dataset", "id"))
    return store


@BOOK.query("delete_records", "SELECT o_orderpriority AS dataset, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus <> 'P'")
def q_delete_records(spark, sf):
    return after_delete(spark, sf).read("orders").select("dataset", "id")


@BOOK.query("confirm_written", "SELECT o_orderpriority AS dataset, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'P'")
def q_confirm_written(spark, sf):
    """Written keys that are gone again are reported; buckets with equal digests are not read."""
    return after_delete(spark, sf).confirm("orders", order_records(load(spark, sf, "orders"), 1))


@BOOK.query("batch_outcome", """
SELECT count(*) AS received, count(*) FILTER (o_orderkey % 10 = 0) AS rejected, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 10 <> 0) AS inserted,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 10 <> 0) AS replaced, CAST(0 AS BIGINT) AS superseded FROM orders""")
def q_batch_outcome(spark, sf):
    """What became of a batch: filled orders were there before, every tenth row has no id."""
    store = RecordStore(spark, scratch_dir(spark, "store"))
    store.create("orders", 64, 4)
    orders = load(spark, sf, "orders")
    store.upsert("orders", order_records(orders.where(F.col("o_orderstatus") == "F"), 1))
    done = store.upsert("orders", order_records(orders, 2).withColumn("id", F.when(F.col("row_number") % 10 != 2, F.col("id"))))
    row = (done.received, done.rejected, done.inserted, done.replaced, done.superseded)
    return spark.createDataFrame([row], "received long, rejected long, inserted long, replaced long, superseded long")


@BOOK.query("get_by_id", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'orders.parquet' AS file, 'batch_' || o_orderstatus AS import_batch_id FROM orders
WHERE o_orderpriority = '5-LOW' QUALIFY row_number() OVER (ORDER BY o_orderkey DESC) = 1""")
def q_get_by_id(spark, sf):
    """A point read of the last low-priority order."""
    store = RecordStore(spark, scratch_dir(spark, "store"))
    store.create("orders", 64, 4)
    orders = load(spark, sf, "orders")
    store.upsert("orders", order_records(orders, 1))
    last = orders.where(F.col("o_orderpriority") == "5-LOW").agg(F.max("o_orderkey")).first()[0]
    return store.get("orders", "5-LOW", str(last)).select("id", "file", "import_batch_id")


@BOOK.query("batch_count", "SELECT 'batch_' || o_orderstatus AS import_batch_id, count(*) AS records FROM orders GROUP BY 1")
def q_batch_count(spark, sf):
    return batch_count(order_records(load(spark, sf, "orders"), 1))


@BOOK.query("list_collections", "SELECT r_name AS collection, CAST(64 AS INTEGER) AS vector_width FROM region WHERE r_name <> 'ASIA'")
def q_list_collections(spark, sf):
    """One collection per region, one of them dropped, one created twice."""
    store = RecordStore(spark, scratch_dir(spark, "store"))
    for row in load(spark, sf, "region").toLocalIterator():
        store.create(row["r_name"], 64)
    store.create("EUROPE", 128)
    store.drop("ASIA")
    return store.list_collections().select("collection", "vector_width")
