import pytest
from pyspark.sql import functions as F

from rowlore.operators.records import assemble_record, enrich_payload, extract_lineage, project_record
from rowlore.operators.store import RecordStore, Written, confirm_written


def make(df, seq):
    return df.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("dataset"),
        F.lit("orders.parquet").alias("file"), F.col("o_orderkey").cast("int").alias("row_number"),
        F.to_variant_object(F.create_map(F.lit("price"), "o_totalprice")).alias("data"), F.lit(seq).alias("ingest_seq"),
    )


def test_store_life_cycle(spark, table, tmp_path):
    store = RecordStore(spark, str(tmp_path / "root"))
    assert store.list_collections().count() == 0
    store.create("orders", 64, 4)
    store.create("orders", 999, 9)
    store.create("other")
    assert {(r["collection"], r["vector_width"], r["buckets"]) for r in store.list_collections().collect()} == {
        ("orders", 64, 4), ("other", 1536, 16),
    }
    orders = table("orders")
    first = make(orders, 1)
    store.upsert("orders", first)
    assert store.read("orders").count() == orders.count()
    second = make(orders.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(1.0)), 2)
    store.upsert("orders", second.unionByName(make(orders.where("o_orderkey % 4 = 0"), 0)))
    stored = store.read("orders")
    assert stored.count() == orders.count()
    assert stored.where("ingest_seq = 2").count() == second.count() == stored.where(
        F.try_variant_get("data", "$.price", "double") == 1.0
    ).count()
    store.upsert("orders", second)
    assert store.read("orders").count() == orders.count()
    assert confirm_written(second, store.read("orders")).count() == 0
    one = second.first()
    hit = store.get("orders", one["dataset"], one["id"])
    assert [r["id"] for r in hit.collect()] == [one["id"]] and "embedding" not in hit.columns
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "dataset" in plan.split("PartitionFilters: [")[1].split("]")[0] and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.get("orders", one["dataset"], "missing").count() == 0
    gone = make(orders.where("o_orderpriority = '5-LOW' or o_orderkey % 3 = 0"), 3).select("dataset", "id")
    store.delete("orders", gone.unionByName(spark.createDataFrame([("none", "x")], "dataset string, id string")))
    left = store.read("orders")
    assert left.count() == orders.where("not (o_orderpriority = '5-LOW' or o_orderkey % 3 = 0)").count()
    assert left.where("dataset = '5-LOW'").count() == 0
    store.drop("orders")
    store.drop("orders")
    assert not store.exists("orders") and {r["collection"] for r in store.list_collections().collect()} == {"other"}


def test_a_batch_is_there_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = RecordStore(spark, str(tmp_path / "root"))
    store.create("c", 4, 3)
    rows = lambda ids, seq: spark.createDataFrame([(d, i, seq) for d in ("a", "b/c d%") for i in ids], "dataset string, id string, ingest_seq long")
    ids = [str(i) for i in range(40)]
    assert store.upsert("c", rows(ids, 5)) == Written(80, 0, 80, 0, 0)
    monkeypatch.setattr(RecordStore, "_commit", lambda *a: (_ for _ in ()).throw(IOError("lost")))
    with pytest.raises(IOError):
        store.upsert("c", rows(["40"], 6))
    with pytest.raises(IOError):
        store.delete("c", rows(ids, 1))
    monkeypatch.undo()
    assert store.read("c").count() == 80 and store.read("c").where("id = '40'").isEmpty()
    # Older rows lose, repeats and rows without a key are counted.
    more = rows(["1", "2"], 4).unionByName(rows(["3", "3", "50"], 6)).unionByName(spark.createDataFrame([("a", None, 1), (None, "x", 1)], "dataset string, id string, ingest_seq long"))
    assert store.upsert("c", more) == Written(12, 2, 2, 2, 6)
    assert store.vacuum("c") >= 2 and store.vacuum("c") == 0 and store.read("c").count() == 82
    assert store.delete("c", rows(["50", "51"], 1)) == 2 and store.delete("c", rows(["51"], 1)) == 0
    # Two writes of one version: the second one fails.
    version, manifest = store._version("c")
    store._commit("c", version + 1, manifest)
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit("c", version + 1, manifest)
    assert store.upsert("c", rows([], 1).limit(0)) == Written(0, 0, 0, 0, 0)


def test_confirm_reads_buckets_that_differ_only(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "root"))
    store.create("c", 4, 8)
    batch = spark.range(400).select(F.lit("d").alias("dataset"), F.col("id").cast("string").alias("id"))
    assert store.confirm("c", batch).count() == 400
    store.upsert("c", batch)
    whole = store.confirm("c", batch.unionByName(batch))
    assert whole.isEmpty() and "data/generation" not in whole._jdf.queryExecution().toString()
    store.delete("c", batch.where("id IN ('7', '8')"))
    left = store.confirm("c", batch)
    assert {r["id"] for r in left.collect()} == {"7", "8"}
    plan = left._jdf.queryExecution().executedPlan().toString()
    buckets = {r["bucket"] for r in store._bucketed("c", batch.where("id IN ('7', '8')")).collect()}
    assert "generation" in plan and len(buckets) <= 2
    assert store.confirm("c", batch.where("id = '9'")).isEmpty()


def test_dataset_names_stay_text(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "root"))
    store.create("c", 4, 2)
    store.upsert("c", spark.createDataFrame([("007", "a", 1), ("2024", "b", 1)], "dataset string, id string, ingest_seq long"))
    assert {r["dataset"] for r in store.read("c").collect()} == {"007", "2024"}


def test_lineage_precedence(spark):
    df = spark.sql(
        """select * from values
        (1, 'schema_id is t. import_batch_id is tb. X is 1.', parse_json('{"schema_id":"p","import_batch_id":"pb"}'), parse_json('{}')),
        (2, 'X is 1.', parse_json('{"schema_id":"p"}'), parse_json('{"import_batch_id":["rb","z"]}')),
        (3, null, parse_json('{}'), parse_json('{"schema_id":["r"]}')) as v(id, text, p, d)"""
    )
    got = {r["id"]: (r["schema_id"], r["import_batch_id"]) for r in extract_lineage(df, F.col("text"), F.col("p"), F.col("d")).collect()}
    assert got == {1: ("t", "pb"), 2: ("p", "rb"), 3: ("r", None)}


def test_assemble_and_enrich(spark):
    df = spark.sql(
        """select * from values
        ('k1', 'Record from worksheet S, row 2: schema_id is s. A is 5.', map('__custom_tabular_data_tag', array('x'), 't', array('y'))),
        ('k2', 'free text', map('t', array('y'))) as v(key, text, tags)"""
    )
    given = assemble_record(
        df, F.col("key"), data=F.parse_json(F.lit('{"z": 1}')), source=F.create_map(F.lit("from"), F.lit("given")),
        import_batch_id=F.lit("gb"),
    )
    got = {r["key"]: r for r in given.collect()}
    assert got["k1"]["data"].toPython() == {"a": 5} and got["k2"]["data"].toPython() == {"z": 1}
    assert got["k1"]["source"] == {"_worksheet": "S", "_rowNumber": "2", "schema_id": "s", "import_batch_id": "gb"}
    assert got["k2"]["source"] == {"from": "given", "import_batch_id": "gb"}
    assert got["k1"]["tags"] == {"t": ["y"]} and got["k1"]["id"] == "azE_"
    payload = given.select(
        "key", enrich_payload(F.parse_json(F.lit('{"text": "t", "schema_id": "old"}')), F.col("data"), F.col("source"), F.col("schema_id"), F.col("import_batch_id")).alias("p")
    )
    rich = {r["key"]: r["p"].toPython() for r in payload.collect()}
    assert rich["k1"]["tabular_data"] == '{"a":5}' and rich["k1"]["schema_id"] == "s" and rich["k1"]["text"] == "t"
    assert rich["k2"]["schema_id"] == "old" and rich["k2"]["import_batch_id"] == "gb"
    assert "embedding" not in project_record(given.withColumn("embedding", F.array(F.lit(1.0)))).columns
