"""Inputs on which earlier versions went wrong."""

from datetime import date
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowlore.functions.names import decode_id, encode_id
from rowlore.functions.vectors import as_matrix
from rowlore.operators.filter_table import filter_templates
from rowlore.operators.filters import data_condition
from rowlore.operators.store import RecordStore
from rowlore.plans.ingest import store_schemas
from rowlore.sources.folders import scan_files


def test_typed_values_on_generic_records(spark):
    rows = spark.sql("""SELECT id, parse_json(v) AS data FROM VALUES
      (1, '{"x": true}'), (2, '{"x": "yes"}'), (3, '{"x": 1}'), (4, '{"x": "1"}'), (5, '{"x": 5}'), (6, '{"x": "5d"}'), (7, '{"x": 5.0}'),
      (8, '{"x": "2024-01-05"}'), (9, '{"x": null}'), (10, '{}'), (11, '{"x": "true"}') AS t(id, v)""")
    found = lambda value: {r["id"] for r in rows.where(data_condition(rows, "data.x", value)).collect()}
    assert found(True) == {1} and found(1) == {3} and found(5.0) == {5, 7} and found(Decimal("5")) == {5, 7}
    assert found(date(2024, 1, 5)) == {8}


def test_typed_values_on_columns(spark):
    rows = spark.sql("SELECT date'2024-01-05' AS d, cast(1.50 AS decimal(10,2)) AS m, 7L AS n")
    hit = lambda key, value: rows.where(data_condition(rows, key, value)).count()
    assert hit("data.d", date(2024, 1, 5)) == 1 and hit("data.m", Decimal("1.5")) == 1 and hit("data.m", Decimal("1.6")) == 0
    assert [hit("data.n", v) for v in ("7", "--7", "²", "07")] == [1, 0, 0, 0]


def test_ids_of_other_bytes(spark):
    rows = spark.createDataFrame([("/w__",), ("w",), (None,)], "i string").select(decode_id(F.col("i")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["", "", None]
    assert spark.range(1).select(decode_id(encode_id(F.lit("é/1"))).alias("t")).first()["t"] == "é/1"


def test_percent_in_file_names(spark, tmp_path):
    for name in ("100%.txt", "a%20b.txt", "a b+c.txt"):
        (tmp_path / name).write_text("x")
    assert {r["file"] for r in scan_files(spark, str(tmp_path)).collect()} == {"100%.txt", "a%20b.txt", "a b+c.txt"}


def test_vectors_of_two_widths():
    assert as_matrix(pa.array([[1.0, 2.0], None]))[0].shape == (1, 2)
    with pytest.raises(ValueError):
        as_matrix(pa.array([[1.0, 2.0, 3.0], [1.0] * 5]))
    assert np.isfinite(as_matrix(pa.array([], pa.list_(pa.float32())))[0]).all()


def test_all_filters_of_a_reply(spark):
    reply = "[" + ",".join(f'{{"data.k{i}": "v"}}' for i in range(7)) + "]"
    rows = filter_templates(spark.createDataFrame([(1, reply)], "reply_id int, reply string")).collect()
    assert sorted(r["ordinal"] for r in rows) == list(range(7))


def test_last_write_wins_on_equal_order(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "store"))
    store.create("c", vector_width=2, buckets=2)
    for text in ("b", "a", "c"):
        store.upsert("c", spark.createDataFrame([("1", "d", text, 5)], "id string, dataset string, text string, ingest_seq long"))
        assert [r["text"] for r in store.read("c").collect()] == [text]


def test_new_schemas_with_one_id(spark):
    new = spark.sql("""SELECT * FROM VALUES ('s', timestamp'2024-01-01', 'a', 'x'), ('s', timestamp'2024-01-02', 'b', 'x'), ('t', timestamp'2024-01-01', '', 'y')
      AS v(id, import_date, file, source_file)""").selectExpr("*", "'b1' AS import_batch_id", "cast(map() AS map<string, string>) AS metadata")
    assert {(r["id"], r["file"]) for r in store_schemas(None, new).collect()} == {("s", "b"), ("t", "y")}


def test_scores_come_in_tiles(monkeypatch):
    from rowlore.operators import retrieve

    rng = np.random.default_rng(3)
    m, questions = rng.normal(size=(50, 4)), rng.normal(size=(23, 4))
    questions /= np.linalg.norm(questions, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(m.tolist())], names=["id", "v"])
    whole = retrieve._search(iter([batch]), questions, 3)
    seen = []
    part = retrieve._candidates
    monkeypatch.setattr(retrieve, "TILE", 7)
    monkeypatch.setattr(retrieve, "_candidates", lambda *a: (seen.append((len(a[0]), len(a[2]))), part(*a))[1])
    tiled = retrieve._search(iter([batch]), questions, 3)
    assert max(map(max, seen)) == 7
    order = lambda df: df.sort_values(["q", "score", "id"])[["q", "id", "score"]].reset_index(drop=True)
    assert order(whole)[["q", "id"]].equals(order(tiled)[["q", "id"]]) and np.allclose(order(whole)["score"], order(tiled)["score"])


def test_catalog_entries_with_and_without_a_batch(spark):
    """Entries are stored whether or not they name an import batch."""
    new = spark.createDataFrame([("a", "", "s1", date(2024, 1, 1), None), ("a", "f2", "s2", date(2024, 1, 2), None), ("b", None, "s3", date(2024, 1, 1), None)], "id string, file string, source_file string, import_date date, metadata map<string,string>")
    first = store_schemas(None, new)
    assert sorted((r["id"], r["file"]) for r in first.collect()) == [("a", "f2"), ("b", "s3")]
    again = store_schemas(first, new.where("id = 'b'").withColumn("import_batch_id", F.lit("x")))
    assert sorted((r["id"], r["file"], r["import_batch_id"]) for r in again.collect()) == [("a", "f2", None), ("b", "s3", "x")]


def test_whole_numbers_of_records_are_compared_as_such(spark):
    """Neighbours that one double stands for are told apart."""
    rows = spark.sql("""SELECT id, parse_json(v) AS data FROM VALUES (1, '{"x": 9007199254740992}'), (2, '{"x": 9007199254740993}'), (3, '{"x": 9.007199254740992E15}'),
      (4, '{"x": 0.1}'), (5, '{"x": 0.10}'), (6, '{"x": 1E-1}'), (7, '{"x": 12345678901234567890123}'), (8, '{"x": -3}'), (9, '{"x": -3.0}'), (10, '{"x": 0.1000000000000000055}') AS t(id, v)""")
    found = lambda value: {r["id"] for r in rows.where(data_condition(rows, "data.x", value)).collect()}
    assert found(9007199254740993) == {2} and found(9007199254740992) == {1, 3} and found(9007199254740992.0) == {1, 3}
    assert found(Decimal("0.1")) >= {4, 5} and found(0.1) >= {4, 5, 6} and 10 not in found(Decimal("0.1"))
    assert found(12345678901234567890123) == {7} and found(12345678901234567890124) == set()
    assert found(-3) == found(Decimal("-3")) == {8, 9} and found(float("nan")) == set() and found(float("inf")) == set()
