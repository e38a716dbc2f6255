from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rowlore.model import CATALOG_SCHEMA
from rowlore.operators.aggregates import (
    batch_count, dedup_first, filterable_fields, top_data_values, top_tag_values,
)
from rowlore.operators.catalog import (
    catalog_text, common_values, describe_all, extract_schema, infer_column_types, latest_schemas, list_datasets,
    merge_schema, schema_by_dataset, schema_by_id, schema_for_record, schemas_by_source_file, to_cells, update_entry, validate_params,
)


def column(name, kind, values, normalized=None):
    return (name, normalized or name.lower(), kind, False, "", values)


@pytest.fixture
def schemas(spark):
    rows = [
        ("c", "s1", "servers", "a.csv", "a.csv", datetime(2024, 1, 1), "b1", {}, [column("Old", "string", [])]),
        ("c", "s2", "servers", "a.csv", "a.csv", datetime(2024, 1, 2), "b2", {},
         [column("Server Name", "string", ["SVR01", "SVR02"], "server_name"), column("Cores", "number", ["4", "8"])]),
        ("c", "s3", "apps", "b.csv", "b.csv", datetime(2024, 1, 1), "b3", {}, []),
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def fold(spark, values, previous=None, **how):
    cells = spark.createDataFrame(
        [(i, 0, "X", v) for i, v in enumerate(values)], "seq int, position int, column string, value string"
    )
    return merge_schema(previous, cells, **how).first()


@pytest.mark.parametrize("values, kind, kept", [
    (["1", "2", "x"], "number", ["1", "2", "x"]),
    (["x", "1"], "string", ["x", "1"]),
    (["1", "true"], "string", ["1", "true"]),
    ([f"v{i}" for i in range(1, 13)], "string", [f"v{i}" for i in range(3, 13)]),
    (["1", "1", "2", "1"], "number", ["1", "2"]),
    ([None, "1"], "string", ["", "1"]),
])
def test_merge_fold(spark, values, kind, kept):
    got = fold(spark, values)
    assert (got["data_type"], got["common_values"], got["changed"]) == (kind, kept, True)


def test_merge_with_previous(spark):
    shape = "position int, name string, normalized_name string, data_type string, common_values array<string>"
    previous = spark.createDataFrame(
        [(0, "x", "x", "number", [str(i) for i in range(10)]), (1, "y", "y", "date", ["d"])], shape
    )
    cells = spark.createDataFrame(
        [(0, 0, "X", "3"), (1, 0, "X", "true"), (0, 1, "Zed Col", "q")],
        "seq int, position int, column string, value string",
    )
    got = {r["name"]: r for r in merge_schema(previous, cells).collect()}
    assert (got["x"]["data_type"], got["x"]["common_values"]) == ("string", [str(i) for i in range(1, 10)] + ["true"])
    assert (got["y"]["data_type"], got["y"]["common_values"], got["y"]["changed"]) == ("date", ["d"], False)
    assert got["Zed Col"]["normalized_name"] == "zed_col" and got["Zed Col"]["changed"]
    same = fold(spark, ["3", "4"], previous.where("position = 0"))
    assert not same["changed"]
    snake = spark.createDataFrame([(0, "server_name", "server_name", "string", ["a"])], shape)
    renamed = spark.createDataFrame([(0, 0, "ServerName", "b")], "seq int, position int, column string, value string")
    assert merge_schema(snake, renamed, match_normalized=True).count() == 1
    assert merge_schema(snake, renamed).count() == 2


def test_infer_and_common_values(spark):
    df = spark.createDataFrame(
        [(0, "1", "a", ""), (1, "x", "b", ""), (2, "2", "a", ""), (3, "true", "c", "")], "k int, p string, q string, r string"
    )
    cells = to_cells(df, ["p", "q", "r"], F.col("k"))
    assert {r["column"]: r["data_type"] for r in infer_column_types(cells).collect()} == {
        "p": "number", "q": "string", "r": "string",
    }
    assert {r["column"]: r["common_values"] for r in common_values(cells).collect()} == {
        "p": ["1", "x", "2", "true"], "q": ["a", "b", "c"],
    }
    got = {r["name"]: r for r in extract_schema(df, ["p", "q", "r"], "k").collect()}
    assert got["r"]["common_values"] == [] and got["p"]["data_type"] == "number"
    assert {r["data_type"] for r in extract_schema(df, ["p", "q"], "k", typed=False).collect()} == {"string"}
    tie = to_cells(df.where("k < 2"), ["p"], F.col("k"))
    assert infer_column_types(tie).first()["data_type"] == "string"


def test_lookup(schemas):
    assert {r["id"] for r in latest_schemas(schemas).collect()} == {"s2", "s3"}
    assert schema_by_dataset(schemas, "servers").first()["id"] == "s2"
    assert schema_by_id(schemas, "s1").first()["dataset_name"] == "servers"
    assert schemas_by_source_file(schemas, "a.csv").count() == 2
    assert list_datasets(schemas).count() == 3 and list_datasets(schemas, True).count() == 2


def test_schema_for_record(spark, schemas):
    records = spark.createDataFrame([(1, "s2"), (2, "none"), (3, None)], "id int, schema_id string")
    got = {r["id"]: r["schema"] and r["schema"]["dataset_name"] for r in schema_for_record(records, schemas).collect()}
    assert got == {1: "servers", 2: None, 3: None}


def test_validate_params(spark, schemas):
    params = spark.createDataFrame(
        [("servers", "data.SERVER NAME", "x"), ("servers", "data.server_name", "y"), ("servers", "cores", "abc"),
         ("servers", "CORES", "4"), ("servers", "data.nope", "1"), ("gone", "data.a", "1")],
        "dataset_name string, key string, value string",
    )
    got = {r["key"]: (r["valid_key"], r["warning"]) for r in validate_params(params, schemas).collect()}
    assert got["data.SERVER NAME"] == got["data.server_name"] == ("data.server_name", None)
    assert got["CORES"] == ("cores", None)
    assert got["cores"] == ("cores", "Value 'abc' is not valid for field 'cores' of type 'number'.")
    assert got["data.nope"] == ("data.nope", "Field 'nope' not found in schema for dataset 'servers'.")
    assert got["data.a"] == ("data.a", "No schema found for dataset 'gone'. Parameters not validated.")


def test_describe(schemas):
    text = {r["id"]: r["description"] for r in describe_all(schemas).collect()}
    lines = text["s2"].splitlines()
    assert lines[:4] == ["Dataset: servers", "Data fields:", '- data.cores (e.g., "4", "8")', '- data.server_name (e.g., "SVR01", "SVR02")']
    assert "(no columns known)" in text["s3"]
    assert catalog_text(schemas, brief=True).first()["description"].startswith("Dataset: apps")


def test_top_values_and_fields(spark):
    df = spark.sql(
        """select * from values
        (1, map('t', array('a', 'A')), parse_json('{"x": 1, "Y": null}')),
        (2, map('T', array('a')), parse_json('{"x": 1}')),
        (3, cast(map() as map<string, array<string>>), parse_json('{"x": 2}')) as v(id, tags, data)"""
    )
    assert [(r["value"], r["count"]) for r in top_data_values(df, "x").collect()] == [("1", 2), ("2", 1)]
    assert [(r["value"], r["count"]) for r in top_data_values(df, "x", 1).collect()] == [("1", 2)]
    assert [(r["value"], r["count"]) for r in top_tag_values(df, "t").collect()] == [("A", 1), ("a", 1)]
    assert {(r["kind"], r["field"], r["records"]) for r in filterable_fields(df).collect()} == {
        ("tag", "t", 2), ("data", "x", 3), ("data", "y", 1),
    }
    assert {r["field"] for r in filterable_fields(df, 1, ("id",)).collect()} == {"t", "x", "y"}


def test_dedup_first_and_batches(spark):
    df = spark.createDataFrame([("a", 1, 2, "x"), ("a", 0, 5, "y"), ("b", 3, 1, "z")], "k string, o int, r int, v string")
    assert {(r["k"], r["v"]) for r in dedup_first(df, "k", ("o", "r")).collect()} == {("a", "y"), ("b", "z")}
    assert {(r["k"], r["records"]) for r in batch_count(df, "k").collect()} == {("a", 2), ("b", 1)}


def test_update_stamps_the_date_only_on_a_change(spark, schemas):
    entry = schemas.where("id = 's2'")
    cells = lambda rows: spark.createDataFrame(rows, "seq long, position int, column string, value string")
    at = F.lit(datetime(2030, 1, 1)).cast("timestamp")
    known = {c["name"]: c["common_values"] for c in entry.first()["columns"]}
    same = update_entry(entry, cells([(1, 0, list(known)[0], None)]).limit(0), at).first()
    assert same == entry.first()
    changed = update_entry(entry, cells([(1, 0, "Brand New", "v")]), at).first()
    assert changed["import_date"] == datetime(2030, 1, 1) and [c["name"] for c in changed["columns"]] == [*known, "Brand New"]
    assert {c["name"]: c["common_values"] for c in changed["columns"]} == known | {"Brand New": ["v"]} and changed["id"] == "s2"
