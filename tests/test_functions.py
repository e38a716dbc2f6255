import pytest
from pyspark.sql import functions as F

from rowlore.functions.maps import entries_to_map, entries_to_variant, last_wins
from rowlore.functions.names import (
    decode_id, effective_dataset_name, encode_id, filter_key, normalize_column, normalize_filter_key,
    normalize_header, row_key, sanitize_name, schema_id,
)
from rowlore.functions.sentences import parse_key_values, parse_sentences, row_sentence
from rowlore.functions.values import (
    as_date, first_scalar, format_cell, infer_type, typed_value, typed_variant, validate_value,
)
from rowlore.model import DecodeOptions


def one(spark, expr, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, want", [
    ("Größe (m²)", "Größe_m"), ("__a b__", "a_b"), ("", ""), ("Server Name", "Server_Name"),
])
def test_normalize_header(spark, text, want):
    assert one(spark, normalize_header, text) == want


@pytest.mark.parametrize("text, want", [
    ("serverPurposeID", "server_purpose_id"), ("Server Purpose", "server_purpose"), ("A--B", "a_b"),
])
def test_normalize_column(spark, text, want):
    assert one(spark, normalize_column, text) == want


@pytest.mark.parametrize("text, want", [
    ("data.serverPurpose", "data.server_purpose"), ("Project", "Project"), ("data.", "data."),
])
def test_filter_key(spark, text, want):
    assert filter_key(text) == want
    assert one(spark, normalize_filter_key, text) == want


@pytest.mark.parametrize("text, want", [
    (None, "string"), ("True", "boolean"), ("1", "number"), ("1e3", "number"), ("2024-01-05", "date"),
    ("yes", "string"), ("5d", "string"), ("1/5/2024", "date"), ("1/5/2024 9:30", "date"), ("13/45/2024", "string"),
])
def test_infer_type(spark, text, want):
    assert one(spark, infer_type, text) == want


@pytest.mark.parametrize("text, kind, value", [
    ("NULL", "null", None), ("", "null", None), ("7", "int", 7), ("2147483648", "double", 2147483648.0),
    ("1,000", "double", 1000.0), ("abc", "string", "abc"), (" TRUE ", "boolean", True),
])
def test_typed_value(spark, text, kind, value):
    got = one(spark, typed_value, text)
    assert got["type"] == kind
    held = {"int": "i", "double": "d", "string": "s", "boolean": "b"}.get(kind)
    assert (got[held] if held else None) == value


@pytest.mark.parametrize("text, kind, want", [
    ("abc", "number", False), (None, "date", True), ("x", "unknown", True), ("1", "INTEGER", True),
    ("true", "boolean", True), ("1", "boolean", False), ("2024-02-30", "date", False),
])
def test_validate_value(spark, text, kind, want):
    assert one(spark, lambda c: validate_value(c, F.lit(kind)), text) is want


def test_dates(spark):
    assert str(one(spark, as_date, "2024-01-05T10:00:00Z")) == "2024-01-05 10:00:00"
    assert one(spark, as_date, "20240105") is None


@pytest.mark.parametrize("kind, raw, want", [
    ("blank", None, ""), ("boolean", "1", "True"), ("date", "45296", "2024-01-05"), ("time", "0.5", "12:00:00"),
    ("time", "1.25", "1.06:00:00"), ("number", "5", "5"), ("number", "1.5", "1.5"), ("text", "a", "a"),
    ("error", "#N/A", "#N/A"),
])
def test_format_cell(spark, kind, raw, want):
    assert one(spark, lambda c: format_cell(F.lit(kind), c), raw) == want


def test_format_cell_without_types(spark):
    assert one(spark, lambda c: format_cell(F.lit("number"), c, DecodeOptions(preserve_types=False)), "5.0") == "5.0"


def test_ids(spark):
    assert one(spark, encode_id, "id-12") == "aWQtMTI_"
    assert one(spark, decode_id, "aWQtMTI_") == "id-12"
    assert one(spark, decode_id, "%%%") == ""
    long = "x" * 300
    assert one(spark, lambda c: decode_id(encode_id(c)), long) == long
    assert one(spark, sanitize_name, "a/b:c") == "a_b_c"
    assert one(spark, lambda c: row_key(c, F.lit(1)), "a") == one(spark, lambda c: row_key(c, F.lit(1)), "a")


@pytest.mark.parametrize("dataset, file, want", [
    ("default", "srv.csv", "srv"), ("servers", "srv.csv", "servers"), ("my-index", "srv.csv", "srv"),
    ("default", "a.b.csv", "a"), (None, "srv.csv", "srv"), ("a-name-longer-than-twenty", "s.csv", "s"),
])
def test_effective_dataset_name(spark, dataset, file, want):
    assert one(spark, lambda c: effective_dataset_name(c, F.lit(file)), dataset) == want


def test_schema_id(spark):
    got = one(spark, lambda c: schema_id(c, F.lit("2024-01-05 01:02:03").cast("timestamp"), F.lit("s")), "srv.csv")
    assert got.startswith("schema_srv_20240105010203_") and len(got.rsplit("_", 1)[1]) == 8


def test_first_scalar(spark):
    assert one(spark, lambda c: first_scalar(F.parse_json(c)), '["a","b"]') == "a"
    assert one(spark, lambda c: first_scalar(F.parse_json(c)), '"a"') == "a"


SENTENCES = [
    ("Record from worksheet S1, row 12: schema_id is ab. import_batch_id is cd. Name is SVR01. Blank is . Ratio is 1.5. Last is .",
     "S1", 12, {"name": "SVR01", "ratio": 1.5, "last": None}, {"schema_id": "ab", "import_batch_id": "cd"}),
    ("Record from worksheet S1, row 1: A is 5. Record from worksheet S1, row 2: A is 6.", "S1", 1, {"a": 5}, {}),
    ("Record from worksheet a,b, row 3: A is 5.", None, None, {}, {}),
    ("Record from worksheet S1, row 4: Flag is TRUE. None is NULL. Note is end of line. more.", "S1", 4,
     {"flag": True, "none": None, "note": "end of line"}, {}),
    ("Record from worksheet S1, row 5: A is 1. a is 2. B is x is y.", "S1", 5, {"a": 2, "b": "x is y"}, {}),
]


@pytest.mark.parametrize("text, sheet, row, data, source", SENTENCES)
def test_parse_sentence(spark, text, sheet, row, data, source):
    df = parse_sentences(spark.createDataFrame([(text,)], "text string"))
    got = df.select(
        "parsed_worksheet", "parsed_row", entries_to_map(F.col("parsed_source")).alias("s"),
        entries_to_variant(F.col("parsed"), typed_variant).alias("d"),
    ).first()
    assert (got["parsed_worksheet"], got["parsed_row"]) == (sheet, row)
    assert (got["s"] or {}) == source
    assert (got["d"].toPython() if got["d"] is not None else {}) == data


def test_sentence_round_trip(spark, table):
    part = table("part")
    entries = F.array(*[
        F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in part.columns
    ])
    text = part.select("*", row_sentence(F.lit("part"), F.col("p_partkey") + 2, entries).alias("text"))
    back = parse_sentences(text).withColumn("m", entries_to_map(F.col("parsed")))
    bad = back.where(
        (F.col("m.p_name") != F.col("p_name")) | (F.col("m.p_brand") != F.col("p_brand"))
        | (F.col("parsed_row") != F.col("p_partkey") + 2)
        | (F.col("m.p_retailprice").cast("double") != F.col("p_retailprice"))
    )
    assert bad.count() == 0


def test_parse_key_values(spark):
    text = "Worksheet: S1, Row: 7\n_note: kept\nServer Name: a:b\nCount: 3\nno colon"
    got = parse_key_values(spark.createDataFrame([(text,)], "text string")).select(
        "parsed_worksheet", "parsed_row", entries_to_map(F.col("parsed")).alias("m"),
        entries_to_map(F.col("parsed_source")).alias("s"),
    ).first()
    assert (got["parsed_worksheet"], got["parsed_row"]) == ("S1", 7)
    assert got["m"] == {"server_name": "a:b", "count": "3"} and got["s"] == {"_note": "kept"}


def test_last_wins_keeps_first_position(spark):
    df = spark.sql("select array(struct('a' as key, '1' as value), struct('b' as key, '2' as value), struct('a' as key, '3' as value)) as e")
    got = df.select(last_wins(F.col("e")).alias("e")).first()["e"]
    assert [(r["key"], r["value"]) for r in got] == [("a", "3"), ("b", "2")]
