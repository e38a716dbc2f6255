import json

import pytest
from pyspark.sql import functions as F

from rowlore.model import FuzzyMatch
from rowlore.operators.filter_table import filter_table_match, filter_templates, pack_filters
from rowlore.operators.filters import (
    compile_filter, data_filter, exclude_catalog, strict_recheck, tag_filter, where_filters,
)

ROWS = [
    (1, {"environment": "Production", "location": "East US", "server_name": "SVR01", "cores": 5}, {"department": ["IT"], "project": ["Phoenix"]}),
    (2, {"environment": "Staging", "location": "West US", "server_name": "SVR_02", "cores": 8}, {"department": ["Ops", "it"], "project": ["Austin"]}),
    (3, {"environment": "production", "location": "Middle East", "server_name": "aXb", "cores": 5}, {"department": []}),
    (4, {"environment": None, "location": "North"}, {}),
]


@pytest.fixture(scope="module")
def servers(spark):
    df = spark.createDataFrame(
        [(i, json.dumps(d), t) for i, d, t in ROWS], "id long, d string, tags map<string,array<string>>"
    )
    return df.select("id", F.parse_json("d").alias("data"), "tags").cache()


def ids(df):
    return sorted(r["id"] for r in df.collect())


LIKE, CONTAINS = FuzzyMatch(True, "like"), FuzzyMatch(True, "CONTAINS")
CASES = [
    ([], FuzzyMatch(), [1, 2, 3, 4]),
    ([{}], FuzzyMatch(), [1, 2, 3, 4]),
    ({"data.environment": "Production"}, FuzzyMatch(), [1, 3]),
    ({"data.Environment": "Production"}, FuzzyMatch(case_insensitive=False), [1]),
    ({"data.serverName": "SVR"}, LIKE, [1, 2]),
    ({"data.location": "East"}, CONTAINS, [1, 3]),
    ({"data.serverName": "%SVR%"}, FuzzyMatch(), [1, 2]),
    ({"data.environment": ["Production", "Staging"]}, FuzzyMatch(), [1, 2, 3]),
    ({"department": "IT"}, FuzzyMatch(), [1, 2]),
    ({"data.environment": "Production", "department": "IT"}, FuzzyMatch(), [1]),
    ([{"data.environment": "staging"}, {"project": ["PHOENIX", "other"]}], FuzzyMatch(), [1, 2]),
    ({"data.x": []}, FuzzyMatch(), [1, 2, 3, 4]),
    ({"data.x": [None, ""]}, FuzzyMatch(), [1, 2, 3, 4]),
    ({"data.": "v"}, FuzzyMatch(), [1, 2, 3, 4]),
    ({"data.server_name": "a_b"}, FuzzyMatch(), [3]),
    ({"data.location": "Ea"}, FuzzyMatch(True, "CONTAINS", 3), []),
    ({"data.location": "East US"}, LIKE, [1]),
    ({"data.location": "le ast"}, LIKE, [3]),
    ({"data.cores": "5"}, FuzzyMatch(), [1, 3]),
    ({"data.cores": 5}, FuzzyMatch(), [1, 3]),
    ({"data.environment": None, "data.cores": 8}, FuzzyMatch(), [2]),
    ({"data.location": "East"}, FuzzyMatch(True, "nonsense"), []),
    ({"data.location": ["%east%", "north"]}, FuzzyMatch(), [1, 3, 4]),
]


@pytest.mark.parametrize("filters, fuzzy, want", CASES)
def test_compile(servers, filters, fuzzy, want):
    assert ids(where_filters(servers, filters, fuzzy)) == want


def test_table_form_agrees_with_compiled_form(spark, servers):
    """F22 gives, for every filter, the rows the compiled filter gives."""
    usable = [
        (i, f, fuzzy) for i, (f, fuzzy, _) in enumerate(CASES)
        if isinstance(f, dict) and all(isinstance(v, (str, list)) for v in f.values())
    ]
    for fuzzy in {z for _, _, z in usable}:
        rows = [
            (i, k, [v] if isinstance(v, str) else v)
            for i, f, z in usable if z == fuzzy for k, v in f.items()
        ]
        conditions = spark.createDataFrame(rows, "filter_id int, key string, values array<string>")
        packed = pack_filters(conditions.withColumn("collection", F.lit("c")), ("filter_id",), fuzzy, "collection")
        got = filter_table_match(servers.withColumn("collection", F.lit("c")), packed, fuzzy=fuzzy)
        pairs = sorted((r["filter_id"], r["id"]) for r in got.select("filter_id", "id").collect())
        want = sorted((i, x) for i, f, z in usable if z == fuzzy for x in CASES[i][2])
        assert pairs == want


def test_table_form_beyond_the_broadcast_bound(spark, servers, monkeypatch):
    import rowlore.operators.filter_table as ft

    conditions = spark.createDataFrame(
        [(i, "data.cores", [str(i)]) for i in range(600)], "filter_id int, key string, values array<string>"
    ).withColumn("collection", F.lit("c"))
    packed = pack_filters(conditions, ("filter_id",), partition="collection")
    records = servers.withColumn("collection", F.lit("c"))
    small = sorted((r["filter_id"], r["id"]) for r in filter_table_match(records, packed).collect())
    monkeypatch.setattr(ft, "BROADCAST_ROWS", 0)
    large = filter_table_match(records, packed)
    assert sorted((r["filter_id"], r["id"]) for r in large.collect()) == small == [(5, 1), (5, 3), (8, 2)]


def test_exact_case_tags_and_builders(servers):
    assert ids(where_filters(servers, tag_filter("department", "IT"), exact_case_tags=True)) == [1]
    assert data_filter("x", 1) == {"data.x": 1} and data_filter("data.x", 1) == {"data.x": 1}
    assert ids(where_filters(servers, data_filter("cores", 8))) == [2]


def test_strict_recheck(servers):
    loose = where_filters(servers, {"data.location": "East"}, CONTAINS)
    assert ids(strict_recheck(loose, {"data.location": "East US"})) == [1]


def test_typed_table_pushes_whole_numbers_down(table):
    part = table("part")
    plan = part.where(compile_filter({"data.p_size": "5"}, part))._jdf.queryExecution().toString()
    assert "EqualTo(p_size,5)" in plan
    assert part.where(compile_filter({"data.p_size": "05"}, part)).count() == 0


def test_exclude_catalog(spark):
    df = spark.createDataFrame([(1, None), (2, "schema"), (3, "x")], "id int, t string")
    assert ids(exclude_catalog(df, F.col("t"))) == [1, 3]


@pytest.mark.parametrize("reply, want", [
    ('[{"data.a": "x"}, {"project": ["p", 1, "q"]}]', [(0, "data.a", ["x"]), (1, "project", ["p", "q"])]),
    ('{"data.a": "x", "n": 5, "b": true}', [(0, "data.a", ["x"])]),
    ("[{}]", [(0, None, None)]),
    ("{}", [(0, None, None)]),
    ("not json", [(0, None, None)]),
    ('[{"a": "x"}, 5]', [(0, None, None)]),
])
def test_filter_templates(spark, reply, want):
    df = filter_templates(spark.createDataFrame([(1, reply)], "reply_id int, reply string"))
    got = sorted(((r["ordinal"], r["key"], r["values"]) for r in df.collect()), key=str)
    assert got == want
