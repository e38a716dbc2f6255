import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, normal
from rowlore.functions.vectors import as_matrix
from rowlore.operators.aggregates import dedup_first, top_values
from rowlore.operators.catalog import merge_schema
from rowlore.operators.retrieve import similar_batch
from rowlore.queries import all_queries, all_sql

JOINLESS = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, sf, db, name):
    df = all_queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in JOINLESS)
    cols = sorted(df.columns)
    mine = Counter(tuple(normal(r[c]) for c in cols) for r in df.collect())
    cur = db.execute(all_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert mine == Counter(tuple(normal(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["vec_id", "label", "score"]


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())
    assert set(all_queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_registry_needs_no_session():
    root = str(Path(__file__).resolve().parent.parent)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


@pytest.mark.parametrize("gone", ["rowlore.llm", "corpus_pipeline"])
def test_entry_without_the_optional_part(gone):
    root = str(Path(__file__).resolve().parent.parent)
    code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'pipeline' not in q and 'csv_rows' in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, check=True, capture_output=True, text=True)
    assert "left out" not in done.stderr


def test_functions_travel_by_value(tmp_path):
    """A worker without the package can load the package's functions."""
    file = tmp_path / "f.bin"
    file.write_bytes(cloudpickle.dumps(as_matrix))
    code = f"import pickle; f = pickle.load(open({str(file)!r}, 'rb')); import sys; assert 'rowlore' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    assert (Path(__file__).parent.parent / "rowlore").is_dir()


def test_a_third_of_all_rows_in_one_group(spark):
    """Hot groups give whole, exact results."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), (30_000 - F.col("id")).alias("seq")
    )
    assert [(r["value"], r["count"]) for r in top_values(rows, F.col("k"), 1).collect()] == [("hot", 10_000)]
    first = dedup_first(rows.withColumn("v", F.col("seq")), "k", ("seq",))
    assert first.count() == 20_001 and first.where("k = 'hot'").first()["v"] == 3
    cells = rows.select("seq", F.lit(0).alias("position"), F.lit("c").alias("column"), F.col("k").alias("value"))
    merged = merge_schema(None, cells).first()
    assert merged["common_values"] == [f"k{i}" for i in (14, 13, 11, 10, 8, 7, 5, 4, 2, 1)]


def test_copies_of_one_vector(spark):
    """A third of the records share one vector: ties go by id and nothing is lost."""
    vectors = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(
            F.array(F.cos(F.col("id") + 0.0), F.sin(F.col("id") + 0.0))
        ).cast("array<float>").alias("embedding")
    )
    questions = spark.range(1).select(F.lit("q").alias("question_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("question_vector"))
    got = similar_batch(vectors.repartition(7), questions, 1001)
    assert got.where("rank <= 1000").agg(F.max(F.col("id") % 3)).first()[0] == 0
    assert [r["id"] for r in got.orderBy("rank").limit(4).collect()] == [0, 3, 6, 9]
