from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rowlore.model import CATALOG_SCHEMA, FuzzyMatch
from rowlore.operators.filters import where_filters
from rowlore.operators import text
from rowlore.operators.text import (
    chunk_text, complete_batch, embed_text, embed_with, extract_text, join_counts, summarize,
)
from rowlore.operators.blocks import numbered
from rowlore.plans.answer import (
    answer_context, ask_documents, ask_tabular, context_blocks, derive_filters, rank_datasets, validated_filters,
)
from rowlore.plans.prompts import KNOWN, UNKNOWN, build_prompt, parse_dataset_reply

WIDTH = 32


@pytest.fixture
def schemas(spark):
    column = lambda n, v: (n, n, "string", False, "", v)
    rows = [
        ("c", "s1", "ServerInventory", "a", "a", datetime(2024, 1, 1), "b", {},
         [column("environment", ["Production", "Staging"]), column("purpose", ["Corelight Network sensor", "Web"])]),
        ("c", "s2", "NetworkDevices", "b", "b", datetime(2024, 1, 1), "b", {}, [column("ip_address", ["10.0.0.1"])]),
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


@pytest.fixture
def questions(spark):
    rows = [
        (1, "Show all servers with purpose Corelight network sensor in production or staging"),
        (2, "Which network devices have an ip address?"),
        (3, "Tell me everything"),
    ]
    df = spark.createDataFrame(rows, "question_id int, question string")
    return df.withColumn("collection", F.lit("c")).withColumn("question_vector", embed_text(F.col("question"), WIDTH))


@pytest.fixture
def records(spark):
    rows = [
        ("r1", "inv.csv", {"environment": "Production", "purpose": "Corelight Network sensor"}),
        ("r2", "inv.csv", {"environment": "staging", "purpose": "corelight network sensor"}),
        ("r3", "inv.csv", {"environment": "Production", "purpose": "Web"}),
        ("r4", "net.csv", {"ip_address": "10.0.0.1"}),
    ]
    df = spark.createDataFrame(rows, "id string, file string, m map<string,string>")
    return df.select(
        "id", "file", F.lit("c").alias("collection"), F.to_variant_object("m").alias("data"),
        F.to_json("m").alias("text"), F.create_map(F.lit("file"), F.array("file")).alias("tags"),
    ).withColumn("embedding", embed_text(F.col("text"), WIDTH))


def test_rank_datasets(questions, schemas):
    got = {(r["question_id"], r["rank"]): r["dataset_name"] for r in rank_datasets(questions, schemas).collect()}
    assert got[(1, 1)] == "ServerInventory" and got[(2, 1)] == "NetworkDevices" and (3, 1) not in got


def test_derive_filters(spark, questions, schemas):
    asked = questions.join(
        rank_datasets(questions, schemas, 1).select("question_id", "dataset_name"), "question_id", "left"
    )
    got = sorted(
        ((r["question_id"], r["ordinal"], r["key"], r["values"]) for r in derive_filters(asked, schemas).collect()), key=str
    )
    both = ["Production", "Staging"]
    purpose = ["Corelight Network sensor"]
    assert got == sorted([
        (1, 0, "data.environment", both), (1, 0, "data.purpose", purpose),
        (1, 1, "data.environment", both), (1, 2, "data.purpose", purpose),
        (2, 0, None, None), (3, 0, None, None),
    ], key=str)
    checked = validated_filters(derive_filters(asked, schemas), schemas)
    assert checked.where("question_id = 1").count() == 4 and checked.where("key is null").count() == 2


def test_ask_tabular(questions, records, schemas):
    got = {r["question_id"]: r for r in ask_tabular(questions, records, schemas, 10).collect()}
    rows = [line.split("] ")[0] for line in got[1]["context"].splitlines()]
    assert len(rows) == 3 and {"r1", "r2"} == {r.rsplit("#", 1)[1] for r in rows[:2]} and rows[2].endswith("#r3")
    assert got[3]["hits"] == 4 and got[3]["dataset_name"] is None
    assert got[2]["dataset_name"] == "NetworkDevices" and "Which network devices" in got[2]["prompt"]
    answers = {r["question_id"]: r["completion"] for r in complete_batch(
        ask_tabular(questions, records, schemas, 1)
    ).collect()}
    assert answers[1].startswith(KNOWN)
    one = ask_tabular(questions, records, schemas, 1).where("question_id = 1").first()
    assert one["sources"].count("\n") == 0


def test_ask_with_given_filters(spark, questions, records, schemas):
    filters = spark.createDataFrame([(3, 0, "data.ip_address", ["10.0.0.1"])], "question_id int, ordinal int, key string, values array<string>")
    got = {r["question_id"]: r for r in ask_tabular(questions, records, schemas, 5, filters).collect()}
    assert got[3]["hits"] == 1 and got[1]["hits"] is None
    answered = complete_batch(ask_tabular(questions, records, schemas, 5, filters)).where("question_id = 1")
    assert answered.first()["completion"] == UNKNOWN


def test_replies_choose_dataset_and_filters(questions, records, schemas):
    """A provider's replies name the dataset, then filters over its fields; what it makes up is not followed."""

    def reply(prompts):
        out = []
        for p in prompts:
            about = p.split("Question: ")[1]
            if p.startswith("Decide"):
                out.append('```json\n["ServerInventory"]\n```' if "servers" in about else '["Unknown"]' if "everything" in about else "NetworkDevices")
            else:
                assert "Data fields" in p or "everything" in about
                out.append('[{"data.Environment": "production", "data.purpose": ["web"]}]' if "servers" in about else "[{}]")
        return out

    got = {r["question_id"]: r for r in ask_tabular(questions, records, schemas, 10, provider=reply).collect()}
    assert {q: r["dataset_name"] for q, r in got.items()} == {1: "ServerInventory", 2: "NetworkDevices", 3: None}
    assert got[1]["hits"] == 1 and "#r3]" in got[1]["context"] and got[3]["hits"] == 4


def test_strict_hits(spark, questions, records, schemas):
    filters = spark.createDataFrame([(1, 0, "data.purpose", ["network"]), (3, 0, "data.purpose", ["web"])], "question_id int, ordinal int, key string, values array<string>")
    loose, strict = (
        {r["question_id"]: r["hits"] for r in ask_tabular(questions, records, schemas, 5, filters, FuzzyMatch(True, "CONTAINS"), strict=s).collect()} for s in (False, True)
    )
    assert loose == {1: 2, 2: None, 3: 1} and strict == {1: None, 2: None, 3: 1}


def test_completions_in_the_plan_and_by_a_provider(spark):
    df = spark.createDataFrame([("Records:\r\n ROW 1: a \nROW 2: b\nNo ROW 3",), ("nothing",), (None,)], "prompt string")
    assert [r["completion"] for r in complete_batch(df).collect()][:2] == [f"{KNOWN}: ROW 1: a | ROW 2: b", UNKNOWN]
    assert "Python" not in complete_batch(df)._jdf.queryExecution().executedPlan().toString()
    given = complete_batch(df.na.fill(""), lambda prompts: [p.upper()[:4] for p in prompts], concurrency=2)
    assert sorted(r["completion"] for r in given.collect()) == ["", "NOTH", "RECO"]


def test_context_limit_trims_sources_only(spark):
    hits = spark.createDataFrame(
        [(1, 0, i, f"d{i}", "f", f"t{i}", {"file": [f"n{i}"]}) for i in range(1, 4)],
        "question_id int, ordinal int, rank int, id string, source string, text string, tags map<string,array<string>>",
    )
    got = answer_context(hits, 2).first()
    assert got["context"].splitlines() == ["ROW 1: [f #d1] t1", "ROW 2: [f #d2] t2", "ROW 3: [f #d3] t3"]
    assert got["sources"].splitlines() == ["- n1 #d1", "- n2 #d2"]


def test_context_of_any_size(spark):
    """Blocks of a question in order are its context, wherever its rows lie."""
    hits = spark.range(700).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 7 == 0, 1).otherwise(2).cast("int").alias("question_id"), F.lit(0).alias("ordinal"),
        (-F.col("id") % 50).alias("rank"), F.concat(F.lit("d"), "id").alias("id"), F.when(F.col("id") % 5 > 0, "f").alias("source"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("t"), "id")).alias("text"), F.create_map(F.lit("file"), F.array(F.lit("n"))).alias("tags"),
    )
    whole = {r["question_id"]: r for r in answer_context(hits, 20).collect()}
    blocks = {}
    for r in context_blocks(hits.repartition(9), 20, rows=16).orderBy("question_id", "block").collect():
        assert r["first_row"] == 16 * r["block"] + 1 and r["rows"] <= 16
        blocks.setdefault(r["question_id"], []).append(r)
    assert blocks.keys() == whole.keys() and len(blocks[2]) > 20
    for question, rows in blocks.items():
        assert "\n".join(r["context"] for r in rows) == whole[question]["context"]
        assert "\n".join(r["sources"] for r in rows if r["sources"]) == whole[question]["sources"]


def test_numbers_across_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).alias("v")).where("g < 2 OR v < 10")
    got = numbered(rows.repartition(6), ("g",), ("v",)).collect()
    for g in range(3):
        own = sorted((r["v"], r["row"]) for r in got if r["g"] == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert sorted((r["v"], r["row"]) for r in numbered(rows, (), ("g", "v")).where("g = 0").collect())[0][1] == 1


def test_ask_documents(spark, questions, table):
    docs = table("documents").select(F.col("doc_id").alias("id"), "text", "source")
    chunks = chunk_text(docs).withColumn("id", F.concat_ws("-", "id", "chunk_number")).withColumn(
        "tags", F.create_map(F.lit("file"), F.array("source"))
    ).withColumn("embedding", embed_text(F.col("chunk_text"), WIDTH))
    got = ask_documents(questions, chunks).collect()
    assert len(got) == 3 and all(r["hits"] == 5 for r in got)


@pytest.mark.parametrize("reply, want", [
    ('["ServerInventory"]', "ServerInventory"), ("[]", None), ('```json\n["ServerInventory"]\n```', "ServerInventory"),
    ("ServerInventory", "ServerInventory"), ("none", None), ('["None"]', None), ("", None), ('["a", "b"]', "a"),
])
def test_parse_dataset_reply(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(parse_dataset_reply(F.col("r")).alias("d")).first()["d"] == want


def brute_chunks(text, size, overlap):
    tokens = text.split()
    n = max(len(tokens) - size, 0)
    step = size - overlap
    return [" ".join(tokens[i * step : i * step + size]) for i in range(-(-n // step) + 1)] if tokens else []


def test_chunks_against_brute_force(table):
    docs = table("documents")
    got = {}
    for r in chunk_text(docs.select("doc_id", "text"), size=50, overlap=10).collect():
        got[(r["doc_id"], r["chunk_number"])] = r["chunk_text"]
    want = {
        (r["doc_id"], i): c for r in docs.collect() for i, c in enumerate(brute_chunks(r["text"], 50, 10))
    }
    assert got == want


def test_extract_text(spark):
    html = "<html><head><title>x</title></head><body><!-- c --><p>A &amp; B</p><script>var t='</p>';</script><b>C</b></body></html>"
    df = spark.createDataFrame([(html,), ("plain < text",)], "h string")
    assert [r["t"] for r in df.select(extract_text(F.col("h"), F.col("h").startswith("<")).alias("t")).collect()] == ["A & B C", "plain < text"]


def test_plain_text_comes_back_whole(spark):
    """A page flag decides, not the content."""
    plain = "if a <b and c> d then\n  mail <x@y.org> &amp; <!-- kept -->"
    df = spark.createDataFrame([(plain, False), ("<p>A</p>", True), ("A &amp;  B", True), (plain, None)], "h string, page boolean")
    got = [r["t"] for r in df.select(extract_text(F.col("h"), F.col("page")).alias("t")).collect()]
    assert got == [plain, "A", "A & B", plain]
    assert df.select(extract_text(F.col("h")).alias("t")).first()["t"] == plain


def test_summary_keeps_text_order(spark):
    df = spark.createDataFrame([(1, "b b. a c a. z. a a c")], "doc_id int, text string")
    assert summarize(df, "doc_id", sentences=2).first()["summary"] == "a c a. a a c."


def test_join_counts_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), "id")).alias("term"))
    counts = rows.groupBy("term").agg(F.count("*").alias("n"))
    joined = join_counts(rows, counts, "term", "n")
    assert joined.count() == 3000 and joined.where("term = 'hot'").agg(F.min("n")).first()[0] == 1000


def test_embed_provider(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(40)], "id int, text string")
    got = embed_with(df, lambda texts: [[float(len(t)), float(len(texts))] for t in texts])
    assert got.where(F.col("embedding")[0] != F.col("id")).count() == 0
    assert got.where(F.col("embedding")[1] > 16).count() == 0


def test_prompt_slots(spark):
    df = spark.createDataFrame([("q {context}", "ctx")], "q string, c string")
    text = df.select(build_prompt("filter", F.col("q"), F.col("c")).alias("p")).first()["p"]
    assert "Question: q {context}" in text and "ctx" in text


def test_strict_filters_on_typed_tables(table):
    customers = table("customer")
    got = where_filters(customers, {"data.c_mktsegment": ["building", "machinery"], "data.c_name": "%00001%"})
    assert {r["c_mktsegment"] for r in got.collect()} <= {"BUILDING", "MACHINERY"}


def test_join_counts_broadcasts_frequent_keys(spark, monkeypatch):
    """Few keys, or few frequent ones, are looked up where their rows are; long and rare ones by a shuffle."""
    n = F.col("id")
    rows = spark.range(4000).select("id", F.when(n % 2 == 0, n % 100).otherwise(n).cast("string").alias("term"))
    rows = rows.unionByName(spark.range(3).select("id", F.lit("x" * 300).alias("term")))
    counts = rows.groupBy("term").agg(F.count("*").alias("n"))
    want = {(r["id"], r["term"], r["n"]) for r in rows.join(counts, "term").collect()}
    sent = []
    monkeypatch.setattr(text.F, "broadcast", lambda df, f=F.broadcast: (sent.append(df.count()), f(df))[1])
    for most, short, share in ((200_000, 300, 1000), (200_000, 256, 1000), (100, 256, 1), (0, 256, 1000), (0, 256, 1)):
        for name, value in (("BROADCAST_ROWS", most), ("SHORT_KEY", short), ("HOT_SHARE", share)):
            monkeypatch.setattr(text, name, value)
        joined = join_counts(rows, counts, "term", "n")
        assert {(r["id"], r["term"], r["n"]) for r in joined.collect()} == want and joined.count() == 4003
    assert sent == [2051, 2050, 50, 50, 0]
