"""Many filters, questions and phrases at once, beside plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import rowlore.operators.filter_table as filter_table
import rowlore.operators.phrases as phrases
from rowlore.operators.filter_table import filter_table_match, filter_verdicts, pack_filters
from rowlore.operators.masked import masked_search
from rowlore.operators.phrases import PhraseAutomaton, phrase_matches
from rowlore.plans.answer import catalog_words, rank_datasets, search_multi_filter

RECORDS = "collection string, id long, m map<string,string>, tags map<string,array<string>>, embedding array<float>, text string"
CONDITIONS = "question_id int, ordinal int, key string, values array<string>"


def records_of(pick, n=300):
    vector = lambda: [float(pick.choice([-1, 0, 1, 2])) for _ in range(4)]
    return [
        (
            pick.choice("ccd"), i, {"kind": pick.choice(["A", "b", "C c"]), "size": str(pick.randint(0, 5)), "none": None},
            {"lang": pick.sample(["en", "EN", "de", "fr"], pick.randint(0, 3)), "team": [pick.choice("xyz")]} if i % 11 else None,
            None if i % 17 == 0 else [0.0] * 4 if i % 19 == 0 else vector(), f"text {i}",
        )
        for i in range(n)
    ]


def filters_of(pick, questions):
    options = [("data.kind", ["a", "B", "C C", "%c%"]), ("data.size", ["1", "2", "_", "5"]), ("lang", ["En", "FR", "de"]), ("team", ["X", "y"]), ("data.none", ["1"])]
    rows = []
    for q in range(questions):
        for ordinal in range(pick.randint(1, 3)):
            for key, values in pick.sample(options, pick.randint(0, 3)) or [(None, None)]:
                rows.append((q, ordinal, key, values and pick.sample(values, pick.randint(1, min(2, len(values))))))
    return rows


def meets(record, conditions):
    def like(pattern, text):
        if pattern == "_":
            return len(text) == 1
        return pattern.strip("%") in text if "%" in pattern else pattern == text

    for key, values in conditions:
        if key is None:
            continue
        if key.startswith("data."):
            own = record[2].get(key[5:])
            if own is None or not any(like(v.lower(), own.lower()) for v in values):
                return False
        elif not {v.lower() for v in values} & {t.lower() for t in (record[3] or {}).get(key, [])}:
            return False
    return True


@pytest.fixture(params=["broadcast", "shuffled", "many fields"])
def form(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(filter_table, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(filter_table, "HOT_SHARE", 20)
    if request.param == "many fields":
        monkeypatch.setattr(filter_table, "MAX_ANCHORS", 1)
    return request.param


def test_filters_by_data_and_tags(spark, form):
    pick = random.Random(1)
    records, filters = records_of(pick), filters_of(pick, 40)
    asked = spark.createDataFrame(filters, CONDITIONS).withColumn("collection", F.when(F.col("question_id") % 2 == 0, "c").otherwise("d"))
    packed = pack_filters(asked, ("question_id", "ordinal"), partition="collection").withColumn("filter_id", F.struct("question_id", "ordinal"))
    frame = spark.createDataFrame(records, RECORDS)
    got = filter_table_match(frame, packed, data_map=F.col("m"))
    by = {}
    for q, o, key, values in filters:
        by.setdefault((q, o), []).append((key, values))
    want = Counter(((q, o), r[1]) for (q, o), c in by.items() for r in records if r[0] == "cd"[q % 2] and meets(r, c))
    assert Counter((tuple(r["filter_id"]), r["id"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_tag_filter_is_found_by_a_join(spark):
    frame = spark.createDataFrame(records_of(random.Random(2)), RECORDS)
    asked = spark.createDataFrame([(1, 0, "lang", ["de"])], CONDITIONS).withColumn("collection", F.lit("c"))
    packed = pack_filters(asked, ("question_id",), partition="collection")
    plan = filter_verdicts(frame, packed, "question_id", data_map=F.col("m"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [collection" in plan and "_value_0" in plan


@pytest.mark.parametrize("limit", [3, 0, 1000])
@pytest.mark.parametrize("blocks", [False, True])
def test_masked_search(spark, limit, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr("rowlore.plans.answer.masked_search", lambda *a: masked_search(*a, max_broadcast=2000))
    pick = random.Random(limit)
    records, filters = records_of(pick), filters_of(pick, 25)
    # Every question also has a filter without conditions.
    filters += [(q, 9, None, None) for q in range(25)]
    vectors = {q: None if q == 7 else [0.0] * 4 if q == 8 else [float(pick.randint(-2, 2)) + 0.5 for _ in range(4)] for q in range(25)}
    questions = spark.createDataFrame([(q, "cd"[q % 2], v) for q, v in vectors.items()], "question_id int, collection string, question_vector array<float>")
    frame = spark.createDataFrame(records, RECORDS).repartition(5)
    found = search_multi_filter(frame, questions, spark.createDataFrame(filters, CONDITIONS), limit, data_map=F.col("m"))

    def score(q, r):
        a, b = vectors[q], r[4]
        if a is None or b is None or not np.any(a) or not np.any(b):
            return None
        a, b = np.array(a), np.array(b)
        return (1 + a @ b / np.sqrt((a @ a) * (b @ b))) / 2

    by = {}
    for q, o, key, values in filters:
        by.setdefault((q, o), []).append((key, values))
    want = {}
    for (q, o), conditions in sorted(by.items()):
        hits = [(score(q, r), r) for r in records if r[0] == "cd"[q % 2] and meets(r, conditions)]
        hits.sort(key=lambda h: (h[0] is None, -round(h[0] or 0, 10), h[1][1]))
        for rank, (s, r) in enumerate(hits[: limit or None], 1):
            want.setdefault((q, r[1]), (o, rank, s and round(s, 8), r[5]))
    got = {(r["question_id"], r["id"]): (r["ordinal"], r["rank"], r["score"] and round(r["score"], 8), r["text"]) for r in found.collect()}
    assert got == want


def test_no_arrow_above_an_exploded_match(spark):
    frame = spark.createDataFrame(records_of(random.Random(4)), RECORDS)
    asked = spark.createDataFrame([(5, "data.kind", ["a"]), (6, "data.size", ["1"])], "number long, key string, values array<string>")
    packed = pack_filters(asked.withColumn("collection", F.lit("c")), ("number",), partition="collection")
    matched = filter_verdicts(frame, packed, "number", data_map=F.col("m"))
    filters = asked.select("number", F.lit(None).cast("long").alias("code"), F.array(*[F.lit(1.0)] * 4).alias("question_vector"))
    # Records come one by one with the numbers of their filters, however many those are.
    assert matched.count() == matched.select("id").distinct().count() and matched.where("size(verdicts) = 2").count() > 0
    plan = masked_search(matched, filters, 5, "id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


CATALOG = "collection string, id string, dataset_name string, source_file string, file string, import_date timestamp, import_batch_id string, metadata map<string,string>, columns array<struct<name:string,normalized_name:string,data_type:string,is_required:boolean,description:string,common_values:array<string>>>"


@pytest.mark.parametrize("depth", [1, 2, 16])
def test_ranking_equals_the_full_sum(spark, depth):
    pick = random.Random(depth)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = [
        ("c", f"s{i}", f"set{pick.randint(0, 9)}_{i}", "f", "f", None, "b", {}, [
            (name, name, "string", False, "", ["common thing", *pick.sample(vocabulary, 3)]) for name in pick.sample(vocabulary, 2)
        ])
        for i in range(120)
    ]
    schemas = spark.createDataFrame(rows, CATALOG)
    texts = ["common thing", "common w1 w2", "nothing known", "set3 common", "w1 w2 w3 w4 w5", None, ""] + [" ".join(pick.sample(vocabulary, 4)) for _ in range(20)]
    questions = spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")
    weights = {}
    for r in catalog_words(schemas).collect():
        weights.setdefault(r["word"], []).append((r["dataset_name"], r["weight"]))
    want = set()
    for q, text in enumerate(texts):
        total = Counter()
        for word in set((text or "").split()):
            for dataset, weight in weights.get(word, []):
                total[dataset] += weight
        best = sorted(total.items(), key=lambda e: (-e[1], e[0]))[:3]
        want |= {(q, d, s, i) for i, (d, s) in enumerate(best, 1)}
    got = rank_datasets(questions, schemas, depth=depth)
    assert {(r["question_id"], r["dataset_name"], r["score"], r["rank"]) for r in got.collect()} == want


def in_a_row(phrase, text):
    return any(tuple(text[i : i + len(phrase)]) == phrase for i in range(len(text)))


@pytest.mark.parametrize("blocks", [False, True])
def test_phrases(spark, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(phrases, "BLOCK_PHRASES", 20)
        monkeypatch.setattr(phrases, "BLOCK_TEXTS", 7)
        monkeypatch.setattr(phrases, "HOT_START", 3)
    pick = random.Random(5)
    words = lambda n: [pick.choice("aaab" "cde") for _ in range(n)]
    known = [(pick.choice(["s", "t"]), words(pick.randint(1, 4)), f"v{i}") for i in range(120)] + [("s", ["a", "b"], "x"), ("s", ["a", "b"], "y"), (None, ["a"], "z")]
    texts = [(i, pick.choice(["s", "t", "u", None]), words(pick.randint(0, 9))) for i in range(60)] + [(99, "s", None)]
    got = phrase_matches(
        spark.createDataFrame(texts, "q long, scope string, words array<string>"), spark.createDataFrame(known, "scope string, words array<string>, value string"),
        "scope", 0 if blocks else 1000,
    )
    want = Counter((q, v) for q, s, text in texts for t, phrase, v in known if s is not None and s == t and in_a_row(tuple(phrase), text or []))
    assert want and Counter((r["q"], r["value"]) for r in got.collect()) == want


def test_automaton():
    pick = random.Random(6)
    for _ in range(200):
        known = [("s", tuple(pick.choice("ab") for _ in range(pick.randint(1, 5))), i) for i in range(8)]
        text = [pick.choice("abc") for _ in range(12)]
        assert PhraseAutomaton(iter(known)).found("s", text) == {i for _, p, i in known if in_a_row(p, text)}
