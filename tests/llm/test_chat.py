import json
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rowlore.llm.chat import FORMAT_SQL, canonical, format_conversations, levels, link_calls
from rowlore.plans.sizing import materialize

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on string"
RESULTS = "conv_id long, turn long, call_id string, content string"
MESSAGES = "conv_id long, turn long, role string, content string"
TOOLS = "name string, properties array<struct<name: string, type: string, required: boolean>>"


def test_equals_sql(spark, sf):
    got = format_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cur = db.execute(FORMAT_SQL)
    assert [d[0] for d in cur.description] == got.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter(cur.fetchall())


def test_links_order_and_errors(spark):
    calls = [
        (1, 5, "b", "add", '{"y": 2, "x" : 1}', "a"), (1, 5, "a", "add", '{"x":"one"}', None), (1, 7, "a", "add", '{"x":1,"y":1}', None),
        (1, 8, "n", "none", "{}", None), (1, 9, "j", "add", "not json", "n"), (2, 1, "a", "add", "[1]", "zz"),
        (3, 1, "p", "all", '{"s":"x","n":1.5,"b":true,"o":{"k":[]},"a":[1],"z":null}', "q"), (3, 2, "q", "all", '{"s":1,"n":"x","b":1,"o":[],"a":{},"z":0}', "p"),
        (3, 3, "r", "all", None, "p"), (None, 1, "a", "add", "{}", None), (4, 1, None, "add", "{}", None),
    ]
    results = [(1, 4, "b", "early"), (1, 6, "a", "x"), (1, 6, "a", "x"), (2, 2, "missing", None), (None, 2, "a", "x"), (4, 2, None, "x")]
    tools = [("add", [("x", "integer", True), ("y", "integer", True), ("opt", "string", False)]), ("all", [(n, t, True) for n, t in zip("snboaz", ("string", "number", "boolean", "object", "array", "null"))])]
    plain = spark.createDataFrame([(1, 1, "system", 'say "hi"\n'), (1, 2, None, None)], MESSAGES).withColumn("level", F.lit("clash"))
    made = link_calls(plain, spark.createDataFrame(calls, CALLS).withColumn("json", F.lit(1)), spark.createDataFrame(results, RESULTS), spark.createDataFrame(tools, TOOLS))
    rows = made.collect()
    assert len(rows) == len(calls) + len(results) + 2
    order = [(r["kind"], r["call_id"], r["turn"]) for r in sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: (r["order_turn"], r["order_rank"], r["level"], r["turn"], r["call_id"] or ""))]
    assert order == [
        ("message", None, 1), ("message", None, 2), ("call", "a", 5), ("call", "b", 5), ("result", "b", 4), ("result", "a", 6), ("result", "a", 6),
        ("call", "a", 7), ("call", "n", 8), ("call", "j", 9),
    ]
    by = {(r["conv_id"], r["kind"], r["call_id"], r["turn"]): r for r in rows}
    assert by[1, "call", "b", 5]["json"] == '{"arguments":{"x":1,"y":2},"id":"b","name":"add","role":"assistant","type":"call"}'
    assert by[1, "call", "a", 5]["errors"] == "type of x; missing y" and by[1, "call", "a", 7]["valid"]
    assert by[1, "call", "n", 8]["errors"] == "unknown tool" and by[1, "call", "j", 9]["errors"] == "arguments are no object"
    assert by[2, "call", "a", 1]["errors"] == "arguments are no object" and by[2, "call", "a", 1]["level"] == 0
    assert by[3, "call", "p", 1]["valid"] and by[3, "call", "q", 2]["errors"] == "; ".join(f"type of {n}" for n in "snboaz")
    assert [by[3, "call", c, t]["level"] for c, t in (("p", 1), ("q", 2), ("r", 3))] == [-1, -1, -1]
    assert by[2, "result", "missing", 2]["errors"] == "no call" and not by[None, "result", "a", 2]["linked"] and not by[4, "result", None, 2]["linked"]
    assert json.loads(by[1, "message", None, 1]["json"]) == {"content": 'say "hi"\n', "role": "system", "type": "message"}
    assert all(json.loads(r["json"]) is not None for r in rows)
    none = [spark.createDataFrame([], s) for s in (MESSAGES, CALLS, RESULTS, TOOLS)]
    assert link_calls(*none).count() == 0


def brute_levels(calls, edges):
    """(level, last turn before) of each call by plain search; -1 on or behind a cycle."""
    before = {c: {d for a, d in edges if a == c and d in calls} for c in calls}

    def reach(call):
        seen, rest = set(), [call]
        while rest:
            for d in before[rest.pop()] - seen:
                seen.add(d)
                rest.append(d)
        return seen

    above = {c: reach(c) for c in calls}
    out = {}

    def level(c):
        if c not in out:
            out[c] = -1 if any(d in above[d] for d in above[c] | {c}) else max((1 + level(d) for d in before[c]), default=0)
        return out[c]

    return {c: (level(c), max((calls[d] for d in above[c]), default=None) if out[c] >= 0 else None) for c in calls if level(c) is not None}


LEVELS = ("conv_id long, call_id string, turn long", "conv_id long, call_id string, depends_on string")


@pytest.mark.parametrize("seed", range(3))
def test_levels_equal_brute_force(spark, seed):
    pick = random.Random(seed)
    names = [f"c{i}" for i in range(40)]
    calls = {c: pick.randint(0, 30) for c in names}
    edges = [(names[i], names[pick.randrange(i)]) for i in range(1, 40) for _ in range(pick.randint(0, 2))] + [("c3", "gone")]
    edges += [(names[i], names[i - 1]) for i in range(20, 40)] if seed == 1 else [("c5", "c30"), ("c7", "c7")] if seed == 2 else []
    frames = spark.createDataFrame([(1, c, t) for c, t in calls.items()], LEVELS[0]), spark.createDataFrame([(1, a, b) for a, b in edges], LEVELS[1])
    assert {r["call_id"]: (r["level"], r["after"]) for r in levels(*frames).collect()} == brute_levels(calls, edges)


def test_levels_of_a_long_chain(spark):
    calls = spark.createDataFrame([(1, f"c{i}", i) for i in range(200)], LEVELS[0])
    edges = spark.createDataFrame([(1, f"c{i}", f"c{i - 1}") for i in range(200)], LEVELS[1])
    assert {r["call_id"]: r["level"] for r in levels(calls, edges).collect()} == {f"c{i}": i for i in range(200)}


def test_levels_with_shortcuts_and_cycles(spark, monkeypatch):
    """Calls that depend on the three before, and three that all depend on each other: few rounds, the same levels."""
    calls = {f"c{i:03}": i for i in range(60)} | {"x": 1, "y": 2, "z": 3, "behind": 0}
    names = list(calls)[:60]
    edges = [(names[i], names[i - k]) for i in range(60) for k in (1, 2, 3) if i >= k] + [(a, b) for a in "xyz" for b in "xyz" if a != b] + [("behind", "z")]
    frames = spark.createDataFrame([(1, c, t) for c, t in calls.items()], LEVELS[0]), spark.createDataFrame([(1, a, b) for a, b in edges], LEVELS[1])
    written = []
    monkeypatch.setattr("rowlore.llm.chat.materialize", lambda df, label: written.append(label) or materialize(df, label))
    assert {r["call_id"]: (r["level"], r["after"]) for r in levels(*frames).collect()} == brute_levels(calls, edges)
    assert written.count("live") < 20


def test_order_of_several_dependencies(spark):
    """Two dependencies, one of them absent, and one in a later turn."""
    calls = [(1, 1, "x", "t", "{}", "y"), (1, 3, "y", "t", "{}", None), (1, 4, "a", "t", "{}", None), (1, 4, "c", "t", "{}", "a"), (1, 4, "d", "t", "{}", "c"), (1, 4, "e", "t", "{}", "a")]
    more = spark.createDataFrame([(1, "d", "absent"), (1, "e", "c"), (1, "e", None)], LEVELS[1])
    results = spark.createDataFrame([(1, 2, "x", "r"), (1, 4, "e", "r")], RESULTS)
    tools = spark.createDataFrame([("t", [("q", "string", True)]), ("t", [("p", "string", False)])], TOOLS)
    made = link_calls(spark.createDataFrame([(1, 2, "user", "m")], MESSAGES), spark.createDataFrame(calls, CALLS), results, tools, more).collect()
    order = [r["call_id"] or r["kind"] for r in sorted(made, key=lambda r: (r["order_turn"], r["order_rank"], r["level"], r["turn"], r["call_id"] or ""))]
    assert order == ["message", "y", "x", "x", "a", "c", "d", "e", "e"]
    assert {r["call_id"]: r["level"] for r in made if r["kind"] == "call"} == {"x": 1, "y": 0, "a": 0, "c": 1, "d": 2, "e": 2}
    # Of a tool listed twice the least schema counts, whatever the order of rows.
    assert all(r["errors"] == "" for r in made if r["kind"] == "call")


@pytest.mark.parametrize("text, want", [('{"b":1, "a":{"d":[1, 2],"c":"é"}}', '{"a":{"c":"é","d":[1,2]},"b":1}'), ("{", None), (None, None), ("", None)])
def test_canonical(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(canonical(F.col("t"))).first()[0] == want
