"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlore.plans.sizing import materialize

# JSON types of a schema and what the type of a parsed value begins with.
JSON_TYPES = {
    "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"),
    "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",),
}
MESSAGE_COLUMNS = ("conv_id", "turn", "kind", "call_id", "level", "linked", "valid", "errors", "order_turn", "order_rank", "json")


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no white space; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


NODE = ["conv_id", "call_id"]
# Links into and out of a call through which shortcuts are looked for.
FEW = 8


def _without_shortcuts(links: DataFrame) -> DataFrame:
    """Links less those that two others together stand for: a call that depends on the last and the one before that.

    Only links that lead on in one order of calls (by turn, or against it) are looked at, so
    what is reached stays the same, on cycles too. Only links through calls of few links are
    tried: others cost rounds, not results.
    """
    few = lambda c: links.groupBy("conv_id", F.col(c).alias("via")).agg(F.count("*").alias(f"_{c}")).filter(F.col(f"_{c}") <= FEW).drop(f"_{c}")
    first = links.select("conv_id", "src", F.col("dst").alias("via"), F.col("_from").alias("_a"), F.col("_to").alias("_b"))
    second = links.select("conv_id", F.col("src").alias("via"), "dst", F.col("_to").alias("_c"))
    met = first.join(few("src"), ["conv_id", "via"]).join(few("dst"), ["conv_id", "via"]).join(second, ["conv_id", "via"])
    onward = (F.col("_a") < F.col("_b")) & (F.col("_b") < F.col("_c")) | (F.col("_a") > F.col("_b")) & (F.col("_b") > F.col("_c"))
    return links.join(met.filter(onward).select("conv_id", "src", "dst"), ["conv_id", "src", "dst"], "left_anti")


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, after): the longest chain of calls that must come before a call, and the last turn of those.

    `calls` has (conv_id, call_id, turn), `edges` (conv_id, call_id, depends_on); a
    call may depend on any number of others, those that aren't there don't count, and of repeated
    calls the first turn does. Each round takes off the calls that wait for none, whose level
    is then known, and splices calls with one predecessor and one successor out of
    chains: one whose hash exceeds those of both, so no two neighbours go at once. So a long
    chain takes a logarithm of rounds, with or without shortcuts; other shapes one for each level that is left. What stays when nothing more can go is on or
    behind a cycle: level -1. Spliced calls get theirs from their predecessor's, last
    round first. Each round is written to the shared folder.
    """
    nodes = calls.groupBy(*NODE).agg(F.min("turn").alias("turn"))
    links = edges.select("conv_id", F.col("depends_on").alias("src"), F.col("call_id").alias("dst")).distinct()
    place = lambda name, at: nodes.select("conv_id", F.col("call_id").alias(name), F.struct("turn", "call_id").alias(at))
    links = links.join(place("src", "_from"), ["conv_id", "src"]).join(place("dst", "_to"), ["conv_id", "dst"])
    links = _without_shortcuts(materialize(links, "links"))
    links = materialize(links.select("conv_id", "src", "dst", F.lit(1).cast("long").alias("steps"), F.lit(None).cast("long").alias("turns")), "links")
    live = nodes.withColumns({"level": F.lit(0).cast("long"), "after": F.lit(None).cast("long")})
    done, spliced, number = [], [], 0
    while True:
        into = links.groupBy("conv_id", F.col("dst").alias("call_id")).agg(F.count("*").alias("n_in"), F.min("src").alias("src"), F.min("steps").alias("steps"), F.min("turns").alias("turns"))
        out = links.groupBy("conv_id", F.col("src").alias("call_id")).agg(F.count("*").alias("n_out"), F.min("dst").alias("dst"), F.min("steps").alias("_steps"), F.min("turns").alias("_turns"))
        state = materialize(live.join(into, NODE, "left").join(out, NODE, "left").fillna(0, ["n_in", "n_out"]), "levels")
        inner = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.col("level") == 0) & F.col("after").isNull() & (F.col("src") != F.col("call_id"))
        if state.filter((F.col("n_in") == 0) | inner).isEmpty():
            break
        rank = lambda c: F.xxhash64("conv_id", c, F.lit(number))  # noqa: E731, B023
        goes = inner & (rank("call_id") > rank("src")) & (rank("call_id") > rank("dst"))
        first, cut = state.filter("n_in = 0"), state.filter(goes)
        done.append(first.select(*NODE, "turn", "level", "after"))
        spliced.append(cut.select(*NODE, "turn", "src", "steps", "turns"))
        joined = cut.select("conv_id", "src", "dst", (F.col("steps") + F.col("_steps")).alias("steps"), F.greatest("turns", "turn", "_turns").alias("turns"))
        gone = cut.select(*NODE)
        kept = links.join(gone.withColumnRenamed("call_id", "src"), ["conv_id", "src"], "left_anti").join(gone.withColumnRenamed("call_id", "dst"), ["conv_id", "dst"], "left_anti")
        kept = kept.unionByName(joined).groupBy("conv_id", "src", "dst").agg(F.max("steps").alias("steps"), F.max("turns").alias("turns"))
        kept = materialize(kept, "links")
        before = first.select("conv_id", F.col("call_id").alias("src"), "level", F.greatest("turn", "after").alias("_turn"))
        pushed = kept.join(before, ["conv_id", "src"]).groupBy("conv_id", F.col("dst").alias("call_id")).agg(
            F.max(F.col("level") + F.col("steps")).alias("_level"), F.max(F.greatest("_turn", "turns")).alias("_after")
        )
        rest = state.filter((F.col("n_in") > 0) & ~goes).select(*NODE, "turn", "level", "after").join(pushed, NODE, "left")
        live = materialize(rest.select(*NODE, "turn", F.greatest("level", "_level").alias("level"), F.greatest("after", "_after").alias("after")), "live")
        links, number = kept.join(before.select("conv_id", "src"), ["conv_id", "src"], "left_anti"), number + 1
    known = state.select(*NODE, "turn", F.lit(-1).cast("long").alias("level"), F.lit(None).cast("long").alias("after"))
    for found in done:
        known = known.unionByName(found)
    for cut in reversed(spliced):
        above = known.select("conv_id", F.col("call_id").alias("src"), F.col("turn").alias("_turn"), F.col("level").alias("_level"), F.col("after").alias("_after"))
        level = F.when(F.col("_level") < 0, F.lit(-1).cast("long")).otherwise(F.col("_level") + F.col("steps"))
        after = F.when(F.col("_level") >= 0, F.greatest("_turn", "_after", "turns"))
        back = cut.join(above, ["conv_id", "src"]).select(*NODE, "turn", level.alias("level"), after.alias("after"))
        known = known.unionByName(materialize(back, "levels"))
    return known.drop("turn")


def argument_errors(arguments: str, properties: str) -> Column:
    """What is wrong with JSON `arguments` by `properties`, an array of (name, type, required) or null.

    Arguments that are no JSON object are one error. Each property that is
    required and not there, or has a value of another type, is one, in the order of
    `properties`; a tool without a schema is "unknown tool".
    """
    kinds = " ".join(f"WHEN '{k}' THEN " + " OR ".join(f"t LIKE '{x}%'" for x in v) for k, v in JSON_TYPES.items())
    return F.expr(f"""
      CASE WHEN {properties} IS NULL THEN array('unknown tool')
      WHEN coalesce(schema_of_variant(try_parse_json({arguments})), '') NOT LIKE 'OBJECT%' THEN array('arguments are no object')
      ELSE filter(transform({properties}, p -> CASE
        WHEN NOT map_contains_key(_fields, p.name) THEN CASE WHEN p.required THEN concat('missing ', p.name) END
        WHEN NOT exists(array(schema_of_variant(element_at(_fields, p.name))), t -> CASE p.type {kinds} ELSE true END) THEN concat('type of ', p.name)
        END), e -> e IS NOT NULL) END""")


def link_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, tools: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """Every message of conversations as a row with its place and its canonical JSON.

    messages: (conv_id, turn, role, content), which are neither calls nor results;
    calls: (conv_id, turn, call_id, name, arguments, depends_on); results:
    (conv_id, turn, call_id, content); tools: (name, properties), properties an
    array of (name, type, required) structs; of a tool listed twice the least one counts;
    dependencies: (conv_id, call_id, depends_on), for calls that depend on more than one.

    A result belongs to the first call of its identifier in the conversation.
    Rows sorted by (order_turn, order_rank, level, turn, call_id) are in
    topological order: a call moves behind the last turn of all that it depends on, over
    any number of steps, calls of one turn go by level, and a result that stands before its call moves
    to the call's turn. Calls on or behind a cycle keep their turn, with level -1. `linked`
    says that a call has a result or a result its call; plain messages are
    linked to nothing and valid. Rows stay rows, so no conversation is gathered in
    one task. Null texts are null in the JSON, rows with a null conv_id or call_id link with nothing,
    and equal rows stay apart. Other columns are ignored.
    """
    calls = calls.select("conv_id", F.col("turn").cast("long"), F.col("call_id").cast("string"), "name", "arguments", F.col("depends_on").cast("string"))
    results = results.select("conv_id", F.col("turn").cast("long"), F.col("call_id").cast("string"), "content")
    named = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL")
    answered = results.groupBy("conv_id", "call_id").agg(F.lit(True).alias("_answered"))
    edges = calls.select("conv_id", "call_id", "depends_on")
    if dependencies is not None:
        edges = edges.unionByName(dependencies.select("conv_id", F.col("call_id").cast("string"), F.col("depends_on").cast("string")))
    depth = levels(named, edges)
    first = named.groupBy("conv_id", "call_id").agg(F.min("turn").alias("_call_turn"), F.lit(True).alias("_called"))
    kinds = tools.groupBy("name").agg(F.min("properties").alias("_properties"))
    found = calls.join(answered.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(depth, ["conv_id", "call_id"], "left").join(kinds, "name", "left")
    found = found.withColumn("_fields", F.expr("try_variant_get(try_parse_json(arguments), '$', 'map<string, variant>')"))
    found = found.withColumn("errors", argument_errors("arguments", "_properties"))
    # Members stand in the order of their names.
    call = F.to_json(F.struct(
        F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(F.to_json(F.array("arguments"), {"ignoreNullFields": "false"}))).alias("arguments"),
        F.col("call_id").alias("id"), F.col("name"), F.lit("assistant").alias("role"), F.lit("call").alias("type"),
    ), {"ignoreNullFields": "false"})
    call_rows = found.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.coalesce("level", F.lit(0)).cast("long").alias("level"),
        F.coalesce("_answered", F.lit(False)).alias("linked"), (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"),
        F.greatest("turn", "after").alias("order_turn"), F.lit(0).alias("order_rank"), call.alias("json"),
    )
    met = results.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(depth, ["conv_id", "call_id"], "left")
    result = F.to_json(F.struct(F.col("content"), F.col("call_id").alias("id"), F.lit("tool").alias("role"), F.lit("result").alias("type")), {"ignoreNullFields": "false"})
    linked = F.col("_called").isNotNull()
    result_rows = met.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.coalesce("level", F.lit(0)).cast("long").alias("level"),
        linked.alias("linked"), linked.alias("valid"), F.when(linked, "").otherwise("no call").alias("errors"),
        F.greatest("turn", "_call_turn", "after").alias("order_turn"), F.lit(1).alias("order_rank"), result.alias("json"),
    )
    plain = F.to_json(F.struct(F.col("content"), F.col("role"), F.lit("message").alias("type")), {"ignoreNullFields": "false"})
    plain_rows = messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(0).cast("long").alias("level"),
        F.lit(False).alias("linked"), F.lit(True).alias("valid"), F.lit("").alias("errors"),
        F.col("turn").cast("long").alias("order_turn"), F.lit(0).alias("order_rank"), plain.alias("json"),
    )
    return call_rows.union(result_rows).union(plain_rows).select(*MESSAGE_COLUMNS)


def as_exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(messages, calls, results, dependencies) of plain turns (conv_id, turn, role, text).

    A user's turn asks: it is a call of the tool `answer` whose arguments are the
    text and the turn. In conversations of even id it depends on the calls two and four turns
    before; in others on the call two turns after, so that the last one has to come first. The assistant's
    turn is the result of the call one turn before. Other roles are messages.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda turn: F.concat(F.lit("call-"), (F.col("turn") + turn).cast("string"))
    asked, even = rows.filter("role = 'user'"), F.col("conv_id") % 2 == 0
    calls = asked.select(
        "conv_id", "turn", name(0).alias("call_id"), F.when(F.col("role") == "user", "answer").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"), F.when(even, name(-2)).otherwise(name(2)).alias("depends_on"),
    )
    dependencies = asked.filter(even).select("conv_id", name(0).alias("call_id"), name(-4).alias("depends_on"))
    results = rows.filter("role = 'assistant'").select("conv_id", "turn", name(-1).alias("call_id"), F.col("text").alias("content"))
    plain = rows.filter("role IS NULL OR role NOT IN ('user', 'assistant')")
    return plain.select("conv_id", "turn", "role", F.col("text").alias("content")), calls, results, dependencies


def format_conversations(conversations: DataFrame) -> DataFrame:
    """`link_calls` over `as_exchanges` of plain turns, with the schema of the tool `answer`."""
    plain, calls, results, dependencies = as_exchanges(conversations)
    text, turn = (f"named_struct('name', '{n}', 'type', '{t}', 'required', true)" for n, t in (("text", "string"), ("turn", "integer")))
    tools = conversations.sparkSession.sql(f"SELECT * FROM VALUES ('answer', array({text}, {turn})) AS t(name, properties)")
    return link_calls(plain, calls, results, tools, dependencies)


FORMAT_SQL = """
WITH RECURSIVE asked AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL),
edges AS (SELECT a.conv_id, a.turn AS dst, b.turn AS src FROM asked a JOIN asked b ON a.conv_id = b.conv_id
  AND CASE WHEN a.conv_id % 2 = 0 THEN b.turn IN (a.turn - 2, a.turn - 4) ELSE b.turn = a.turn + 2 END),
paths AS (SELECT conv_id, turn, 0::BIGINT AS level, NULL::BIGINT AS after FROM asked
  UNION ALL SELECT e.conv_id, e.dst, p.level + 1, greatest(p.after, e.src) FROM paths p JOIN edges e ON e.conv_id = p.conv_id AND e.src = p.turn),
depth AS (SELECT conv_id, turn, max(level) AS level, max(after) AS after FROM paths GROUP BY ALL),
answered AS (SELECT DISTINCT conv_id, turn - 1 AS turn FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, c.turn, 'call' AS kind, 'call-' || c.turn AS call_id, d.level, a.turn IS NOT NULL AS linked, c.text IS NOT NULL AS valid,
  CASE WHEN c.text IS NULL THEN 'missing text' ELSE '' END AS errors, greatest(c.turn, d.after) AS order_turn, 0 AS order_rank,
  '{"arguments":{"text":' || to_json(c.text) || ',"turn":' || c.turn || '},"id":"call-' || c.turn || '","name":"answer","role":"assistant","type":"call"}' AS json
FROM conversations c JOIN depth d USING (conv_id, turn) LEFT JOIN answered a USING (conv_id, turn) WHERE c.role = 'user'
UNION ALL
SELECT c.conv_id, c.turn, 'result', 'call-' || (c.turn - 1), coalesce(d.level, 0), d.level IS NOT NULL, d.level IS NOT NULL,
  CASE WHEN d.level IS NULL THEN 'no call' ELSE '' END, greatest(c.turn, d.turn, d.after), 1,
  '{"content":' || to_json(c.text) || ',"id":"call-' || (c.turn - 1) || '","role":"tool","type":"result"}'
FROM conversations c LEFT JOIN depth d ON c.conv_id = d.conv_id AND c.turn - 1 = d.turn WHERE c.role = 'assistant'
UNION ALL
SELECT conv_id, turn, 'message', NULL, 0, false, true, '', turn, 0, '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}'
FROM conversations WHERE role NOT IN ('user', 'assistant')
"""
