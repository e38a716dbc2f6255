"""The trie of conversation prefixes, its subtree totals found by parallel tree contraction."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlore.plans.sizing import materialize, scratch_dir

# Conversations of one block share the first turns of the block's first conversation.
BLOCK = 20
HEADS = 4
# Prefixes are polynomials of turn digests modulo 2**64, in two lanes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
DEPTH_MARK = 0xD6E8FEB86659FD93
CHUNK = 1 << 14
NODE, PARENT = ["n1", "n2"], ["p1", "p2"]
SCANNED = "part long, conv_id long, pos long, s1 long, s2 long, x1 long, x2 long, words long"
TURNS = "conv_id long, pos long, s1 long, s2 long, x1 long, x2 long, words long"
STEPS = "conv_id long, depth long, n1 long, n2 long, p1 long, p2 long, words long, last boolean"
NOTHING = sha256(b"").hexdigest()


def _u(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _table(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    own = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(own, names=[n.split(" ")[0] for n in names.split(", ")])


def _power(exponent: np.ndarray, base: int = BASE) -> np.ndarray:
    """base ** exponent modulo 2**64, by squaring."""
    left, square, out = exponent.astype(np.int64), np.uint64(base), np.ones(len(exponent), np.uint64)
    with np.errstate(over="ignore"):
        while left.any():
            out = np.where(left & 1, out * square, out)
            square, left = square * square, left >> 1
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and prefix polynomials of sorted turns, counted from where a conversation begins in this partition."""
    part, conv, pos, sums = TaskContext.get().partitionId(), None, 0, (np.uint64(0), np.uint64(0))
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(0).to_numpy()
        lanes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(n, -1)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        place = np.arange(n) - first[group]
        goes_on = ids[0] == conv
        if goes_on:
            place = place + np.where(group == 0, pos, 0)
        powers, found = _power(place), []
        for lane in range(2):
            total = np.cumsum(lanes[:, lane] * powers, dtype=np.uint64)
            before = np.concatenate([np.zeros(1, np.uint64), total])[first]
            if goes_on:
                before[0] -= sums[lane]
            found.append(total - before[group])
        yield _table(SCANNED, np.full(n, part), ids, place, *found, lanes[:, 0], lanes[:, 1], batch.column(2).to_numpy())
        conv, pos, sums = ids[-1], int(place[-1]) + 1, (found[0][-1], found[1][-1])


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and polynomials from the conversation's own beginning, by what earlier partitions have of it."""
    for batch in batches:
        conv, pos, s1, s2, x1, x2, words, p0, o1, o2 = (batch.column(i) for i in range(10))
        before = _u(p0)
        by = _power(before.view(np.int64))
        yield _table(TURNS, _u(conv), _u(pos) + before, _u(o1) + by * _u(s1), _u(o2) + by * _u(s2), _u(x1), _u(x2), _u(words))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, prefix polynomials, digest, words) of every turn; pos counts from 0 in the order of `turn`.

    Turns are sorted by ranges, so a conversation of any length is spread over
    partitions; each counts by itself, and what one partition has of the conversation
    that runs on in the next is added after. That is one row a partition.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), whole.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("_salt"),
    )
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartitionByRange(parts, "conv_id", "turn", "digest", "_salt").sortWithinPartitions("conv_id", "turn", "digest")
    scanned = materialize(dealt.select("conv_id", F.unhex("digest"), "words").mapInArrow(_scan, SCANNED), "scanned")
    last = F.max_by(F.struct("conv_id", (F.col("pos") + 1).alias("n"), "s1", "s2"), F.struct("conv_id", "pos"))
    edges = scanned.groupBy("part").agg(F.min("conv_id").alias("first"), last.alias("last")).orderBy("part").collect()
    carried, rows = None, []
    for edge in edges:
        conv, n, sums = edge["last"]["conv_id"], edge["last"]["n"], [edge["last"][s] for s in ("s1", "s2")]
        if carried and carried[0] == edge["first"]:
            rows.append((edge["part"], *carried))
            if edge["first"] == conv:
                by = pow(BASE, carried[1], 1 << 64)
                sums = [(o + by * s + (1 << 63)) % (1 << 64) - (1 << 63) for o, s in zip(carried[2:], sums)]
                n += carried[1]
        carried = (conv, n, *sums)
    # One row a partition at most.
    offsets = conversations.sparkSession.createDataFrame(rows, "part long, conv_id long, p0 long, o1 long, o2 long")
    met = scanned.join(F.broadcast(offsets), ["part", "conv_id"], "left").na.fill(0, ["p0", "o1", "o2"])
    return materialize(met.drop("part").mapInArrow(_shift, TURNS), "turns")


def _own_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that a conversation's own turns lead to, behind the shared ones."""
    for batch in batches:
        conv, pos, s1, s2, x1, x2, words, n, h, m, b1, b2, h1, h2 = (_u(batch.column(i)) for i in range(14))
        depth = m + pos - h + np.uint64(1)
        back, last = _power((h - m).view(np.int64), INVERSE), _power((depth - np.uint64(1)).view(np.int64))
        nodes = [b + (s - o) * back for b, s, o in ((b1, s1, h1), (b2, s2, h2))]
        before = [node - x * last for node, x in zip(nodes, (x1, x2))]
        yield _steps(conv, depth, nodes, before, words, pos + np.uint64(1) == n)


def _shared_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, depth, s1, s2, x1, x2, words, last = (_u(batch.column(i)) for i in range(8))
        by = _power((depth - np.uint64(1)).view(np.int64))
        yield _steps(conv, depth, [s1, s2], [s1 - x1 * by, s2 - x2 * by], words, last == 1)


def _steps(conv, depth, nodes, before, words, last) -> pa.RecordBatch:
    mark = depth * np.uint64(DEPTH_MARK)
    above = (depth - np.uint64(1)) * np.uint64(DEPTH_MARK)
    return _table(STEPS, conv, depth, nodes[0] + mark, nodes[1], before[0] + above, before[1], words, last)


def rebuilt_steps(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, conversations): every turn of every rebuilt conversation with its node and parent; (conv_id, length).

    The polynomial of a rebuilt prefix follows from those of the two conversations
    that it is made of, so no conversation is gathered.
    """
    head = F.when(F.col("pos") < HEADS - 1, F.struct("pos", "s1", "s2", "x1", "x2", "words"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(head)).alias("heads"))
    convs = materialize(convs.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEADS), "conversations")
    first = convs.select(F.col("conv_id").alias("_b"), F.col("heads").alias("base"))
    met = convs.join(first, convs["conv_id"] - convs["conv_id"] % BLOCK == first["_b"], "left")
    met = met.withColumn("m", F.least("h", F.coalesce(F.size("base"), F.lit(0))).cast("long"))
    at = lambda heads, i, lane: F.coalesce(F.get(heads, (i - 1).cast("int"))[lane], F.lit(0)).alias
    met = met.select(
        "conv_id", "n", "h", "m", "base", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        at("base", F.col("m"), "s1")("b1"), at("base", F.col("m"), "s2")("b2"), at("heads", F.col("h"), "s1")("h1"), at("heads", F.col("h"), "s2")("h2"),
    )
    met = materialize(met, "rebuilt")
    own = turns.join(met.select("conv_id", "n", "h", "m", "b1", "b2", "h1", "h2"), "conv_id").filter("pos >= h")
    shared = met.select("conv_id", "m", "length", F.explode(F.slice("base", F.lit(1), F.col("m").cast("int"))).alias("t"))
    depth = F.col("t.pos") + 1
    shared = shared.select("conv_id", depth.alias("depth"), "t.s1", "t.s2", "t.x1", "t.x2", "t.words", (depth == F.col("length")).cast("long").alias("last"))
    steps = own.mapInArrow(_own_steps, STEPS).union(shared.mapInArrow(_shared_steps, STEPS))
    return materialize(steps, "steps"), met.select("conv_id", "length")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each node as decimal text, some thousand to a row."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        n1, n2, conv = (batch.column(i).to_numpy() for i in range(3))
        if not len(n1):
            continue
        first = np.flatnonzero(np.r_[True, (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])])
        cuts = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(first, np.append(first[1:], len(n1)))])
        texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(n1)))]
        columns = [n1[cuts], n2[cuts], np.full(len(cuts), part), number + np.arange(len(cuts))]
        number += len(cuts)
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(texts)], names=["n1", "n2", "part", "number", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, in order; one chunk at a time."""
    now, state = None, None

    def out(done: list) -> pa.RecordBatch:
        names = ["n1", "n2", "ends_sha256"]
        columns = zip(*done) if done else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=names)

    for batch in batches:
        done = []
        for n1, n2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4))):
            if now == (n1, n2):
                state.update(b",")
            else:
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (n1, n2), sha256()
            state.update(ids.encode())
        yield out(done)
    if now:
        yield out([(*now, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) of (n1, n2, conv_id): a digest of each node's ids in order; a node's ids may be many."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*NODE, "conv_id"]
    dealt = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    chunks = dealt.mapInArrow(_chunks, "n1 long, n2 long, part long, number long, ids string")
    return chunks.repartition(parts, *NODE).sortWithinPartitions(*NODE, "part", "number").mapInArrow(_digests, "n1 long, n2 long, ends_sha256 string")


def _renamed(df: DataFrame, names: list[str], to: list[str], *rest: Column | str) -> DataFrame:
    return df.select(*(F.col(a).alias(b) for a, b in zip(names, to)), *rest)


def _children(live: DataFrame, stays: Column, values: list[str]) -> DataFrame:
    """For each parent: how many children stay, the only one if it is one, and what the others bring."""
    one = lambda c: F.bit_xor(F.when(stays, F.col(c)).otherwise(F.lit(0)))
    bring = [F.sum(F.when(stays, 0).otherwise(F.col(v) + F.col(f"edge_{v}"))).alias(f"_{v}") for v in values]
    found = live.filter("NOT root").groupBy(*PARENT).agg(F.count_if(stays).alias("k"), one("n1").alias("o1"), one("n2").alias("o2"), *bring)
    return _renamed(found, PARENT, NODE, "k", "o1", "o2", *(f"_{v}" for v in values))


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Sums of long columns over the subtrees of a forest of (n1, n2, p1, p2, root, values), the top included.

    Each round splices nodes out of chains (compress) and takes leaves off (rake).
    Spliced is a node with one child whose hash exceeds those of its child
    and parent, so no two neighbours go at once; the child is hung one higher, and
    its edge carries the node's values. A leaf's total is known; it goes to its
    parent. The rounds grow as the logarithm of the number of nodes, whatever
    the tree's shape. Then the rounds are undone, last first: a spliced node's
    total is what was recorded for it plus the total of its child at that time. Joins go
    along chains, one row to one; all children of a parent meet in a sum
    that is combined before the shuffle. Each round's rows are written to the shared folder.
    """
    start = nodes.select(*NODE, *PARENT, "root", *values, *(F.lit(0).cast("long").alias(f"edge_{v}") for v in values))
    live = _grown(start, _children(start, F.lit(True), values), values)
    live = materialize(live, "tree")
    read, steps = live.sparkSession.read, []
    while not live.filter("k > 0").isEmpty():
        rank = lambda names: F.xxhash64(*names, F.lit(len(steps)))
        goes = (F.col("k") == 1) & ~F.col("root") & (rank(NODE) > rank(PARENT)) & (rank(NODE) > rank(["o1", "o2"]))
        out = _renamed(live.filter(goes), ["o1", "o2", *NODE, *PARENT], [*NODE, "g1", "g2", "_p1", "_p2"], *(F.col(v).alias(f"_{v}") for v in values), *(F.col(f"edge_{v}").alias(f"_edge_{v}") for v in values))
        met = live.filter(~goes).join(out, NODE, "left")
        gone = F.col("g1").isNotNull()
        step = met.select(
            *NODE, *(F.when(gone, F.col(f"_{p}")).otherwise(F.col(p)).alias(p) for p in PARENT), "root", "k", *values,
            *(F.when(gone, F.col(f"edge_{v}") + F.col(f"_{v}") + F.col(f"_edge_{v}")).otherwise(F.col(f"edge_{v}")).alias(f"edge_{v}") for v in values),
            "g1", "g2", *((F.col(f"_{v}") + F.col(f"edge_{v}")).alias(f"gone_{v}") for v in values),
        )
        steps.append(scratch_dir(live.sparkSession, "tree"))
        step.write.parquet(steps[-1])
        rest = read.parquet(steps[-1]).filter("k > 0 OR root").drop("k", "g1", "g2", *(f"gone_{v}" for v in values))
        children = _children(read.parquet(steps[-1]), F.col("k") > 0, values)
        live = materialize(_grown(rest, children, values), "tree")
    totals, undone = live.select(*NODE, *values), []
    for i in reversed(range(len(steps))):
        # Leaves of this and later rounds, and nodes spliced in later ones, have their totals by now.
        known = totals.union(read.parquet(*steps[i:]).filter("k = 0 AND NOT root").select(*NODE, *values))
        known = known.union(read.parquet(*undone)) if undone else known
        links = read.parquet(steps[i]).filter("g1 IS NOT NULL").select("g1", "g2", *NODE, *(f"gone_{v}" for v in values))
        back = links.join(known, NODE).select(F.col("g1").alias("n1"), F.col("g2").alias("n2"), *((F.col(f"gone_{v}") + F.col(v)).alias(v) for v in values))
        undone.append(scratch_dir(live.sparkSession, "totals"))
        back.write.parquet(undone[-1])
    if not steps:
        return totals
    return totals.union(read.parquet(*steps).filter("k = 0 AND NOT root").select(*NODE, *values)).union(read.parquet(*undone))


def _grown(live: DataFrame, children: DataFrame, values: list[str]) -> DataFrame:
    met = live.join(children, NODE, "left")
    more = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
    return met.select(*NODE, *PARENT, "root", F.coalesce("k", F.lit(0)).cast("long").alias("k"), "o1", "o2", *more, *(f"edge_{v}" for v in values))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with its members and subtree totals.

    A rebuilt conversation has the first h turns of its block's first one (all if
    fewer, none if that is absent), then its own after the first h; h follows from
    its id. A node is a distinct sequence of first turns (role, text); the root is
    the empty one, of which all are members, turnless ones too. Null roles and texts
    are empty. Turns of one number are ordered by SHA-256 of length, role and
    text, equal turns all count; rows without conv_id belong to no conversation and
    are left out. Other columns are ignored; an empty table has no node. Sequences
    are told apart by 128 bits of polynomials over SHA-256 of their turns, and their length.
    """
    steps, convs = rebuilt_steps(ordered_turns(conversations))
    key = [*NODE, "depth"]
    found = steps.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("words").alias("words"))
    zero = [F.lit(0).cast("long").alias(c) for c in key]
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    top = top.select(*zero, "conv_id", "n_convs", *(F.lit(None).cast("long").alias(c) for c in (*PARENT, "words")))
    nodes = materialize(found.union(top).withColumn("root", F.col("depth") == 0), "nodes")
    below = nodes.filter("NOT root").groupBy(*PARENT).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(_renamed(below, PARENT, NODE, "n_children"), NODE, "left").na.fill(0, ["n_children", "words"]), "nodes")
    worth = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    totals = subtree_totals(worth, ["n_leaves", "saved_tokens"])
    ends = steps.filter("last").select(*NODE, "conv_id").union(convs.filter("length = 0").select(*zero[:2], "conv_id"))
    above = _renamed(nodes, [*NODE, "conv_id"], [*PARENT, "parent_conv_id"])
    met = nodes.join(totals, NODE).join(end_digests(ends), NODE, "left").join(above, PARENT, "left")
    return met.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    )


TRIE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
hashed AS (SELECT conv_id, turns, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
  lambda x, d: list_reduce([xor(x, d), 1, 2, 3, 4, 5, 6, 7, 8], lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 4 AS h FROM c),
r AS (SELECT a.conv_id, list_concat(coalesce(b.turns[1 : a.h], []), a.turns[a.h + 1 :]) AS turns FROM hashed a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 20),
places AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
n AS (SELECT turns[1 : depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256 FROM places GROUP BY 1, 2),
k AS (SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
worth AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
  CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN k USING (path)),
up AS (SELECT path, n_children, saved, unnest(range(0, depth + 1)) AS d FROM worth),
totals AS (SELECT path[1 : d] AS path, (count(*) FILTER (n_children = 0))::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM worth w JOIN totals USING (path) LEFT JOIN n p ON w.depth > 0 AND p.path = w.path[1 : w.depth - 1]
"""
