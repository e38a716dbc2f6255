import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from rowlore.llm.prefix_trie import TRIE_SQL, end_digests, prefix_trie, subtree_totals

SCHEMA = "conv_id long, turn long, role string, text string, depth long, words string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - int(np.fmod(conv, 20))
        turns = own.get(base, [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((conv, d == len(turns)))
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c, last in m if last)))
        parent = min(members[p[:-1]])[0] if p else None
        out.append((min(m)[0], len(p), parent, len(m), children[p], leaves[p], saved[p], sha256(ends.encode()).hexdigest()))
    return Counter(out)


def rows_of(seed, convs, turns):
    pick = random.Random(seed)
    texts = ["", "a b", " one\ttwo\nthree ", "ü", None, "same words here"]
    return [
        (c - 30, pick.choice([t, t, t, None, 0]), pick.choice(["user", "user", "user", None]), pick.choice(texts[: pick.randint(1, 6)]), 1, "x")
        for c in range(convs) if pick.random() < 0.9 for t in range(pick.randint(1, turns))
    ]


@pytest.mark.parametrize("seed, convs, turns", [(0, 120, 6), (1, 25, 30)])
def test_equals_brute_force(spark, seed, convs, turns):
    rows = rows_of(seed, convs, turns)
    rows += [(None, 1, "user", "no conversation", 0, ""), rows[0], rows[0], (10**15, 1, "user", "x " * 50000, 0, "")]
    # Many equal conversations, and one that is longer than all others together.
    rows += [(c, t, "user", f"turn {t}", 0, "") for c in range(1000, 1050) for t in range(3)] + [(2001, t, "a", str(t % 3), 0, "") for t in range(300)]
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_equals_sql(spark, sf):
    got = prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cur = db.execute(TRIE_SQL)
    assert [d[0] for d in cur.description] == got.columns
    want = Counter(cur.fetchall())
    assert want and Counter(tuple(r) for r in got.collect()) == want
    rows = rows_of(5, 90, 5)
    db.execute("drop view conversations")
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    assert Counter(db.execute(TRIE_SQL).fetchall()) == brute(rows)


def test_small_tables(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(5, 1, "user", "x", 0, "")], [(20, 1, "user", "a b", 0, ""), (21, 1, "user", "c", 0, ""), (39, None, None, None, 0, "")]):
        assert Counter(tuple(r) for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "random"])
def test_totals_of_any_shape(spark, shape):
    pick = random.Random(3)
    above = {"chain": lambda i: i - 1, "star": lambda i: 0, "comb": lambda i: max(0, i - 1 - i % 2), "random": lambda i: pick.randrange(i)}[shape]
    parent = [None] + [above(i) for i in range(1, 150)]
    rows = [(i, -i, p, None if p is None else -p, p is None, pick.randint(-5, 5), 1) for i, p in enumerate(parent)]
    want = [[r[5], 1] for r in rows]
    for i in range(len(rows) - 1, 0, -1):
        want[parent[i]] = [a + b for a, b in zip(want[parent[i]], want[i])]
    got = subtree_totals(spark.createDataFrame(rows, "n1 long, n2 long, p1 long, p2 long, root boolean, v long, size long"), ["v", "size"]).collect()
    assert len(got) == len(rows) and all([r["v"], r["size"]] == want[r["n1"]] for r in got)


def test_many_ends_of_one_node(spark):
    rows = [(1, 2, i) for i in range(40000)] + [(3, 4, -5), (3, 4, 7)]
    got = {(r["n1"], r["n2"]): r["ends_sha256"] for r in end_digests(spark.createDataFrame(rows, "n1 long, n2 long, conv_id long").repartition(9)).collect()}
    assert got == {(1, 2): sha256(",".join(map(str, range(40000))).encode()).hexdigest(), (3, 4): sha256(b"-5,7").hexdigest()}
