import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlore.llm.lines import LINES_SQL, NO_ID, Cuckoo, LineIndex, dedup_lines, digest, line_key

SCHEMA = "doc_id long, text string, row long, late long, version long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    key = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    return key if len(key) >= 10 else None


def brute(rows, held=None):
    """Rows of the result; `held` are the documents of the index, all rows unless given."""
    holders = {}
    for doc, text, *_ in rows if held is None else held:
        for line in (text or "").split("\n"):
            if key_of(line) is not None:
                holders.setdefault(key_of(line), set()).add(NO_ID if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        own = NO_ID if doc is None else doc
        kept = [x for x in lines if key_of(x) is None or own <= min(holders[key_of(x)])]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def rows_of(seed, first=0, n=60):
    pick = random.Random(seed)
    lines = ["short", "", "  \t", "A common LICENSE line", "a common license line ", "ÄÄÄÄÄÄÄÄÄÄ", "ääääääääää", "ÄÄÄÄÄÄÄÄÄ", "0123456789", "日本語のテキストの行です", "x\r", "long line " * 400]
    text = lambda: "\n".join(pick.choice(lines) if pick.random() < 0.5 else f"line {pick.randint(0, 60)} of text" for _ in range(pick.randint(0, 9)))
    return [(first + i, text(), 0, 1, 2) for i in range(n)]


ODD = [(None, "A common license line\nline 5 of text", 0, 0, 0), (None, "line 5 of text\nonly here without an id", 0, 0, 0), (None, "line 5 of text\nonly here without an id", 0, 0, 0),
       (3, "second row of three\nline 1 of text", 1, 1, 1), (3, "second row of three\nline 1 of text", 1, 1, 1), (-7, "line 5 of text", 1, 1, 1), (900, None, 1, 1, 1), (901, "", 1, 1, 1),
       (902, "the very same line\n" * 500, 1, 1, 1), (903, "the very same line", 1, 1, 1)]


def test_equals_brute_force(spark):
    rows = rows_of(1) + ODD
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equals_sql(spark, sf):
    got = dedup_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    got = got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = Counter(db.execute(LINES_SQL).fetchall())
    assert sum(n for _, _, n, _ in want) > 0 and Counter(tuple(r) for r in got.collect()) == want
    # The SQL treats odd rows as the operator does.
    rows = rows_of(2) + ODD
    db.execute("drop view documents")
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    want = Counter((d, hashlib.sha256(t.encode()).hexdigest(), n, m) for (d, t, n, m), c in brute(rows).items() for _ in range(c))
    assert Counter((d, k, n, m) for d, n, m, k in db.execute(LINES_SQL).fetchall()) == want


def test_insertions_and_deletions(spark, tmp_path):
    index = LineIndex(spark, str(tmp_path / "lines"))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rows = {seed: rows_of(seed, first=100 * seed, n=25) for seed in (1, 2, 3)}
    held = []

    def agrees():
        now = LineIndex(spark, str(tmp_path / "lines"))
        assert Counter(tuple(r) for r in now.without_repeats(frame(held)).collect()) == brute(held)
        want = Counter(k for k, _ in {(key_of(x), r[0]) for r in held for x in (r[1] or "").split("\n")} if k is not None)
        exact = {(r["k1"], r["k2"]): r["n_docs"] for r in now.counts.collect()}
        assert exact == {tuple(np.frombuffer(digest(k.encode()), np.int64).tolist()): n for k, n in want.items()}
        assert now.keys == len(want)
        # Filters hold a key once, or twice if it is repeated; sharing a mark can only add to that.
        copies = {(r["k1"], r["k2"]): r["copies"] for r in now.probe(now.counts).collect()}
        assert copies.keys() == exact.keys() and all(copies[k] >= min(n, 2) for k, n in exact.items())
        slots = now.filters.collect()
        assert sum(int((np.frombuffer(r["slots"], np.uint16) > 0).sum()) + len(r["stash"]) // 8 for r in slots) == sum(min(n, 2) for n in exact.values())

    for seed in (2, 1, 3):  # smaller ids may come later
        index.insert(frame(rows[seed]))
        held += rows[seed]
        agrees()
    index.insert(frame(rows[1]))  # a repeated batch changes nothing
    agrees()
    # A batch that failed before its commit leaves files, but no trace in the index.
    spark.createDataFrame([(1, 1, 1)], "k1 long, k2 long, n long").write.parquet(str(tmp_path / "lines" / "counts" / f"version={index.version + 1}"))
    agrees()
    gone = {r[0] for r in rows[1][::2] + rows[3]}
    index.delete(spark.createDataFrame([(i,) for i in gone | {12345}], "doc_id long"))
    held = [r for r in held if r[0] not in gone]
    agrees()
    index.insert(frame(rows[3]))  # and back again
    held += rows[3]
    agrees()
    index.delete(frame(held))
    held = []
    assert index.counts.count() == 0 and index.keys == 0 and index.without_repeats(frame(held)).count() == 0


def test_shards_are_made_anew(spark, tmp_path):
    index = LineIndex(spark, str(tmp_path / "lines"))
    frame = lambda a, b: spark.range(a, b).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line of its own "), (F.col("id") % 9000).cast("string")).alias("text"))
    index.insert(frame(0, 50))
    few = index.buckets
    index.insert(frame(50, 12000))
    assert index.buckets > few and index.keys == 9000
    assert index.without_repeats(frame(0, 12000)).filter("n_dropped = 1").count() == 3000


@pytest.mark.parametrize("buckets, keys, seed", [(16, 40, 0), (64, 300, 1), (1024, 3900, 2), (1, 3, 3)])
def test_cuckoo(buckets, keys, seed):
    pick = np.random.default_rng(seed)
    own = pick.integers(-(1 << 62), 1 << 62, keys)
    filter_, held = Cuckoo(np.zeros((buckets, 4), np.uint16), np.zeros(0, np.int64)), Counter()
    for _ in range(12):
        more = pick.choice(own, keys // 2)
        filter_.add(more)
        held.update(more.tolist())
        less = np.array([k for k, n in held.items() for _ in range(int(pick.integers(0, n + 1)))], np.int64)
        filter_.remove(less)
        held.subtract(less.tolist())
        assert all(filter_.count(np.array([k]))[0] >= n for k, n in held.items())
        assert int((filter_.slots > 0).sum()) + len(filter_.stash) == sum(held.values())
    filter_.remove(np.array([k for k, n in held.items() for _ in range(n)], np.int64))
    assert not filter_.slots.any() and not len(filter_.stash)
    with pytest.raises(ValueError):
        filter_.remove(own[:1])


def test_key():
    assert line_key("  ABC défgh I\t\r".encode()) == "abc défgh i".encode() and line_key("ééééééééé".encode()) is None
    assert line_key(b"123456789") is None and line_key(b"\x0b1234567890 ") == b"1234567890" and line_key(" ".encode() * 10) is not None
