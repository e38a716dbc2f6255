import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from rowlore.llm.suffixes import ROW, _message, earlier_windows, front_code, front_decode, merge, without_earlier_passages, run_number

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NONE = (1 << 63) - 1


def brute(rows):
    """Per row (n_bytes, n_removed, n_spans, sha256 of what is kept)."""
    first = {}
    data = [((NONE if i is None else i), (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, NONE), i)
    out = []
    for i, b in data:
        gone = [False] * (len(b) + 1)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abeé") for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randrange(5, 60)) for _ in range(12)] + ["x" * 70, "ab" * 60, "abc" * 30, " " * 55]
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 51), (6, "z" * 49)]
    for i in range(7, 160):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            part = rng.choice(shared) if rng.random() < 0.6 else text(rng.randrange(1, 30))
            if rng.random() < 0.3:
                k = rng.randrange(len(part))
                part = part[:k] + rng.choice("abQ") + part[k + 1 :]
            if rng.random() < 0.3:
                part = part[rng.randrange(len(part)) :]
            parts.append(part)
        rows.append((i, rng.choice(["", " ", "\n"]).join(parts)))
    rows += [(200, rows[20][1]), (201, rows[20][1]), (202, rows[20][1]), (202, rows[20][1]), (None, rows[30][1]), (None, rows[30][1])]
    rows += [(203, text(40_000) + rows[25][1] + text(20)), (204, rows[40][1] + text(30_000)[:300_000])]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOCS)
    want = {k: r for k, r in enumerate(brute(rows))}
    assert sum(r[2] > 1 for r in want.values()) > 10
    # One run; many; and every shared anchor dealt by window.
    for runs, hot in ((1, 20_000), (9, 20_000), (5, 0)):
        got = without_earlier_passages(docs.repartition(6), 1 << 30, runs, hot).collect()
        assert {r["n_chars"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert {r["text"] for r in got if r["doc_id"] in (1, 2)} == {""}
    assert all(r["text"] == rows[r["n_chars"]][1] for r in got if not r["n_removed"] and r["text"])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "q" * 60, "en", "s", 1)], DOCS).withColumn("part", F.lit("clash")).withColumn("_run_", F.lit(1))
    row = without_earlier_passages(docs, least_runs=3).first()
    assert (row["part"], row["n_removed"], row["text"]) == ("clash", 0, "q" * 60)
    assert without_earlier_passages(docs.limit(0), least_runs=3).count() == 0


def test_loser_tree_and_front_codes():
    rng = random.Random(9)
    for count in (1, 2, 3, 7, 16):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randrange(0, 60))}) for _ in range(count)]
        coded = [front_code(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 12)) for r in runs]
        rows = front_decode(np.concatenate([c for c, _ in coded]), np.frombuffer(b"".join(t for _, t in coded), np.uint8), 12)
        assert [r.tobytes() for r in rows] == [k for r in runs for k in r]
        source, shared = merge(runs, [c.tolist() for c, _ in coded])
        at, out = [0] * count, []
        for s in source:
            out.append(runs[s][at[s]])
            at[s] += 1
        assert out == sorted(k for r in runs for k in r)
        for a, b, n in zip(out, out[1:], shared[1:]):
            assert n == next((i for i in range(12) if a[i] != b[i]), 12)


def test_windows_of_no_rows():
    assert len(earlier_windows(np.zeros((0, ROW), np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.int64))) == 0


def test_rows_without_id_or_with_one_id_spread_over_runs(spark):
    for doc_id in ("cast(null AS long)", "7L"):
        rows = spark.range(1000).selectExpr(f"{doc_id} AS doc_id", "cast(cast(id AS string) AS binary) AS text")
        assert rows.select(run_number(16)).distinct().count() == 16


def test_equal_rows_spread_over_runs(spark):
    rows = spark.range(1000).selectExpr("cast(null AS long) AS doc_id", "cast('' AS binary) AS text")
    sizes = [r["n"] for r in rows.groupBy(run_number(16).alias("r")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 150


def test_numbers_of_very_many_runs():
    """More runs than 32 bits hold in pairs: 300 GB and beyond."""
    runs = 70_000
    made = _message([(-1 - (runs - 1) * runs - 5, runs - 1, 1, b"x"), (1 << 33, 1 << 32, 2, b"")])
    assert made.column("part").to_pylist() == [-1 - (runs - 1) * runs - 5, 1 << 33] and (-1 - made.column("part")[0].as_py()) % runs == 5


def test_one_id_in_many_runs_is_not_smaller_than_itself(spark):
    same = "a passage of well over fifty bytes that two rows of one id have in common; "
    rows = [(i, same + str(k) * 9) for i in (7, None) for k in range(20)]
    got = without_earlier_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 40 and all((r["n_removed"] > 0) == (r["doc_id"] is None) for r in got)
