import random

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rowlore.llm.components import components
from rowlore.llm.simhash import anchors, dealt_by_anchor, drop_near_copies, fingerprint, near_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(n=220):
    rng = random.Random(7)
    texts, bases = [None, "", "  \n", "one", "One", "two words", "ÄB äb"], []
    for _ in range(12):
        bases.append([rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(3, 400))])
    while len(texts) < n:
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
        texts.append(" ".join(words))
    return texts


def test_groups_equal_brute_force(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i * 3 + 1, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    ids = [i * 3 + 1 for i in range(len(texts))]
    prints = {i: brute_print(t) for i, t in zip(ids, texts)}
    pairs = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = union(pairs, ids)
    # With a low bound every anchor counts as crowded, so the block form must agree.
    for hot in (20_000, 1):
        got = near_groups(docs, hot).collect()
        assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in ids}
    assert len(set(want.values())) < len(ids) - 100
    kept = {r["doc_id"] for r in drop_near_copies(docs).collect()}
    assert kept == set(want.values())


def test_fingerprint_whole_text():
    text = "a b c " * 70_000
    assert fingerprint(text) == brute_print(text)


def test_every_close_pair_meets_at_a_home():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    other = base.copy()
    for _ in range(3):
        other ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    near = {(int(r), int(a)) for rows, anchor, _ in anchors(other) for r, a in zip(rows, anchor)}
    homes = [[(int(r), int(a)) for r, a in zip(rows, anchor)] for rows, anchor, home in anchors(base) if home]
    assert all(a in near or b in near for a, b in zip(*homes))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x y z", "en", "s", 1), (5, "x y z", None, None, None), (5, "x y z", "en", "s", 1)], DOCS)
    docs = docs.withColumn("fingerprint", F.lit("clash")).withColumn("component", F.lit(1)).withColumn("first", F.lit(2))
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in near_groups(docs).collect()) == [(0, 5), (5, 5), (5, 5)]
    assert drop_near_copies(docs).columns == docs.columns
    assert near_groups(docs.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(i, i + 7) for i in range(1000, 1700, 7)] + [(2000, i) for i in range(2001, 2300)]
    rng.shuffle(pairs)
    links = spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in pairs] + [(5, 5), (None, 3), (4, None)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(links.repartition(7)).collect()}
    want = union(pairs, {n for p in pairs for n in p})
    assert got == want
    assert components(links.limit(0)).count() == 0


def test_texts_decide_not_ids(spark):
    """A text that is near to nothing stays, whatever other texts its doc_id has."""
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "quite another text here"), (None, "a b c d e"), (3, None), (3, "A B C D E"), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("row", F.lit("clash"))
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [(0, "a b c d e"), (1, "a b c d e"), (2, "quite another text here"), (3, "")]


def test_a_crowded_anchor_is_split(spark):
    """100,000 fingerprints near to one anchor: no key holds more than a small share of them."""
    rng = np.random.default_rng(4)
    n, low = 100_000, np.uint64(0)
    first, second = (np.uint64(1) << rng.integers(0, 31, n).astype(np.uint64) for _ in range(2))
    prints = np.unique((low ^ first ^ second) | rng.integers(0, 1 << 31, n).astype(np.uint64) << np.uint64(32))
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    sizes = [r["n"] for r in dealt_by_anchor(frame, 2000).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(1).collect()]
    assert sizes[0] < 2000, sizes
