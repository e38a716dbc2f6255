import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowlore.llm.packing import CHUNK, IdTable, OpenBins, best_fit, pack_documents

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "the", "<|endoftext|>", "日本", "😀", "　", "\x00", " ", "'s", "'ll", "12", "\r\n", "\x85", "\xa0", "\x1c", "!!", "."]


def test_chunks_keep_the_library_ids():
    rng, table = random.Random(3), IdTable(None)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(16)))
        want = np.array(MODEL.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert b"".join(table[c] for c in CHUNK.findall(text)) == want, repr(text)


def one_by_one(counts, capacity):
    bins = []
    for length in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        fits = [b for b in bins if b >= length]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - length)
        else:
            bins.append(capacity - length)
    return Counter(bins)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_best_fit_by_counts_is_best_fit_one_by_one(counts):
    used, seen = Counter(), Counter()
    plan = best_fit(counts, 40)
    for i, (length, first, each, bin_id, offset) in enumerate(plan):
        later = [r for r in plan[i + 1 :] if r[0] == length]
        last = later[0][1] if later else counts[length]
        for rank in range(first, last):
            k, place = divmod(rank - first, each)
            assert offset + place * length == used[bin_id + k]
            used[bin_id + k] += length
            seen[length] += 1
    assert seen == Counter(counts)
    assert Counter(40 - u for u in used.values()) == one_by_one(counts, 40)


def test_tightest_bin():
    bins = OpenBins(100)
    for room in (7, 30, 99):
        bins.add(room, 0, 1)
    assert [bins.tightest(n) for n in (1, 7, 8, 30, 31, 99, 100)] == [7, 7, 30, 30, 99, 99, None]


def test_pieces_and_places(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "same text"] + ["same text"] * 40 + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(300))) for _ in range(60)]
    texts.append("".join(rng.choice(PARTS) for _ in range(90_000)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).withColumn("length", docs_clash())
    rows = pack_documents(docs.repartition(5)).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = np.array([*MODEL.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024
    assert len(at) == sum(one_by_one(Counter(r["length"] for r in rows), 1024).values())


def docs_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x", None, None, None), (3, "x", None, None, None), (3, "x", None, None, None)], DOCS)
    rows = pack_documents(docs).collect()
    assert len(rows) == 3 and sorted(r["offset"] for r in rows) == [0, 2, 4]
    assert pack_documents(docs.limit(0)).count() == 0


def test_equal_pieces_without_an_id_are_spread(spark):
    """All rows empty and without an id: ranks come from many windows, and every piece has a place of its own."""
    docs = spark.range(20_000).selectExpr("cast(null AS long) AS doc_id", "cast(null AS string) AS text")
    rows = pack_documents(docs)
    places = rows.groupBy("sequence_id").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("d"), F.max("offset").alias("m")).collect()
    assert sum(r["n"] for r in places) == 20_000 and all(r["n"] == r["d"] == r["m"] + 1 for r in places) and len(places) == -(-20_000 // 1024)
    plan = rows._jdf.queryExecution().toString()
    assert "xxhash64(_at" in plan


def test_table_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr("rowlore.llm.packing.TABLE_BYTES", 20_000)
    table = IdTable(None)
    for i in range(300):
        chunk = f" w{i}" if i % 3 else "\u4e2d\u6587" * (40 + i)
        assert np.frombuffer(table[chunk], "<u4").tolist() == MODEL.encode(chunk, add_special_tokens=False).ids
        assert table.held < 21_000 and all(len(c) <= 64 for c in table)
