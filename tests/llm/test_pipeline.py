import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_quality_rules import brute as brute_rules
from test_simhash import brute_print, union
from test_suffixes import brute as brute_passages
from tokenizers import Tokenizer

import corpus_pipeline
from rowlore.llm.common import DOCUMENT_COLUMNS
from rowlore.llm.secret_scan import redact


def test_stages_equal_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in table.collect()}
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    docs = table.withColumn("kept", F.lit("clash")).withColumn("fingerprint", F.lit(1))
    found = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert tuple(docs.columns) == DOCUMENT_COLUMNS
        docs = spark.createDataFrame(docs.collect(), table.schema)
        found[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = brute_rules(rows, trusted)
    want = {i: t for i, t in rows.items() if judged[i][6]}
    assert found["quality_rules"] == want and len(want) > 100
    prints = {i: brute_print(t) for i, t in want.items()}
    near = union([(a, b) for a in want for b in want if a < b and (prints[a] ^ prints[b]).bit_count() <= 3], want)
    want = {i: t for i, t in want.items() if near[i] == i}
    assert found["simhash_near_dedup"] == want
    order = list(want.items())
    sizes = {i: n - gone for (i, _), (n, gone, _, _) in zip(order, brute_passages(order))}
    assert {i: len(t.encode()) for i, t in found["suffix_array_dedup"].items()} == sizes
    want = {i: redact(t) for i, t in found["suffix_array_dedup"].items()}
    assert found["secret_scan"] == want
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(want)
    for r in packed:
        ids = np.array([*model.encode(want[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_stages_on_odd_rows(spark, sf):
    long = " ".join(f"word{i}" for i in range(40))
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(None, long, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1)], schema)
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    # Of equal texts the row without id stays, cut empty as others have its passages; so do both rows of one id.
    assert sorted((r["doc_id"] or 0, r["length"]) for r in now.collect())[0] == (0, 1)
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    assert now.count() == 0
