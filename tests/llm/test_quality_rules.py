import math
import random
import re
import struct
from collections import Counter

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rowlore.llm.quality_rules import BUCKETS, THRESHOLD, judge

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def grams(text):
    tokens = re.findall(r"[^\W\d_]+|\d+|(?:[^ \t\n\x0b\f\r\w]|_)+", text or "")
    hashed = [xxh64_intdigest(t.encode(), seed=42) for t in tokens]
    pairs = [xxh64_intdigest(struct.pack("<Q", b), seed=xxh64_intdigest(struct.pack("<Q", a), seed=42)) for a, b in zip(hashed, hashed[1:])]
    return [signed(h) % BUCKETS for h in hashed + pairs]


def brute(texts, trusted):
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    r, g = sum(raw.values()), sum(target.values())
    out = {}
    for i, t in texts.items():
        own = grams(t)
        ratio = sum(math.log((target[b] + 1) / (g + BUCKETS)) - math.log((raw[b] + 1) / (r + BUCKETS)) for b in own) / len(own) if own and g else 0.0
        c = counts(t)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        out[i] = (*c, failed, not failed and ratio >= THRESHOLD, round(ratio, 9))
    return out


def texts():
    rng = random.Random(5)
    words = "the of and to in is été über niño x1 a_b 42 end. Word, |".split()
    found = {1: None, 2: "", 3: " \t\n", 4: "one two", 5: "a b c d e f a b c d e", 6: "x\nx\n \n\ny\nx", 7: "a\x0bb\x0cc\rd\x1ce \x85f"}
    for i in range(10, 90):
        body = [rng.choice(words) + (rng.choice(["###", "%%", ""]) if i % 4 == 0 else "") for _ in range(rng.randrange(5, 200))]
        if i % 7 == 0:
            body += body[:20] + body[3:12]
        found[i] = "".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in body)
    found[200] = ("lorem ipsum dolor sit amet consectetur " * 4000) + "end"
    return found


def test_equals_brute_force(spark):
    own = texts()
    trusted = {i for i in own if i % 4 and i % 3}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in own.items()], DOCS)
    ids = spark.createDataFrame([(i,) for i in trusted] * 2 + [(None,), (99999,)], "doc_id long")
    got = judge(docs, ids)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = {r["doc_id"]: (*(r[n] for n in names), round(r["ratio"], 9)) for r in got.collect()}
    assert rows == brute(own, trusted)
    assert {n: t for n, t in got.dtypes if n in names[:5]} == dict.fromkeys(names[:5], "bigint")


def test_native_plan_without_shuffle_of_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = judge(docs, docs.select("doc_id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, long, None, None, None), (7, long, "en", "s", 1), (7, long, "en", "s", 1)], DOCS)
    docs = docs.withColumn("ratio", F.lit("clash")).withColumn("_t", F.lit(0)).withColumn("n_words", F.lit(0))
    none = spark.createDataFrame([], "doc_id long")
    assert [(r["kept"], r["ratio"]) for r in judge(docs, none).collect()] == [(True, 0.0)] * 3
    assert judge(docs.limit(0), none).count() == 0


def test_a_filter_on_the_verdict_stays_above_the_counts(spark, sf):
    """What is counted for every document is counted once, not again within a filter that was pushed down."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = judge(docs, docs.select("doc_id").limit(5)).filter("kept")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    whole = judge(docs, docs.select("doc_id").limit(5))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= whole.count("regexp_extract_all") and plan.count("split(") <= whole.count("split(")
    assert plan.index("Filter") < plan.index("monotonically_increasing_id")
