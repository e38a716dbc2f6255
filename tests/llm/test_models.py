import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlore.llm import quality_model, toxicity
from rowlore.llm.common import bounded, held_out
from rowlore.llm.features import _BYTES, BASE, Bytes, chunks

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("module, label, good", [(quality_model, "quality", 0.97), (toxicity, "toxic", 0.95)])
def test_held_out_rows(spark, module, label, good):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = module.score(docs, module.fit(docs, labels)).join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows["doc_id"], rows["held_out"]))
    rows = rows[rows["held_out"]]
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) >= good
    assert ((rows["predicted"] == 1) == (rows[label] == 1)).mean() >= 0.95
    assert rows["score"].between(0, 1).all()


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_held_out_labels_change_nothing(spark, sf, module):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumns({c: F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    a, b = (sorted(tuple(r) for r in module.score(docs, module.fit(docs, x)).collect()) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("module, label, without", [(quality_model, "quality", 1.0), (toxicity, "toxic", 0.0)])
def test_odd_rows(spark, sf, module, label, without):
    docs = spark.createDataFrame([(None, "x y", None, None, None), (1, None, None, None, None), (1, "", "en", "s", 1), (2, "bad words here " * 30_000, "en", "s", 1)], DOCS)
    docs = docs.withColumn("score", F.lit("clash")).withColumn("kind", F.lit(1)).withColumn("bucket", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = module.score(docs, module.fit(docs, none)).collect()
    assert len(rows) == 4 and {r["score"] for r in rows} == {without}
    known = spark.createDataFrame([(2, 1, 1), (2, 1, 1), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = module.score(docs, module.fit(docs, known)).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert module.score(docs.limit(0), module.fit(docs.limit(0), known)).count() == 0


def test_non_negative_risk_separates_unlabelled_text():
    rng = np.random.default_rng(1)
    noise = lambda: rng.integers(100, 5000, 40)
    toxic = lambda: np.unique(np.r_[noise(), rng.integers(0, 8, 3)])
    unlabelled = [toxic() if rng.random() < 0.1 else np.unique(noise()) for _ in range(2000)]
    model = toxicity.train([toxic() for _ in range(200)], unlabelled, 0.1)
    value = lambda x: model.weights[x].sum() + model.bias
    assert np.mean([value(toxic()) > 0 for _ in range(300)]) > 0.95
    assert np.mean([value(np.unique(noise())) > 0 for _ in range(300)]) < 0.03


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    model = quality_model.QualityModel(rng.normal(size=(1 << 16, 8)), rng.normal(size=(8, 2)), rng.normal(size=2))
    texts = [b"", b" ", b"a", "é ü".encode(), b"one two two", b"x " * 200_000, b"tail"]
    whole = model.scores(texts)
    assert np.allclose(whole, [model.scores([t])[0] for t in texts]) and np.isfinite(whole).all()


def test_words_and_chunks():
    text = Bytes([b"Ab, c", b"", b"--", b"x"], lower=True)
    start, stop = text.bare_words()
    assert [bytes(text.buf[a:b]) for a, b in zip(start, stop)] == [b"ab", b"c", b"x"]
    assert chunks([b"a" * 5, b"b" * 50, b"c"], 10) == [(0, 1), (1, 2), (2, 3)]
    assert len(set(text.hashes(start, stop).tolist())) == 3


WORD = 1 << 64


def mixed_plain(x):
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 % WORD
    x = (x ^ x >> 29) * 0x94D049BB133111EB % WORD
    return x ^ x >> 32


def hash_plain(data):
    return mixed_plain(sum(int(_BYTES[b]) * pow(BASE, k, WORD) for k, b in enumerate(data)) % WORD)


def quality_features_plain(text):
    """{bucket: share} of one text."""
    words = text.split()
    hashes = [hash_plain(w) for w in words]
    parts = [hashes + [1 for a, b in zip(hashes, hashes[1:]) if a == b]]
    spaced = text + b" "
    parts += [[(hash_plain(spaced[i : i + n]) + n) % WORD for i in range(len(spaced) - n + 1)] for n in quality_model.GRAMS]
    out = {}
    for part in parts:
        for value in part:
            bucket = mixed_plain(value) % (1 << quality_model.BUCKET_BITS)
            out[bucket] = out.get(bucket, 0) + 1 / (len(parts) * len(part))
    return out


TEXTS = [b"", b"a", b"one two two two", "é ü  tail\n".encode(), b"xx yy xx yy zz", b"good words here", b"bad bad words"]


def test_quality_features_and_scores_equal_plain_python():
    rng = np.random.default_rng(8)
    model = quality_model.QualityModel(rng.normal(size=(1 << quality_model.BUCKET_BITS, 8)), rng.normal(size=(8, 2)), rng.normal(size=2))
    own, bucket, share = quality_model.features(TEXTS)
    for i, text in enumerate(TEXTS):
        want, got = quality_features_plain(text), {}
        for b, s in zip(bucket[own == i].tolist(), share[own == i].tolist()):
            got[b] = got.get(b, 0) + s
        assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-12 for b in want)
        mean = [sum(s * model.vectors[b, c] for b, s in want.items()) for c in range(8)]
        logits = [sum(m * model.out[c, k] for c, m in enumerate(mean)) + model.bias[k] for k in (0, 1)]
        chance = np.exp(logits[1]) / (np.exp(logits[0]) + np.exp(logits[1]))
        assert abs(model.scores([text])[0] - chance) < 1e-9


def test_quality_training_equals_plain_python():
    rows = [(np.array(list(f), np.int64), np.array(list(f.values()))) for f in map(quality_features_plain, TEXTS[1:])]
    classes = np.array([1, 0, 1, 0, 1, 0])
    got = quality_model.train(rows, classes, seed=3)
    rng = np.random.default_rng(3)
    vectors = {b: v for b, v in enumerate(rng.normal(0, 0.1, (1 << quality_model.BUCKET_BITS, 8)).tolist())}
    out, bias = rng.normal(0, 0.1, (8, 2)).tolist(), [0.0, 0.0]
    norm_v, norm_o, norm_b = {}, [[1e-8] * 2 for _ in range(8)], [1e-8] * 2
    for _ in range(quality_model.EPOCHS):
        rng.permutation(len(rows))  # one batch: the order only changes the order of sums
        slope_v, slope_o, slope_b = {}, [[0.0] * 2 for _ in range(8)], [0.0] * 2
        for (buckets, shares), label in zip(rows, classes.tolist()):
            mean = [sum(s * vectors[b][c] for b, s in zip(buckets.tolist(), shares.tolist())) for c in range(8)]
            logit = [sum(mean[c] * out[c][k] for c in range(8)) + bias[k] for k in (0, 1)]
            total = sum(np.exp(x) for x in logit)
            off = [(float(np.exp(logit[k]) / total) - (k == label)) / len(rows) for k in (0, 1)]
            for k in (0, 1):
                slope_b[k] += off[k]
                for c in range(8):
                    slope_o[c][k] += mean[c] * off[k]
            for b, s in zip(buckets.tolist(), shares.tolist()):
                now = slope_v.setdefault(b, [0.0] * 8)
                for c in range(8):
                    now[c] += s * sum(out[c][k] * off[k] for k in (0, 1))
        for k in (0, 1):
            norm_b[k] += slope_b[k] ** 2
            bias[k] -= quality_model.RATE * slope_b[k] / norm_b[k] ** 0.5
            for c in range(8):
                norm_o[c][k] += slope_o[c][k] ** 2
                out[c][k] -= quality_model.RATE * slope_o[c][k] / norm_o[c][k] ** 0.5
        for b, slope in slope_v.items():
            norm = norm_v.setdefault(b, [1e-8] * 8)
            for c in range(8):
                norm[c] += slope[c] ** 2
                vectors[b][c] -= quality_model.RATE * slope[c] / norm[c] ** 0.5
    assert np.allclose(got.out, out, atol=1e-6) and np.allclose(got.bias, bias, atol=1e-6)
    assert all(np.allclose(got.vectors[b], vectors[b], atol=1e-6) for b in norm_v)


def toxic_features_plain(text):
    words = [w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in text.lower().split()]
    values = [v for w in words if w for v in (hash_plain(w), hash_plain(w[:4]) + 4, hash_plain(w[:5]) + 5)]
    return sorted({mixed_plain(v % WORD) % (1 << toxicity.BUCKET_BITS) for v in values})


def test_toxicity_equals_plain_python():
    texts = [b"", b"--", b"Some, WORDS here!", "é (x) longword".encode(), b"bad words", b"bad thing", b"a nice thing", b"nice words", b"bad bad bad"]
    own, bucket = toxicity.presence(texts)
    plain = [toxic_features_plain(t) for t in texts]
    assert [sorted(set(bucket[own == i].tolist())) for i in range(len(texts))] == plain
    positive, unlabelled, prior = [plain[4], plain[5], plain[8]], [plain[i] for i in (2, 3, 4, 6, 7)], 0.3
    got = toxicity.train([np.array(p) for p in positive], [np.array(u, np.int64) for u in unlabelled], prior)
    count = lambda side, b: sum(b in x for x in side)
    chosen = [
        b for b in sorted({b for p in positive for b in p}) if count(positive, b) >= 2
        and np.log((count(positive, b) + 0.5) / 4) - np.log((count(unlabelled, b) + 0.5) / 6) >= toxicity.LIFT
    ]
    assert chosen
    w, norm, bias, bias_norm = dict.fromkeys(chosen, 0.0), dict.fromkeys(chosen, 1e-8), 0.0, 1e-8
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for _ in range(toxicity.STEPS):
        sp, su = ([sum(w.get(b, 0) for b in x) + bias for x in side] for side in (positive, unlabelled))
        negative = np.mean([np.log1p(np.exp(s)) for s in su]) - prior * np.mean([np.log1p(np.exp(s)) for s in sp])
        if negative >= 0:
            gp, gu = [-prior / 3 for _ in sp], [sigmoid(s) / 5 for s in su]
        else:
            gp, gu = [prior * sigmoid(s) / 3 for s in sp], [-sigmoid(s) / 5 for s in su]
        slopes = {b: sum(g for g, x in [*zip(gp, positive), *zip(gu, unlabelled)] if b in x) + toxicity.SHRINK * w[b] for b in chosen}
        for b, s in slopes.items():
            norm[b] += s * s
            w[b] -= toxicity.RATE * s / norm[b] ** 0.5
        total = sum(gp) + sum(gu)
        bias_norm += total * total
        bias -= toxicity.RATE * total / bias_norm ** 0.5
    assert abs(got.bias - bias) < 1e-6 and np.flatnonzero(got.weights).tolist() == chosen
    assert all(abs(got.weights[b] - w[b]) < 1e-6 for b in chosen)
    logits = [sum(w.get(b, 0) for b in p) + bias for p in plain]
    assert np.allclose(got.scores(texts), [sigmoid(x) for x in logits], atol=1e-6)


def test_learnt_texts_are_bounded(spark):
    """One text an id, however many rows it has, and no more bytes than the bound."""
    rows = [(1, 1, b"x" * 10)] * 500 + [(i, 0, b"y" * 10) for i in range(2, 60)] + [(60, 1, b"z" * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, kind int, text binary").repartition(5)
    assert bounded(frame, "kind", 1 << 20).count() == 60
    some = bounded(frame, "kind", 300).collect()
    assert 0 < len(some) <= 30 and sum(len(r["text"]) for r in some) <= 300
