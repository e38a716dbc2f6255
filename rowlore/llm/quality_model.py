"""A quality classifier over learned vectors of hashed words and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlore.llm.common import TRAIN_BYTES, bounded, held_out
from rowlore.llm.features import Bytes, chunks, mixed

# Bound of the training set.
ROWS = 4_000
BUCKET_BITS = 16
GRAMS = (3, 5)
WIDTH = 8
EPOCHS = 4
BATCH = 32
RATE = 0.1
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, share) of every word, word said twice in a row, and run of bytes of each length.

    Words and each length of runs have equal parts in a text; within a part all
    of its features have equal shares.
    """
    text = Bytes(texts)
    start, stop = text.words()
    words = text.hashes(start, stop)
    twice = np.flatnonzero((words[1:] == words[:-1]) & (text.doc[start[1:]] == text.doc[start[:-1]]))
    parts = [(np.concatenate([text.doc[start], text.doc[start[twice]]]), np.concatenate([words, np.full(len(twice), 1, np.uint64)]))]
    for n in GRAMS:
        doc, value = text.grams(n)
        parts.append((doc, value + np.uint64(n)))
    own, found = (np.concatenate(c) for c in zip(*parts))
    share = np.concatenate([1 / (len(parts) * np.bincount(doc, minlength=len(texts))[doc]) for doc, _ in parts])
    bucket = mixed(found) & np.uint64((1 << BUCKET_BITS) - 1)
    return own, bucket.astype(np.int64), share


@dataclass
class QualityModel:
    """vectors: of each bucket; softmax of `mean vector @ out + bias` gives the classes' shares."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The share of class 1. It depends on one number a bucket: the mean and the product may change places."""
        worth = self.vectors @ (self.out[:, 1] - self.out[:, 0])
        base = self.bias[1] - self.bias[0]
        logit = np.full(len(texts), float(base))
        for first, last in chunks(texts):
            own, bucket, share = features(texts[first:last])
            logit[first:last] += np.bincount(own, worth[bucket] * share, last - first)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent on the cross-entropy, with steps scaled by past slopes.

    rows: of each text the distinct buckets and their shares of all its features.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    vectors = rng.normal(0, 0.1, (size, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, 2)), np.zeros(2)
    norms = [np.full(p.shape, 1e-8) for p in (vectors, out, bias)]

    def step(p: np.ndarray, norm: np.ndarray, slope: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
        norm[at] += slope * slope
        p[at] -= RATE * slope / np.sqrt(norm[at])

    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            own = np.repeat(np.arange(len(some)), [len(rows[k][0]) for k in some])
            bucket = np.concatenate([rows[k][0] for k in some])
            share = np.concatenate([rows[k][1] for k in some])
            at, place = np.unique(bucket, return_inverse=True)
            now = vectors[bucket] * share[:, None]
            mean = np.stack([np.bincount(own, now[:, c], len(some)) for c in range(WIDTH)], axis=1)
            logits = mean @ out + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(some)), classes[some]] -= 1
            chance /= len(some)
            back = (chance @ out.T)[own] * share[:, None]
            slope = np.stack([np.bincount(place, back[:, c], len(at)) for c in range(WIDTH)], axis=1)
            step(out, norms[1], mean.T @ chance)
            step(bias, norms[2], chance.sum(axis=0))
            step(vectors, norms[0], slope, at)
    return QualityModel(vectors, out, bias)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, text_bytes: int = TRAIN_BYTES) -> QualityModel | None:
    """A model of `labels.quality`, or None without a label outside the held-out fold.

    It learns from at most `rows` labelled texts, those with the least hashes of
    their ids, and at most `text_bytes` of them in that order, so training is as large at any input size; one task holds their
    distinct buckets. Whole texts count; of an id with several rows one does.
    """
    known = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # At most `rows` ids: a broadcast of fixed size.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    texts = bounded(texts.join(F.broadcast(known), "doc_id").select("doc_id", F.col("quality").cast("int"), "text"), "quality", text_bytes)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            for first, last in chunks(rows):
                own, bucket, each = features(rows[first:last])
                pairs, place = np.unique(own << BUCKET_BITS | bucket, return_inverse=True)
                doc, share = pairs >> BUCKET_BITS, np.bincount(place, each)
                bounds = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=last - first))].astype(np.int32))
                buckets = pa.ListArray.from_arrays(bounds, pa.array((pairs & (1 << BUCKET_BITS) - 1).astype(np.int32)))
                shares = pa.ListArray.from_arrays(bounds, pa.array(share.astype(np.float32)))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), buckets, shares], names=["doc_id", "quality", "bucket", "share"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for doc_id, quality, bucket, share in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                found.append((doc_id, quality, np.asarray(bucket.values), np.asarray(share.values)))
        if not found:
            return
        # Steps depend on the order of rows; ids fix it.
        found.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        model = train([r[2:] for r in found], np.array([int(r[1] == 1) for r in found]))
        columns = [pa.array([p.astype("<f8").tobytes()], pa.binary()) for p in (model.vectors, model.out, model.bias)]
        yield pa.RecordBatch.from_arrays(columns, names=["vectors", "out", "bias"])

    kinds = "doc_id long, quality int, bucket array<int>, share array<float>"
    got = texts.mapInArrow(featurise, kinds).repartition(1).mapInArrow(learn, "vectors binary, out binary, bias binary").collect()
    if not got:
        return None
    vectors, out, bias = (np.frombuffer(got[0][c], "<f8") for c in ("vectors", "out", "bias"))
    return QualityModel(vectors.reshape(-1, WIDTH), out.reshape(WIDTH, 2), bias)


def score(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null text is empty; a text without features has the score of the bias
    alone. Without a model every score is 1, as nothing speaks against a text.
    Rows with equal or null doc_id are kept.
    """
    # Arrays only: a broadcast is unpickled where the package may not be installed.
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.vectors, model.out, model.bias))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*shared.value) if shared.value else None
        for batch in (part.slice(i, 1024) for part in batches for i in range(0, part.num_rows, 1024)):
            texts = batch.column(2).to_pylist()
            found = own.scores(texts) if own else np.ones(len(texts))
            columns = [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text).mapInArrow(apply, SCORED)
