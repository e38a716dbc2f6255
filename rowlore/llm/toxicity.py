"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlore.llm.common import TRAIN_BYTES, bounded, held_out
from rowlore.llm.features import Bytes, chunks, mixed

# Bounds of the training set: confirmed toxic rows, and rows of unknown kind.
POSITIVES = 3_000
UNLABELLED = 12_000
BUCKET_BITS = 18
PREFIXES = (4, 5)
# A bucket counts if confirmed texts have it more often than others by this log-ratio.
LIFT = 1.0
STEPS = 300
RATE = 0.5
SHRINK = 1e-4
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def presence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the words of each text, A-Z in lower case, and of their first bytes; with repeats."""
    text = Bytes(texts, lower=True)
    start, stop = text.bare_words()
    found = [text.hashes(start, stop)]
    found += [text.hashes(start, np.minimum(stop, start + n)) + np.uint64(n) for n in PREFIXES]
    bucket = mixed(np.concatenate(found)) & np.uint64((1 << BUCKET_BITS) - 1)
    return np.tile(text.doc[start], len(found)), bucket.astype(np.int64)


@dataclass
class ToxicModel:
    """weights: of each bucket, mostly zero; bias: of every text."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for first, last in chunks(texts):
            own, bucket = presence(texts[first:last])
            some = self.weights[bucket] != 0
            pairs = np.unique(own[some] << BUCKET_BITS | bucket[some])
            out[first:last] += np.bincount(pairs >> BUCKET_BITS, self.weights[pairs & (1 << BUCKET_BITS) - 1], last - first)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> ToxicModel:
    """A logistic model that minimises the non-negative positive-unlabelled risk.

    With class prior p the risk is p E+[l(+)] + max(0, Eu[l(-)] - p E+[l(-)]): texts
    of unknown kind stand for the negative ones once the positive part is taken
    off. Where that difference falls below zero the step goes the other way, so
    the model doesn't fit away the positive texts among the unknown ones. Each
    argument lists the distinct buckets of a text.
    """
    size = 1 << BUCKET_BITS
    n_p, n_u = len(positive), len(unlabelled)
    own = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (positive, unlabelled)]
    bucket = [np.concatenate([np.zeros(0, np.int64), *side]) for side in (positive, unlabelled)]
    in_p, in_u = (np.bincount(b, minlength=size) for b in bucket)
    lift = np.log((in_p + 0.5) / (n_p + 1)) - np.log((in_u + 0.5) / (n_u + 1))
    chosen = np.flatnonzero((in_p >= max(2, n_p // 400)) & (lift >= LIFT))
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    bucket = [place[b] for b in bucket]
    (dp, bp), (du, bu) = ((o[b >= 0], b[b >= 0]) for o, b in zip(own, bucket))
    w, bias, norm, bias_norm = np.zeros(len(chosen)), 0.0, np.full(len(chosen), 1e-8), 1e-8
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for _ in range(STEPS):
        sp, su = np.bincount(dp, w[bp], n_p) + bias, np.bincount(du, w[bu], n_u) + bias
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        part_p, part_u = -prior * sigmoid(sp) / n_p, sigmoid(su) / n_u
        gp, gu = (part_p - prior * (1 - sigmoid(sp)) / n_p, part_u) if negative >= 0 else (-part_p, -part_u)
        slope = np.bincount(bp, gp[dp], len(chosen)) + np.bincount(bu, gu[du], len(chosen)) + SHRINK * w
        norm += slope * slope
        w -= RATE * slope / np.sqrt(norm)
        slope = gp.sum() + gu.sum()
        bias_norm += slope * slope
        bias -= RATE * slope / np.sqrt(bias_norm)
    weights = np.zeros(size)
    weights[chosen] = w
    return ToxicModel(weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, text_bytes: int = TRAIN_BYTES) -> ToxicModel | None:
    """A model of `labels.toxic`, or None without a confirmed toxic text.

    Labels count only outside the held-out fold. The class prior is the share of
    toxic ones among them, over all rows. Texts: at most `positives` confirmed
    and `unlabelled` of any kind, those with the least hashes of their ids,
    and at most `text_bytes` in that order, so training is as large at any input size; one task holds their
    buckets. Of an id with several rows one counts.
    """
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    row = known.agg(F.avg("toxic").alias("p")).first()
    if not row["p"]:
        return None
    some = lambda ids, n: ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = some(known.filter("toxic = 1"), positives).select("doc_id", F.lit(1).alias("kind"))
    # At most positives + unlabelled ids: a broadcast of fixed size.
    chosen = chosen.union(some(docs.filter(~held_out()), unlabelled).select("doc_id", F.lit(0).alias("kind")))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    texts = bounded(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "kind", "text"), "kind", text_bytes)
    prior = float(row["p"])

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            for first, last in chunks(rows):
                own, bucket = presence(rows[first:last])
                pairs = np.unique(own << BUCKET_BITS | bucket)
                sizes = np.bincount(pairs >> BUCKET_BITS, minlength=last - first)
                bounds = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                lists = pa.ListArray.from_arrays(bounds, pa.array((pairs & (1 << BUCKET_BITS) - 1).astype(np.int32)))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["doc_id", "kind", "buckets"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            for kind, doc_id, buckets in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2)):
                sides[kind].append((doc_id, np.asarray(buckets.values)))
        if not sides[1]:
            return
        # Sums of floats depend on their order; ids fix it.
        unknown, confirmed = ([b for _, b in sorted(s, key=lambda x: (x[0], x[1].tobytes()))] for s in sides)
        model = train(confirmed, unknown, prior)
        at = np.flatnonzero(model.weights)
        columns = [pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([model.weights[at].tolist()], pa.list_(pa.float64())), pa.array([model.bias])]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "weight", "bias"])

    rows = texts.mapInArrow(featurise, "doc_id long, kind int, buckets array<int>").repartition(1)
    found = rows.mapInArrow(learn, "bucket array<int>, weight array<double>, bias double").collect()
    if not found:
        return None
    weights = np.zeros(1 << BUCKET_BITS)
    weights[found[0]["bucket"]] = found[0]["weight"]
    return ToxicModel(weights, found[0]["bias"])


def score(docs: DataFrame, model: ToxicModel | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null text is empty; an empty text has the score of the bias alone. Without
    a model every score is 0. Rows with equal or null doc_id are kept.
    """
    # Arrays only: a broadcast is unpickled where the package may not be installed.
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.weights, model.bias))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicModel(*shared.value) if shared.value else None
        for batch in (part.slice(i, 1024) for part in batches for i in range(0, part.num_rows, 1024)):
            texts = batch.column(2).to_pylist()
            found = own.scores(texts) if own else np.zeros(len(texts))
            columns = [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text).mapInArrow(apply, SCORED)
