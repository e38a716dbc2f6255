"""Cosine relevance over ARRAY<FLOAT> columns, batch at a time through Arrow."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Relevances that agree to this many digits count as ties and are ordered by id.
TIE_DIGITS = 10


def as_matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow list array as a float64 matrix, and which rows are present."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    present = np.asarray(vectors.is_valid())
    kept = vectors.filter(pa.array(present))
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = flat.size // len(kept) if len(kept) else 0
    if len(kept) and (np.asarray(kept.value_lengths()) != width).any():
        raise ValueError("vectors of different widths")
    return flat.reshape(len(kept), width), present


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows become NaN."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / norm


def _spread(values: np.ndarray, present: np.ndarray) -> pa.Array:
    out = np.full(len(present), np.nan)
    out[present] = values
    return pa.array(out, mask=np.isnan(out))


def once(udf):
    """Keep the optimizer from copying a Python function into the filters it infers or pushes down."""
    return udf.asNondeterministic()


def relevance_to(question: Sequence[float]):
    """V3 against one fixed vector: (1 + cosine) / 2, null for missing or zero vectors."""
    q = np.asarray(question, dtype=np.float64)
    q = q / np.sqrt((q * q).sum())

    @F.arrow_udf(DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        m, present = as_matrix(vectors)
        return _spread((1 + (unit_rows(m) * q).sum(axis=1)) / 2 if m.size else np.empty(0), present)

    return once(score)


@F.arrow_udf(DoubleType())
def _pair_relevance(left: pa.Array, right: pa.Array) -> pa.Array:
    """V3 between two vector columns."""
    valid = np.asarray(left.is_valid()) & np.asarray(right.is_valid())
    keep = pa.array(valid)
    a, _ = as_matrix(left.filter(keep))
    b, _ = as_matrix(right.filter(keep))
    values = (1 + (unit_rows(a) * unit_rows(b)).sum(axis=1)) / 2 if a.size else np.empty(0)
    return _spread(values, valid)


pair_relevance = once(_pair_relevance)


def rank_key(score: Column) -> Column:
    return F.round(score, TIE_DIGITS)


def hashed_buckets(tokens: Column, width: int) -> Column:
    """Bucket of each token, from the first seven hex digits of its MD5."""
    return F.transform(
        tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int"), F.lit(width))
    )


def bag_vector(width: int):
    """Unit-length bucket counts; rows without a bucket give the zero vector."""

    @F.arrow_udf("array<float>")
    def vectorise(buckets: pa.Array) -> pa.Array:
        rows = len(buckets)
        lengths = np.asarray(buckets.value_lengths().fill_null(0))
        flat = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(rows), lengths)
        counts = np.bincount(row * width + flat, minlength=rows * width).reshape(rows, width).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0).astype(np.float32)
        offsets = pa.array(np.arange(rows + 1) * width, type=pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(unit.reshape(-1)))

    return once(vectorise)
