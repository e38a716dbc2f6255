"""Helpers shared by the operators: inputs, chunk tables, labelled rows."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlore.plans.sizing import materialize

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Fold of a labelled row: crc32 of the decimal id, modulo this; fold 0 is held out.
FOLDS = 5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows whose label no model may learn from (a null id is held out, too)."""
    fold = F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS
    return F.coalesce(fold == 0, F.lit(True))


def drop_old_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of plans that nothing refers to any more: what they led to is written.

    It does so when the driver's garbage is collected, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Bound of the texts that a model learns from, in all.
TRAIN_BYTES = 128 << 20


def bounded(texts: DataFrame, kind: str, most: int) -> DataFrame:
    """`(doc_id, kind, text)` with one text an id and kind, and at most `most` bytes: ids by hash, until they are full.

    `texts` are those of a bounded number of ids, however many rows an id has.
    """
    one = texts.groupBy("doc_id", kind).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))
    one = materialize(one, "learnt")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id", kind).rowsBetween(Window.unboundedPreceding, 0)
    sizes = one.select("doc_id", kind, F.octet_length("text").cast("long").alias("_n")).withColumn("_sum", F.sum("_n").over(before))
    # A row for each of those ids at most.
    return one.join(F.broadcast(sizes.filter(F.col("_sum") <= most).select("doc_id", kind)), ["doc_id", kind])


# Bytes of chunks and values that a worker keeps, about; what an entry takes beside them; the longest chunk that is kept.
TABLE_BYTES = 72 << 20
ENTRY_BYTES = 200
LONGEST_CHUNK = 64
# Bytes of the texts that are in Python at a time.
GROUP_BYTES = 4 << 20


class ChunkTable:
    """Values (bytes, or tuples of them) of distinct chunks: each chunk that is not in the table yet is computed once.

    The table is bounded by bytes: a full one starts anew, and a chunk of more than
    LONGEST_CHUNK characters, such as a text without blanks, is only kept for the texts at hand. That
    costs time but changes no result.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = TABLE_BYTES):
        self.compute, self.limit, self.values, self.held, self.passing = compute, limit, {}, 0, []

    def load(self, chunks: Iterable[list[str]]) -> dict:
        """The table, with every given chunk in it."""
        for chunk in self.passing:
            self.values.pop(chunk, None)
        self.passing = []
        if self.held > self.limit:
            self.values, self.held = {}, 0
        missing = [c for c in set().union(*chunks) if c not in self.values]
        for chunk, value in zip(missing, self.compute(missing)):
            self.values[chunk] = value
            if len(chunk) > LONGEST_CHUNK:
                self.passing.append(chunk)
            else:
                self.held += ENTRY_BYTES + len(chunk) + (len(value) if isinstance(value, bytes) else sum(map(len, value)))
        return self.values


def in_groups(texts: pa.Array, rows: int = 512) -> Iterable[tuple[int, list[str]]]:
    """(position, texts) of slices of an Arrow column, one of bounded size in Python at a time; a null text is empty."""
    sizes, first = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), 0
    while first < len(texts):
        total = np.cumsum(sizes[first : first + rows])
        count = max(1, int(np.searchsorted(total, GROUP_BYTES, "right")))
        yield first, [t or "" for t in texts.slice(first, count).to_pylist()]
        first += count
