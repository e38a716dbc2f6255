"""Tables written for search: lower-cased shadow columns (F4, F11, S11), vectors in blocks around pivots (V1)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from rowlore.functions.vectors import as_matrix, unit_rows
from rowlore.model import LIST_LIMIT, shadow_of
from rowlore.operators.retrieve import similar

# Pivots of an index; they are the vectors of least hash, so a table has the same ones at each build.
PIVOTS = 64
# What rounding may add to a bound.
SLACK = 1e-9
BLOCKS = "block int, pivot array<double>, radius double, n long"


def with_shadows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns with their lower-cased shadows beside them; filters that ignore case use those."""
    return df.withColumns({shadow_of(c): F.lower(F.col(c)) for c in columns})


def write_searchable(df: DataFrame, path: str, columns: Sequence[str], ids: Sequence[str] = ()) -> None:
    """A table with shadows of `columns`, and bloom filters on those and on `ids`: equality skips row groups."""
    writer = with_shadows(df, columns).write
    for c in (*map(shadow_of, columns), *ids):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def _nearest(pivots: np.ndarray | None):
    """Block of each vector, that of its nearest pivot, and the distance to it; block -1 for vectors without a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, present = as_matrix(batch.column(batch.schema.get_field_index("_v")))
            block, distance = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, np.nan)
            if m.size and pivots is not None:
                unit = unit_rows(m)
                near = unit @ pivots.T
                best = np.nan_to_num(near, nan=-2.0).argmax(axis=1)
                away = np.sqrt(np.maximum(2 - 2 * near[np.arange(len(m)), best], 0))
                block[present] = np.where(np.isnan(away), -1, best)
                distance[present] = away
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "_v"]
            names = [n for n in batch.schema.names if n != "_v"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(block), pa.array(distance, from_pandas=True)], names=[*names, "block", "_distance"])

    return run


class VectorIndex:
    """Vectors in folders around pivots, each with its radius: exact search that reads few of them.

    On unit vectors the distance to a question is at least the distance to the
    pivot less the radius. Folders whose bound cannot reach the k-th best score found so far
    are not read. The blocks are a row each, at most `PIVOTS` of them and one.
    """

    def __init__(self, spark: SparkSession, path: str, record_id: str = "id", vector: str = "embedding"):
        self.spark, self.path, self.record_id, self.vector = spark, path.rstrip("/"), record_id, vector

    def build(self, df: DataFrame, pivots: int = PIVOTS) -> VectorIndex:
        own = F.col(self.vector).cast("array<double>")
        length = F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x)
        some = df.select(self.record_id, own.alias("_v")).where(length > 0).orderBy(F.xxhash64(self.record_id), self.record_id).limit(pivots)
        m, _ = as_matrix(some.select("_v").toArrow().column(0))
        found = unit_rows(m) if m.size else None
        schema = StructType([*df.schema.fields, StructField("block", IntegerType()), StructField("_distance", DoubleType())])
        placed = df.withColumn("_v", F.col(self.vector)).mapInArrow(_nearest(found), schema)
        placed.repartition("block").write.partitionBy("block").parquet(f"{self.path}/vectors")
        stats = self.spark.read.schema(schema).parquet(f"{self.path}/vectors").groupBy("block").agg(F.max("_distance").alias("radius"), F.count("*").alias("n")).collect()
        rows = [(r["block"], found[r["block"]].tolist() if r["block"] >= 0 else None, r["radius"], r["n"]) for r in stats]
        self.spark.createDataFrame(rows, BLOCKS).coalesce(1).write.parquet(f"{self.path}/blocks")
        return self

    def _read(self, blocks: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors").where(F.col("block").isin(*blocks)).drop("_distance")

    def search(self, question: Sequence[float], limit: int = LIST_LIMIT, least: float | None = None) -> tuple[DataFrame, int]:
        """(the `limit` most similar records as `similar` gives them, the number of blocks that were read)."""
        blocks = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks").collect()
        q = np.asarray(question, np.float64)
        q = q / np.sqrt((q * q).sum())
        bounds = {}
        for b in blocks:
            if b["block"] >= 0:
                nearest = max(np.sqrt(max(2 - 2 * float(q @ np.array(b["pivot"])), 0)) - b["radius"], 0)
                bounds[b["block"]] = 1 - nearest * nearest / 4
        sizes, order = {b["block"]: b["n"] for b in blocks}, sorted(bounds, key=lambda b: (-bounds[b], b))
        if limit <= 0 or sum(sizes[b] for b in order) < limit:
            chosen = list(sizes)
        else:
            first, total = [], 0
            while total < limit:
                first.append(order[len(first)])
                total += sizes[first[-1]]
            worst = similar(self._read(first), question, limit, vector=self.vector, record_id=self.record_id).agg(F.min("score")).first()[0]
            chosen = [b for b in order if bounds[b] >= worst - SLACK]
        found = similar(self._read(chosen), question, limit, least=least, vector=self.vector, record_id=self.record_id)
        return found.drop("block"), len(chosen)
