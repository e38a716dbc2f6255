"""Near copies among vectors: binary codes of rotated vectors, with bounds on the cosine that they leave open."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlore.llm.components import components, roots
from rowlore.plans.sizing import materialize

COSINE = 0.9
# Standard errors that a bound leaves below and above an estimate: misses one pair in three million.
DEVIATIONS = 5.0
# Chance that no table brings together two vectors whose cosine is just COSINE.
MISS = 1e-3
# Vectors that chance alone puts into a bucket, about; buckets with more than BLOCK are dealt in pairs of blocks.
BUCKET = 512
BLOCK = 1024
SEED = 17
LINKED = "node long, links long, root long"


def rotations(width: int, rows: int, seed: int) -> np.ndarray:
    """`rows` directions from random rotations: orthogonal to each other within a rotation."""
    rng = np.random.default_rng([seed, width])
    turns = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-rows // width))]
    return np.concatenate(turns)[:rows]


@dataclass
class Tables:
    """Hash tables over signs: `bits` of each key, `count` of them."""

    bits: int
    count: int

    @classmethod
    def fitting(cls, vectors: int, cosine: float = COSINE, bucket: int = BUCKET, miss: float = MISS) -> Tables:
        """Keys long enough to leave about `bucket` vectors under each, and tables enough for `miss`."""
        bits = max(4, min(30, math.ceil(math.log2(max(vectors, 1) / bucket))))
        same = (1 - math.acos(cosine) / math.pi) ** bits
        return cls(bits, math.ceil(math.log(miss) / math.log(1 - same)))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Keys of vectors, a column for each table."""
        signs = unit @ rotations(unit.shape[1], self.bits * self.count, SEED).T > 0
        return signs.reshape(len(unit), self.count, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))


def units(values: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision."""
    wide = values.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


@dataclass
class Codes:
    """Rotated unit vectors, their signs, and the correction factor of each: its product with its code.

    The code of x is the sign vector, scaled to length one. For any q, code·q over
    code·x is an unbiased estimate of x·q over random rotations.
    """

    unit: np.ndarray
    turned: np.ndarray
    signs: np.ndarray
    factor: np.ndarray

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        turned = (unit @ rotations(unit.shape[1], unit.shape[1], SEED + 1).T).astype(np.float32)
        signs = np.where(turned > 0, 1, -1).astype(np.float32) / np.float32(math.sqrt(unit.shape[1]))
        return cls(unit, turned, signs, (signs * turned).sum(axis=1))

    def part(self, rows: np.ndarray) -> Codes:
        return Codes(self.unit[rows], self.turned[rows], self.signs[rows], self.factor[rows])

    def spread(self, cosine: float) -> np.ndarray:
        """Bound on the error of estimates from these codes, for pairs at least as near as `cosine`."""
        rest = np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor
        return DEVIATIONS * rest * math.sqrt(1 - cosine**2) / math.sqrt(max(self.unit.shape[1] - 1, 1)) + 1e-5


def close_pairs(a: Codes, b: Codes, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs with at least `cosine`; with `same`, a and b are one set and each pair is named once.

    Both vectors' codes estimate the product from the other one's floats. Where an
    estimate and its bound stay below `cosine` the pair is out; all others are
    computed anew in double precision.
    """
    first = a.turned @ b.signs.T / b.factor
    maybe = first + b.spread(cosine) >= cosine
    if same:
        maybe &= np.tri(len(maybe), k=-1, dtype=bool).T
    i, j = np.nonzero(maybe)
    second = np.einsum("nd,nd->n", a.signs[i], b.turned[j]) / a.factor[i]
    open_ = second + a.spread(cosine)[i] >= cosine
    i, j = i[open_], j[open_]
    near = np.einsum("nd,nd->n", a.unit[i], b.unit[j]) >= cosine
    return i[near], j[near]


def _compare(table: int, nodes: np.ndarray, weights: np.ndarray, keys: np.ndarray, values: np.ndarray, block: np.ndarray, cosine: float) -> tuple[np.ndarray, ...]:
    """(node, links, root) of the vectors under one key, from pairs that no earlier table has under one key.

    Two blocks are compared with each other only, one block with itself.
    """
    codes = Codes.of(units(values))
    names = np.unique(block)
    sides = [np.flatnonzero(block == n) for n in names]
    left, right = sides[0], sides[-1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(left), BLOCK):
        for j in range(i if len(sides) == 1 else 0, len(right), BLOCK):
            own, other = left[i : i + BLOCK], right[j : j + BLOCK]
            a, b = close_pairs(codes.part(own), codes.part(other), cosine, len(sides) == 1 and i == j)
            found.append((own[a], other[b]))
    a, b = (np.concatenate(c) for c in zip(*found))
    new = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
    a, b = a[new], b[new]
    links = np.bincount(a, weights[b], len(nodes)) + np.bincount(b, weights[a], len(nodes))
    some = np.flatnonzero(links > 0)
    reached, root = roots(nodes[a], nodes[b])
    order = np.argsort(nodes[some])
    return nodes[some][order], links[some][order].astype(np.int64), root[np.searchsorted(reached, nodes[some][order])]


def vector_links(vectors: DataFrame, cosine: float = COSINE, tables: Tables | None = None) -> DataFrame:
    """(node, links, root) rows of distinct valid vectors (node, weight, embedding), several a node.

    Vectors meet in hash tables over the signs of random projections; what meets
    is compared through binary codes. links: summed weight of the vectors linked
    under one key, each pair counted in its first table only; root: a smaller or
    equal node of the same component.
    """
    tables = tables or Tables.fitting(vectors.count(), cosine)
    kind = "<f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "<f4"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            start = np.cumsum(size) - size
            # Vectors of different widths are never compared: the key has the width.
            for width in np.unique(size):
                rows = np.flatnonzero(size == width)
                own = values[start[rows, None] + np.arange(width)]
                keys = tables.keys(units(own))
                blobs = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (keys.astype("<i4"), own)]
                for t in range(tables.count):
                    label = (keys[:, t] * tables.count + t) * (1 << 20) + width
                    columns = [pa.array(label), pa.array(np.full(len(rows), t, np.int32)), *(batch.column(c).take(pa.array(rows)) for c in (0, 1)), *blobs]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "table", "node", "weight", "keys", "values"])

    rows = vectors.select("node", "weight", "embedding").mapInArrow(hashed, "key long, table int, node long, weight long, keys binary, values binary")
    sizes = rows.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK)
    crowded = materialize(sizes.select("key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")), "crowded")
    rows = rows.join(crowded, "key", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.coalesce("_blocks", F.lit(1))).cast("int"))
    # A block of a crowded key goes to its pairs with all blocks of the key.
    mates = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_blocks"), F.lit(1)) - 1))
    rows = rows.withColumn("_mate", mates).withColumn("place", F.xxhash64("key", F.least("block", "_mate"), F.greatest("block", "_mate")))
    columns = ("place", "table", "node", "weight", "keys", "values", "block")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*columns).repartition(parts, "place").sortWithinPartitions("place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held)
            held.clear()
            if group.num_rows < 2:
                return
            table = group.column("table")[0].as_py()
            node, weight, block = (group.column(c).to_numpy() for c in ("node", "weight", "block"))
            keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), "<i4").reshape(len(node), -1)
            values = np.frombuffer(b"".join(group.column("values").to_pylist()), kind).reshape(len(node), -1)
            out = _compare(table, node, weight, keys, values, block, cosine)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["node", "links", "root"])

        for batch in batches:
            place = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(place)) + 1
            for first, last in zip(np.r_[0, cuts], np.r_[cuts, len(place)]):
                if held and held[0].column(0)[0].as_py() != place[first]:
                    yield from done()
                if last > first:
                    held.append(batch.slice(first, last - first))
        if held:
            yield from done()

    return dealt.mapInArrow(compare, LINKED)


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Two rows are linked if their cosine, in double precision, is at least
    `cosine`. n_links counts other rows; the component is the smallest vec_id that
    links lead to. Equal vectors are compared as one. A vector that is null,
    empty, zero, or has null or non-finite parts links with nothing, and so does
    a row without vec_id; vectors of different lengths don't link. Such rows are
    components of their own and kept. Other columns are ignored.
    """
    own = embeddings.select(F.col("vec_id").cast("long"), "embedding")
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    valid = own.filter(f"vec_id IS NOT NULL AND {finite} AND exists(embedding, x -> x <> 0)")
    distinct = materialize(valid.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "vectors")
    links = materialize(vector_links(distinct, cosine), "vector-links")
    number = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    table = distinct.join(number, "node", "left").join(groups, "node", "left")
    table = materialize(
        table.select("embedding", F.col("weight").alias("_weight"), F.col("links").alias("_links"), F.coalesce("component", "node").alias("_component")), "membership"
    )
    # Only valid rows have a match; a row without id has none by the condition.
    found = own.withColumn("_match", F.when(F.col("vec_id").isNotNull(), F.col("embedding"))).join(table.withColumnRenamed("embedding", "_match"), "_match", "left")
    linked = F.coalesce(F.col("_links"), F.lit(0)) + F.coalesce(F.col("_weight"), F.lit(1)) - 1
    component = F.coalesce("_component", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return found.select("vec_id", linked.cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
