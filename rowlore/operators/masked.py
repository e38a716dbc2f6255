"""The best records of many filters at once, verdicts and scores met batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlore.functions.vectors import TIE_DIGITS, as_matrix, unit_rows
from rowlore.operators.retrieve import GROUP_BYTES, TILE
from rowlore.plans.sizing import BROADCAST_BYTES

# Bytes of one kept candidate, about.
HIT_BYTES = 64
# Scores of single pairs are taken in slices of this many numbers.
SLICE = 1 << 22
FOUND = "number long, {id}, score double"


@dataclass
class Asked:
    """Filters by number, each with the row of its question; `open` lists those of a code that every record of it meets."""

    numbers: np.ndarray
    question: np.ndarray
    vectors: np.ndarray
    open: dict[int, np.ndarray]


def asked_of(table: pa.Table) -> Asked:
    """From rows (number, code, question_vector): code is null for filters with conditions, negative for open ones."""
    table = table.sort_by("number")
    numbers = table.column("number").to_numpy()
    code = table.column("code").to_pandas().fillna(0).to_numpy(np.int64)
    m, present = as_matrix(table.column("question_vector"))
    vectors = np.full((len(numbers), m.shape[1]), np.nan)
    vectors[present] = unit_rows(m) if m.size else m
    return Asked(numbers, np.arange(len(numbers)), vectors, {int(c): np.flatnonzero(code == c) for c in np.unique(code[code < 0])})


def _units(vectors: pa.Array, width: int) -> np.ndarray:
    m, present = as_matrix(vectors)
    out = np.full((len(vectors), width), np.nan)
    if m.size and width:
        if m.shape[1] != width:
            raise ValueError("vectors of different widths")
        out[present] = unit_rows(m)
    return out


def _pair_scores(unit: np.ndarray, row: np.ndarray, question: np.ndarray, asked: Asked) -> np.ndarray:
    """Cosines of single pairs: through a whole tile where most of it is wanted, one by one where few are."""
    out = np.empty(len(row))
    if not len(row) or not unit.shape[1]:
        out[:] = np.nan
        return out
    order = np.argsort(question // TILE, kind="stable")
    cuts = np.flatnonzero(np.diff(question[order] // TILE)) + 1
    for part in np.split(order, cuts):
        first = question[part[0]] // TILE * TILE
        tile = asked.vectors[first : first + TILE]
        if 8 * len(part) > len(unit) * len(tile):
            out[part] = (unit @ tile.T)[row[part], question[part] - first]
            continue
        step = max(1, SLICE // unit.shape[1])
        for i in range(0, len(part), step):
            own = part[i : i + step]
            out[own] = (unit[row[own]] * asked.vectors[question[own]]).sum(axis=1)
    return out


def _kept(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k of each filter: by score, then id; records without a score come last."""
    found = found.assign(key=np.round(found["score"], TIE_DIGITS).fillna(-1.0))
    found = found.sort_values(["number", "key", "id"], ascending=[True, False, True], kind="stable")
    return (found.groupby("number", sort=False).head(k) if k > 0 else found).drop(columns="key")


def _open_pairs(unit: np.ndarray, rows: np.ndarray, filters: np.ndarray, asked: Asked, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, filter, score) that may be among the first k of filters that all these rows meet."""
    for at in range(0, len(filters), TILE):
        own = filters[at : at + TILE]
        scores = (1 + unit[rows] @ asked.vectors[asked.question[own]].T) / 2 if unit.shape[1] else np.full((len(rows), len(own)), np.nan)
        keys = np.nan_to_num(np.round(scores, TIE_DIGITS), nan=-1.0)
        floor = -np.partition(-keys, k - 1, axis=0)[k - 1] if 0 < k < len(rows) else np.full(len(own), -1.0)
        row, f = np.nonzero(keys >= floor)
        yield rows[row], own[f], scores[row, f]


def masked_best(batches: Iterator[pa.RecordBatch], asked: Asked, k: int) -> Iterator[pd.DataFrame]:
    """(number, id, score) of the first k records of each filter over batches (id, vector, verdicts).

    A verdict names a filter, or by its code all open ones of it. Per filter k candidates
    are held, all of a batch's at a limit of zero, which then go out at once.
    """
    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            ids, vectors, verdicts = (batch.column(i).slice(at, TILE) for i in range(3))
            unit = _units(vectors, asked.vectors.shape[1])
            row = np.repeat(np.arange(len(ids)), np.asarray(verdicts.value_lengths().fill_null(0)))
            verdict = verdicts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            named = verdict >= 0
            f = np.searchsorted(asked.numbers, verdict[named])
            parts = [(row[named], f, (1 + _pair_scores(unit, row[named], asked.question[f], asked)) / 2)]
            for code in np.unique(verdict[~named]):
                if code in asked.open:
                    parts += _open_pairs(unit, row[verdict == code], asked.open[code], asked, k)
            rows, filters, scores = (np.concatenate(p) for p in zip(*parts))
            found = pd.DataFrame({"number": asked.numbers[filters], "id": ids.to_pandas().take(rows).reset_index(drop=True), "score": scores})
            if k <= 0:
                yield found
            else:
                held = _kept(found if held is None else pd.concat([held, found], ignore_index=True), k)
    if held is not None:
        yield held


def masked_search(
    matched: DataFrame, filters: DataFrame, limit: int, record_id: str, vector: str, max_broadcast: int = BROADCAST_BYTES
) -> DataFrame:
    """`(number, record, score)`: candidates of every filter, the first `limit` of each task.

    `matched` has `verdicts` beside the record's id and vector; `filters` has
    `number, code, question_vector`. Records meet questions as matrix tiles, never
    as rows. Filters go to all tasks below a measured size; beyond it records and
    filters are cut into blocks, and a record goes to those blocks that have a filter it meets.
    """
    kind = dict(matched.dtypes)[record_id]
    schema = FOUND.format(id=f"`{record_id}` {kind}")
    stored = matched.select(record_id, F.col(vector).cast("array<float>").alias("_v"), "verdicts")
    filters = filters.select("number", "code", "question_vector")
    each = F.coalesce(F.size("question_vector"), F.lit(0)) * 8 + max(limit, 1) * HIT_BYTES
    size = filters.agg(F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()[0]
    names = ["number", record_id, "score"]

    def shown(found: pd.DataFrame, id_type: pa.DataType) -> pa.Table:
        columns = [pa.array(found["number"], pa.int64()), pa.array(found["id"], id_type), pa.array(found["score"], pa.float64(), from_pandas=True)]
        return pa.Table.from_arrays(columns, names=names)

    if size <= max_broadcast:
        shared = matched.sparkSession.sparkContext.broadcast(asked_of(filters.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            id_type = None

            def seen() -> Iterator[pa.RecordBatch]:
                nonlocal id_type
                for batch in batches:
                    id_type = batch.schema.field(0).type
                    yield batch

            for found in masked_best(seen(), shared.value, limit):
                yield from shown(found, id_type).to_batches()

        return stored.mapInArrow(run, schema)
    blocks = -(-size // min(max_broadcast, GROUP_BYTES))
    groups = max(1, -(-int(stored.agg(F.coalesce(F.sum(F.size("_v") * F.lit(8)), F.lit(0))).first()[0]) // GROUP_BYTES))
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    own = F.array_distinct(F.transform(F.filter("verdicts", lambda v: v >= 0), block_of))
    wanted = F.when(F.exists("verdicts", lambda v: v < 0), F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(own)
    left = stored.select(F.pmod(F.xxhash64(record_id), F.lit(groups)).cast("int").alias("r"), F.explode(wanted).alias("b"), record_id, "_v", "verdicts")
    left = left.withColumn("verdicts", F.filter("verdicts", lambda v: (v < 0) | (block_of(v) == F.col("b"))))
    right = filters.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("r"), block_of(F.col("number")).alias("b"), "number", "code", "question_vector")

    def run_block(records: pa.Table, questions: pa.Table) -> pa.Table:
        found = list(masked_best(iter(records.select([record_id, "_v", "verdicts"]).to_batches()), asked_of(questions), limit)) if questions.num_rows else []
        none = pd.DataFrame({"number": [], "id": [], "score": []})
        return shown(pd.concat(found) if found else none, records.schema.field(record_id).type)

    return left.groupBy("r", "b").cogroup(right.groupBy("r", "b")).applyInArrow(run_block, schema)
