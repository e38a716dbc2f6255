"""Record retrieval: V1-V6, J5, C7, F21."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlore.functions.vectors import TIE_DIGITS, as_matrix, rank_key, relevance_to, unit_rows
from rowlore.model import LIST_LIMIT, RECORDS_LIMIT, FuzzyMatch
from rowlore.operators.filters import min_relevance, where_filters
from rowlore.plans.sizing import BROADCAST_BYTES

# Target size of one group of vectors in the shuffled form of the batch search.
GROUP_BYTES = 64 << 20
# Blocks of records are not made smaller than this.
LEAST_BYTES = 8 << 20


def limited(df: DataFrame, limit: int) -> DataFrame:
    """V4: a limit of zero or less means all rows."""
    return df.limit(limit) if limit > 0 else df


def list_records(
    df: DataFrame,
    filters=None,
    limit: int = LIST_LIMIT,
    order: Sequence[str] = ("file", "row_number", "id"),
    fuzzy: FuzzyMatch = FuzzyMatch(),
    **how,
) -> DataFrame:
    """V5: filtered records in a total order, so a limit always picks the same rows."""
    return limited(where_filters(df, filters, fuzzy, **how).orderBy(*order), limit)


def similar(
    df: DataFrame,
    question: Sequence[float],
    limit: int = LIST_LIMIT,
    filters=None,
    least: float | None = None,
    vector: str = "embedding",
    record_id: str = "id",
    with_embedding: bool = False,
    fuzzy: FuzzyMatch = FuzzyMatch(),
    **how,
) -> DataFrame:
    """The most similar records, filters first, relevance floor after the limit."""
    hits = where_filters(df, filters, fuzzy, **how).withColumn("score", relevance_to(question)(F.col(vector)))
    hits = hits if with_embedding else hits.drop(vector)
    ranked = limited(hits.orderBy(F.desc(rank_key(F.col("score"))), record_id), limit)
    return ranked if least is None else min_relevance(ranked, least)


# Records and questions of one score matrix: 8 MB, however many questions there are.
TILE = 1024


def _best(q: np.ndarray, score: np.ndarray, ids: pd.Series, k: int) -> pd.DataFrame:
    """The first k candidates of each question by rank, exact under ties."""
    found = pd.DataFrame({"q": q, "score": score, "key": np.round(score, TIE_DIGITS), "id": ids})
    found = found.sort_values(["q", "key", "id"], ascending=[True, False, True], kind="stable")
    return found.groupby("q", sort=False).head(k)


def _candidates(unit: np.ndarray, ids: pd.Series, questions: np.ndarray, k: int, floor: np.ndarray) -> pd.DataFrame:
    """Every record that can still be among a question's first k: within these rows, and by the key of its k-th so far.

    Scores in single precision only rule out; what is left is scored in double precision.
    """
    near = unit.astype(np.float32) @ questions.astype(np.float32).T
    error = (unit.shape[1] + 8) * 2.0**-23  # more than a sum of so many single-precision products can be off
    least = 2 * floor - 1 - error - 4 * 10.0**-TIE_DIGITS
    if not np.isfinite(floor).all() and len(near) > k:
        within = -np.partition(-near, k - 1, axis=0)[k - 1].astype(np.float64) - 2 * error - 4 * 10.0**-TIE_DIGITS
        least = np.fmax(least, within)
    # Rounded down, so that the comparison stays in single precision.
    reached = near >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))
    row, q = np.divmod(np.flatnonzero(reached), len(questions))
    score = np.empty(len(row))
    for at in range(0, len(row), TILE * 16):
        some = slice(at, at + TILE * 16)
        score[some] = (1 + np.einsum("ij,ij->i", unit[row[some]], questions[q[some]])) / 2
    key = np.round(score, TIE_DIGITS)
    kept = key >= floor[q]
    return pd.DataFrame({"q": q[kept], "score": score[kept], "key": key[kept], "id": ids.take(row[kept]).reset_index(drop=True)})


class _First:
    """The first k records of some questions; what may belong to them is sorted in when there is enough of it."""

    def __init__(self, questions: np.ndarray, k: int):
        self.questions, self.k, self.new, self.waiting = questions, k, [], 0
        self.floor = np.full(len(questions), -np.inf)

    def add(self, unit: np.ndarray, ids: pd.Series) -> None:
        found = _candidates(unit, ids, self.questions, self.k, self.floor)
        if len(found):
            self.new.append(found)
            self.waiting += len(found)
        # The first rows set the floor, later ones seldom reach it.
        if self.waiting > TILE * self.k or not np.isfinite(self.floor).any():
            self.best()

    def best(self) -> pd.DataFrame | None:
        if self.waiting:
            both = pd.concat(self.new, ignore_index=True)
            first = _best(both["q"].to_numpy(), both["score"].to_numpy(), both["id"], self.k)
            ends = first.groupby("q")["key"].agg(["size", "last"])
            full = ends[ends["size"] >= self.k]
            self.floor[full.index.to_numpy()] = full["last"].to_numpy()
            self.new, self.waiting = [first], 0
        return self.new[0] if self.new else None


def _search(batches: Iterator[pa.RecordBatch], questions: np.ndarray, k: int) -> pd.DataFrame | None:
    """The first k records of each question; scores exist for TILE records and TILE questions at a time."""
    tiles = {at: _First(questions[at : at + TILE], k) for at in range(0, len(questions), TILE)}
    for batch in batches:
        m, present = as_matrix(batch.column(1))
        if not m.size:
            continue
        ids = batch.column(0).filter(pa.array(present)).to_pandas()
        alive = (m * m).sum(axis=1) > 0
        unit, ids = unit_rows(m[alive]), ids[alive].reset_index(drop=True)
        for i in range(0, len(unit), TILE):
            some = ids[i : i + TILE].reset_index(drop=True)
            for first in tiles.values():
                first.add(unit[i : i + TILE], some)
    found = [best.assign(q=best["q"] + at) for at, first in tiles.items() if (best := first.best()) is not None]
    return pd.concat(found, ignore_index=True) if found else None


def similar_batch(
    records: DataFrame,
    questions: DataFrame,
    limit: int = LIST_LIMIT,
    record_id: str = "id",
    vector: str = "embedding",
    question_id: str = "question_id",
    question_vector: str = "question_vector",
    max_broadcast: int = BROADCAST_BYTES,
) -> DataFrame:
    """The first `limit` records of every question: `(question_id, id, score, rank)`.

    Each task scores its records against a block of questions with one matrix
    product and emits only its own best `limit` per question; a window merges
    those. No record-question pairs are shuffled. Question vectors are broadcast
    only when they measure below `max_broadcast`. Beyond it, both sides are cut
    into bounded blocks that meet through an equi-join on block numbers.
    """
    pairs = questions.select(question_id, F.col(question_vector).alias("_v")).where(F.col("_v").isNotNull())
    stored = records.select(record_id, F.col(vector).cast("array<float>").alias("_v")).where(F.col("_v").isNotNull())
    types = dict(records.dtypes), dict(questions.dtypes)
    schema = f"{question_id} {types[1][question_id]}, {record_id} {types[0][record_id]}, score double"
    size = pairs.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.size("_v") * F.lit(8)), F.lit(0)).alias("bytes")
    ).first()
    if size["bytes"] <= max_broadcast:
        best = _broadcast_search(stored, pairs, limit, schema)
    else:
        best = _block_search(stored, pairs, limit, schema, size["bytes"], max_broadcast)
    w = Window.partitionBy(question_id).orderBy(F.desc(rank_key(F.col("score"))), record_id)
    ranked = best.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= limit)


def _broadcast_search(stored: DataFrame, pairs: DataFrame, k: int, schema: str) -> DataFrame:
    table = pairs.toArrow()
    ids, (m, _) = table.column(0).to_pandas(), as_matrix(table.column(1))
    shared = stored.sparkSession.sparkContext.broadcast((ids, unit_rows(m) if m.size else m))
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question_ids, matrix = shared.value
        best = _search(batches, matrix, k) if len(question_ids) else None
        if best is not None:
            out = pd.DataFrame(
                {
                    names[0]: question_ids.take(best["q"]).to_numpy(),
                    names[1]: best["id"].to_numpy(),
                    names[2]: best["score"].to_numpy(),
                }
            )
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return stored.mapInArrow(run, schema)


def _block_search(stored: DataFrame, pairs: DataFrame, k: int, schema: str, size: int, block_bytes: int) -> DataFrame:
    n_questions = max(1, -(-size // min(block_bytes, GROUP_BYTES)))
    record_bytes = stored.agg(F.coalesce(F.sum(F.size("_v") * F.lit(8)), F.lit(0))).first()[0]
    # Pairs of blocks enough to keep all cores busy to the end.
    busy = -(-4 * stored.sparkSession.sparkContext.defaultParallelism // n_questions)
    n_records = max(1, -(-record_bytes // GROUP_BYTES), min(busy, -(-record_bytes // LEAST_BYTES)))
    qid, rid = pairs.columns[0], stored.columns[0]
    q_block = F.pmod(F.xxhash64(qid), F.lit(n_questions)).cast("int")
    r_block = F.pmod(F.xxhash64(rid), F.lit(n_records)).cast("int")
    left = stored.select(
        r_block.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(n_questions - 1))).alias("q"), rid, "_v"
    )
    right = pairs.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_records - 1))).alias("r"), q_block.alias("q"), qid, "_v"
    )
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(records: pa.Table, questions: pa.Table) -> pa.Table:
        ids = questions.column(qid).to_pandas()
        m, _ = as_matrix(questions.column("_v"))
        batches = records.select([rid, "_v"]).to_batches()
        best = _search(iter(batches), unit_rows(m), k) if m.size else None
        if best is None:
            best = pd.DataFrame({"q": np.empty(0, int), "id": pd.Series(dtype="int64"), "score": np.empty(0)})
        frame = pd.DataFrame(
            {
                names[0]: ids.take(best["q"]).to_numpy(),
                names[1]: best["id"].to_numpy(),
                names[2]: best["score"].to_numpy(),
            }
        )
        types = pa.schema([
            (names[0], questions.column(qid).type), (names[1], records.column(rid).type), (names[2], pa.float64())
        ])
        return pa.Table.from_pandas(frame, schema=types, preserve_index=False)

    return left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(run, schema)


def records_by(
    df: DataFrame, column: str, value: str, limit: int = RECORDS_LIMIT, order: Sequence[str] = ("file", "row_number", "id")
) -> DataFrame:
    """Records of one schema or one import batch, in a total order."""
    return limited(df.where(scalar_or_list(df, column) == value).orderBy(*order), limit)


def scalar_or_list(df: DataFrame, column: str) -> Column:
    """Old data may hold the id as a list; its first element counts."""
    return F.get(F.col(column), F.lit(0)) if dict(df.dtypes)[column].startswith("array") else F.col(column)
