"""Best-fit packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlore.llm.common import ENTRY_BYTES, LONGEST_CHUNK, TABLE_BYTES, in_groups
from rowlore.plans.sizing import materialize

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
# Unicode white space. The byte-level rule never joins a character to white space
# that follows it, so a text is cut before each run of white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_TABLES: dict = {}


class IdTable(dict):
    """Chunks and their ids as little-endian unsigned 32-bit numbers; a chunk is encoded when first asked for.

    The default vocabulary is also there as ranks, which encode a short chunk
    faster; a chunk with a special token's text goes to the tokenizers library.
    The table is bounded by bytes, and very long chunks are not kept.
    """

    held = 0

    def __init__(self, path: str | None):
        import base64

        import public_tokenizers
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.encode = None
        if path is None:
            import tiktoken

            with open(public_tokenizers.path(RANKS), "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            pattern = public_tokenizers.PATTERN
            self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        if self.encode is None or any(t in chunk for t in self.special):
            ids = self.model.encode(chunk, add_special_tokens=False).ids
        else:
            ids = self.encode(chunk)
        blob = np.array(ids, "<u4").tobytes()
        if len(chunk) <= LONGEST_CHUNK:
            if self.held > TABLE_BYTES:
                # A full table starts anew, which costs time but changes no id.
                self.clear()
                self.held = 0
            self[chunk] = blob
            self.held += ENTRY_BYTES + len(chunk) + len(blob)
        return blob


def _id_table(path: str | None) -> IdTable:
    """This worker's table."""
    if path not in _TABLES:
        _TABLES[path] = IdTable(path)
    return _TABLES[path]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Each document's ids, ended by `end_id`, as pieces of at most `capacity` ids.

    A longer document is cut from its end, so only its first piece may be
    shorter than `capacity`. A null or empty text is the end id alone. Rows with
    one doc_id, or none, are documents of their own. Other columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in in_groups(batch.column(1)):
                ids_of = _id_table(vocabulary).__getitem__
                out: tuple[list, ...] = ([], [], [], [], [])
                for i, text in enumerate(texts, first):
                    blob = b"".join(map(ids_of, CHUNK.findall(text))) + end
                    total = len(blob) // 4
                    start, piece, stop = 0, 0, (total - 1) % capacity + 1
                    while start < total:
                        row = (ids[i], piece, start, stop - start, zlib.crc32(blob[4 * start : 4 * stop]))
                        for column, value in zip(out, row):
                            column.append(value)
                        start, stop, piece = stop, stop + capacity, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenise, PIECES)


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the tightest fit."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.tree = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        node, self.tree[self.leaves + room] = (self.leaves + room) // 2, bool(self.runs[room])
        while node:
            self.tree[node] = self.tree[2 * node] or self.tree[2 * node + 1]
            node //= 2

    def add(self, room: int, first: int, bins: int) -> None:
        if bins:
            self.runs[room].append((first, bins))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that holds `length`: up, then down the tree."""
        node = self.leaves + length
        if self.tree[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over the number of items of each length.

    Rows (length, first rank, items per bin, first bin, first offset): of the
    items of a length, those from the first rank on fill consecutive bins, so
    many in each. Items of one length take the place that they would take one by
    one: a bin is filled before the next one of equal room. The rows depend on
    the capacity, not on the number of items.
    """
    bins, rows, unused = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, free = capacity, unused, -(-left // (capacity // length))
                unused += free
            else:
                first, free = bins.take(room)
            each = room // length
            full = min(free, left // each)
            rows.append((length, rank, each, first, capacity - room))
            bins.add(room - each * length, first, full)
            used = full * each
            if full < free and used < left:
                bins.add(room - (left - used) * length, first + full, 1)
                used, full = left, full + 1
            bins.add(room, first + full, free - full)
            left, rank = left - used, rank + used
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with the sequence that holds each and the place in it, by best-fit decreasing.

    Only lengths matter to best fit, and there are at most `capacity` of them:
    their counts are summed over all pieces and packed at once, and each piece
    finds its place by its rank among the pieces of its length. Ranks come from
    salted windows plus the counts of the salts before, so a length that most
    pieces share is spread over many tasks, equal pieces too: salts go by a number that a piece is
    written with. No piece gives an empty table.
    """
    pieces = materialize(pieces.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    total = pieces.count()
    salts = max(16, -(-total // 250_000))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit(counts, capacity)
    lengths, starts = np.unique(plan[:, 0], return_index=True)
    plan = plan[np.argsort(plan[:, 0], kind="stable")]
    starts = np.searchsorted(plan[:, 0], lengths)
    ends = np.append(starts[1:], len(plan))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank, row = frame.pop("_rank").to_numpy(), np.zeros(len(frame), np.int64)
            size = frame["length"].to_numpy()
            for value in np.unique(size):
                k, here = np.searchsorted(lengths, value), size == value
                row[here] = starts[k] + np.searchsorted(plan[starts[k] : ends[k], 1], rank[here], side="right") - 1
            _, first, each, bin_id, offset = plan[row].T if len(plan) else np.zeros((5, 0), np.int64)
            bins, place_in = np.divmod(rank - first, np.maximum(each, 1))
            yield frame.assign(sequence_id=bin_id + bins, offset=offset + place_in * size)

    order = Window.partitionBy("length", "_salt").orderBy("_at")
    ranked = salted.withColumn("_row", F.row_number().over(order)).join(offsets, ["length", "_salt"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    return ranked.mapInPandas(place, PACKED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Documents as packed pieces: see `token_pieces` and `pack`."""
    return pack(token_pieces(docs, capacity, end_id, vocabulary), capacity)
