"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlore.llm.common import ChunkTable, in_groups

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_MODELS: dict = {}


class PieceModel:
    """A model whose pieces stay within a marked word, with its table of distinct words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.local = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.normalize("a") == f"{MARK}a"
        self.mark_id = self.model.piece_to_id(MARK)
        self.table = ChunkTable(self._words)

    def _words(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids, as decimal text, and decoded text of each marked word."""
        # The library puts one marker before a text; a lone marker would be an empty text.
        ids = [i if c != MARK else [self.mark_id] for c, i in zip(chunks, self.model.encode([c[1:] for c in chunks], num_threads=1))]
        texts = self.model.decode(ids) if ids else []
        return [(",".join(map(str, i)).encode(), (" " + t).encode()) for i, t in zip(ids, texts)]

    def run(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as decimal text, decoded text) of each text."""
        if not self.local:
            ids = self.model.encode(texts, num_threads=1)
            yield from ((",".join(map(str, i)).encode(), t.encode()) for i, t in zip(ids, self.model.decode(ids) if ids else []))
            return
        cut = [CHUNK.findall(t) for t in self.model.normalize(texts)] if texts else []
        known = self.table.load(cut)
        for chunks in cut:
            found = [known[c] for c in chunks]
            yield b",".join([f[0] for f in found]), b"".join([f[1] for f in found])[1:]


def _model(path: str | None) -> PieceModel:
    if path not in _MODELS:
        import public_tokenizers

        _MODELS[path] = PieceModel(path or public_tokenizers.path(MODEL))
    return _MODELS[path]


def encode_decode(docs: DataFrame, model: str | None = None, with_values: bool = False) -> DataFrame:
    """Ids and decoded text of each document: their number and digests, or the values too.

    No piece of the vocabulary continues past a white-space marker, so a marked
    word has the same ids wherever it stands: each distinct one is segmented once
    per worker (once more after its table was full, or if it is very long), and a document's ids are those of its words in order. A model
    with pieces across markers is applied to whole texts instead. A null text is
    empty and has no ids. Rows are kept as they are, with equal or null doc_id;
    other columns are ignored.
    """
    schema = ENCODED + (", ids array<int>, decoded string" if with_values else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in batches:
            for first, texts in in_groups(batch.column(1)):
                found = list(own.run(texts))
                columns = [
                    batch.column(0).slice(first, len(texts)),
                    pa.array([ids.count(b",") + 1 if ids else 0 for ids, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found]),
                    pa.array([hashlib.sha256(text).hexdigest() for _, text in found]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_values:
                    columns.append(pa.array([[int(i) for i in ids.split(b",")] if ids else [] for ids, _ in found], pa.list_(pa.int32())))
                    columns.append(pa.array([text.decode() for _, text in found], pa.string()))
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, schema)
