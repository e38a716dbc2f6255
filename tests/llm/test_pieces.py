import hashlib
import random

import public_tokenizers
import pyarrow as pa
import sentencepiece

from rowlore.llm.common import in_groups
from rowlore.llm.pieces import PieceModel, encode_decode

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "the", "<s>", "</s>", "<unk>", "<0x0A>", "日本", "😀", "　", "\x00", "ﬁ", "́", "'s", "."]


def texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(16))) for _ in range(n)]


def test_words_keep_the_library_ids():
    own = texts(4000)
    model = PieceModel(PATH)
    model.table.limit = 50
    for i in range(0, len(own), 100):
        part = own[i : i + 100]
        ids = MODEL.encode(part)
        assert list(model.run(part)) == [(",".join(map(str, x)).encode(), MODEL.decode(x).encode()) for x in ids]
    model.local = False
    assert [t for _, t in model.run(own[:50])] == [MODEL.decode(x).encode() for x in MODEL.encode(own[:50])]


def test_rows_equal_the_library(spark):
    own = [None, "", *texts(60), "word " * 60_000]
    docs = spark.createDataFrame([(i // 2, t, "en", "s", 0) for i, t in enumerate(own)] + [(None, "x", None, None, None)], DOCS)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encode_decode(docs).filter("doc_id is not null").collect())
    want = []
    for i, text in enumerate(own):
        ids = MODEL.encode(text or "")
        want.append((i // 2, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    row = encode_decode(docs.filter("doc_id is null"), with_values=True).first()
    assert row["ids"] == MODEL.encode("x") and row["decoded"] == "x"
    assert encode_decode(docs.limit(0)).count() == 0


def test_table_is_bounded_by_bytes(monkeypatch):
    """Texts without blanks are not kept, and the words that are take no more than the bound."""
    model = PieceModel(PATH)
    rng = random.Random(9)
    for _ in range(20):
        texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000)) for _ in range(10)]
        assert [t for _, t in model.run(texts)] == [MODEL.decode(x).encode() for x in MODEL.encode(texts)]
    assert model.table.held < 20 * 10 * 1000 and len(model.table.values) <= 10
    model.table.limit = 50_000
    for _ in range(40):
        texts = [" ".join(str(rng.randrange(10**6)) for _ in range(100))]
        assert [t for _, t in model.run(texts)] == [MODEL.decode(x).encode() for x in MODEL.encode(texts)]
        assert model.table.held < 50_000 + 100 * 400


def test_groups_of_texts_are_bounded(monkeypatch):
    monkeypatch.setattr("rowlore.llm.common.GROUP_BYTES", 100)
    texts = pa.array(["x" * 60, None, "", "é" * 20, "y" * 500, "z"] + ["a"] * 700)
    groups = list(in_groups(texts))
    assert [t for _, g in groups for t in g] == [t or "" for t in texts.to_pylist()] and all(len(g) == 1 or sum(map(len, g)) <= 100 for _, g in groups)
    assert [f for f, _ in groups][0] == 0 and list(in_groups(pa.array([], pa.string()))) == []
