import random
import re
from collections import Counter

import duckdb
import pytest

from rowlore.llm.phrases import PHRASES_SQL, mine_phrases, tokens

SCHEMA = "doc_id long, text string, lang string, n long, score double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, top):
    found, words = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            own = re.findall("[^ \t]+", piece)
            words[lang] += len(own)
            found.update((lang, tuple(own[i : i + s])) for s in range(1, 5) for i in range(len(own) - s + 1))
    known = {k: n for k, n in found.items() if n >= min_count}
    out = []
    for (lang, p), a in known.items():
        if len(p) < 2:
            continue
        cuts = [(2000000 * a // (known[lang, p[:k]] + known[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        covers = (n for (other, q), n in known.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if not any(100 * n >= 80 * a for n in covers):
            out.append((lang, " ".join(p), a, known[lang, p[:k]], known[lang, p[k:]], words[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return Counter(ranked)


def rows_of(seed):
    pick = random.Random(seed)
    words = ["a", "B", "ab", "ä", "Ä", "日本", "x y", "c"]
    ends = [" ", " ", " ", "  ", "\t", ". ", "\n", "\r", "\x0b", "!", ";?"]
    text = lambda n: "".join(pick.choice(words[: pick.randint(1, 8)]) + pick.choice(ends) for _ in range(n))
    rows = [(i, text(pick.randint(0, 60)), pick.choice(["en", None, "und", ""]), 1, 0.5) for i in range(40)]
    return rows + [(None, None, "en", None, None), (1, "", None, 1, 1.0), (1, "  \n..", "en", 1, 1.0), (2, "a b " * 3000, "en", 0, 0.0), rows[0], rows[0]]


@pytest.mark.parametrize("options", [{}, {"run_tokens": 7}, {"run_tokens": 100, "bits": 5}, {"bits": 9}])
def test_equals_brute_force(spark, options):
    rows = rows_of(1)
    got = mine_phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 20, **options)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 4, 20)


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = mine_phrases(spark.read.parquet(f"{folder}/documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    cur = db.execute(PHRASES_SQL)
    assert [d[0] for d in cur.description] == got.columns
    want = Counter(cur.fetchall())
    assert want and Counter(tuple(r) for r in got.collect()) == want


def test_empty_and_rare(spark):
    assert mine_phrases(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mine_phrases(spark.createDataFrame([(1, "one two three", "en", 1, 1.0)], SCHEMA)).count() == 0


def test_words_of_a_text():
    assert tokens("A b\u0085C,d\x1ce\tÉ") == [b"a", "b\u0085c".encode(), b".", b"d\x1ce", "É".encode()]
