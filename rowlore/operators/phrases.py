"""Which of many known phrases a text's words hold, by one automaton walk per text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlore.plans.sizing import BROADCAST_BYTES, BROADCAST_ROWS, materialize, measured

# Phrases of one block, and texts that one task walks with it, when phrases are too many for every task.
BLOCK_PHRASES = 50_000
BLOCK_TEXTS = 20_000
# A phrase start shared by more phrases than this is dealt over several blocks.
HOT_START = 5_000


class PhraseAutomaton:
    """A trie over words with failure links: all phrases in a list of words in one walk.

    Phrases belong to scopes; those of one scope are found in texts of that scope only.
    """

    def __init__(self, phrases: Iterator[tuple[str, tuple[str, ...], int]]):
        self.next: list[dict[str, int]] = []
        self.ends: list[list[int]] = []
        self.roots: dict[str, int] = {}
        for scope, phrase, number in phrases:
            at = self.roots[scope] if scope in self.roots else self.roots.setdefault(scope, self._state())
            for word in phrase:
                at = self.next[at][word] if word in self.next[at] else self.next[at].setdefault(word, self._state())
            self.ends[at].append(number)
        self.fail, self.shorter = [0] * len(self.next), [-1] * len(self.next)
        for root in self.roots.values():
            self._link(root)

    def _state(self) -> int:
        self.next.append({})
        self.ends.append([])
        return len(self.next) - 1

    def _link(self, root: int) -> None:
        """Breadth first: where to go on when no phrase goes on, and the next shorter phrase that ends there."""
        self.fail[root] = root
        waiting = deque([root])
        while waiting:
            at = waiting.popleft()
            for word, to in self.next[at].items():
                back = self.fail[at]
                while back != root and word not in self.next[back]:
                    back = self.fail[back]
                back = self.next[back][word] if at != root and word in self.next[back] else root
                self.fail[to] = back
                self.shorter[to] = back if self.ends[back] else self.shorter[back]
                waiting.append(to)

    def found(self, scope: str, text: list[str]) -> set[int]:
        """Numbers of the phrases that stand in these words."""
        out: set[int] = set()
        root = self.roots.get(scope)
        if root is None:
            return out
        at = root
        for word in text:
            while at != root and word not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(word, root)
            end = at if self.ends[at] else self.shorter[at]
            while end >= 0:
                out.update(self.ends[end])
                end = self.shorter[end]
        return out


def _automaton(phrases: pa.Table, scope: str) -> PhraseAutomaton:
    columns = (phrases.column(c).to_pylist() for c in (scope, "words", "number"))
    return PhraseAutomaton((s, tuple(w), n) for s, w, n in zip(*columns))


def _walk(texts: pa.RecordBatch | pa.Table, automaton: PhraseAutomaton, scope: str) -> list[tuple[int, int]]:
    rows = zip(*(texts.column(c).to_pylist() for c in ("text", scope, "words")))
    return [(text, number) for text, s, words in rows for number in automaton.found(s, words or [])]


MET = "text long, number long"


def _met(pairs: list[tuple[int, int]]) -> pa.Table:
    text, number = zip(*pairs) if pairs else ((), ())
    return pa.table({"text": pa.array(text, pa.int64()), "number": pa.array(number, pa.int64())})


def phrase_matches(texts: DataFrame, phrases: DataFrame, scope: str, max_phrases: int = BROADCAST_ROWS) -> DataFrame:
    """`texts` (question_id, scope, words) with every phrase (scope, words, and what else) their words hold in a row.

    Texts and phrases travel as numbers. Up to `max_phrases`, and a measured size, the phrases are one
    automaton in every task. Beyond, they are cut into blocks by their first
    word; a text goes to the blocks of its own words, once to each. A first word of many
    phrases has several blocks, so no block grows with it, and a block's texts are cut into groups.
    """
    texts = materialize(texts.withColumn("text", F.monotonically_increasing_id()), "texts")
    phrases = materialize(phrases.withColumn("number", F.monotonically_increasing_id()), "known")
    plain = phrases.select(scope, "words", "number").where(F.col(scope).isNotNull())
    walked = texts.select("text", scope, "words").where(F.col(scope).isNotNull())
    rows, size = measured(plain, max_phrases)
    if rows <= max_phrases and size <= BROADCAST_BYTES:
        shared = texts.sparkSession.sparkContext.broadcast(_automaton(plain.toArrow(), scope))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _met(_walk(batch, shared.value, scope)).to_batches()

        met = walked.mapInArrow(run, MET)
    else:
        met = _in_blocks(walked, plain, scope)
    named = met.join(phrases.drop(scope, "words"), "number")
    return named.join(texts.drop("words"), "text").drop("text", "number")


def _in_blocks(texts: DataFrame, phrases: DataFrame, scope: str) -> DataFrame:
    start = F.get("words", F.lit(0)).alias("_start")
    blocks = max(1, phrases.count() // BLOCK_PHRASES)
    starts = phrases.select(scope, start).groupBy(scope, "_start").agg(F.ceil(F.count("*") / HOT_START).cast("int").alias("_parts"))
    starts = materialize(starts, "starts")
    block = lambda part: F.pmod(F.xxhash64(scope, "_start", part), F.lit(blocks)).alias("b")
    dealt = phrases.select("*", start).join(starts, [scope, "_start"]).select(scope, "words", "number", block(F.pmod(F.xxhash64("number"), "_parts").cast("int")))
    parts = starts.select(scope, "_start", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")).select(scope, "_start", block(F.col("_part"))).distinct()
    asked = texts.select("text", scope, F.explode(F.array_distinct("words")).alias("_start")).join(parts, [scope, "_start"])
    asked = asked.select("text", "b").distinct()
    # Texts of a block are walked in groups, each with the block's phrases.
    sizes = asked.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("_groups"))
    sizes = materialize(sizes, "sizes")
    group = F.pmod(F.xxhash64("text"), "_groups").cast("int").alias("g")
    left = asked.join(sizes, "b").select("text", "b", group).join(texts, "text")
    right = dealt.join(sizes, "b").select("*", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("g"))

    def run(walked: pa.Table, known: pa.Table) -> pa.Table:
        return _met(_walk(walked, _automaton(known, scope), scope) if walked.num_rows else [])

    return left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(run, MET)
