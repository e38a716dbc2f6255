"""Phrase collocations: Rabin-Karp fingerprints of word runs, counted by a shuffle, verified against the text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlore.llm.common import drop_old_shuffles, in_groups
from rowlore.plans.sizing import materialize

LONGEST = 4
MIN_COUNT = 30
COVERED_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
NO_LANG = "und"
# Tokens that a task holds as one run; memory is about a hundred bytes a token.
RUN_TOKENS = 1 << 21
BASE = 0x9E3779B97F4A7C15
# Pieces end at these bytes; a full stop marks the place. Words end at blanks and tabs.
MARKED = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b".........." )
RUNS = "run long, lang string, n_words long, own long, words binary, ids binary"
# A fingerprint's lowest bits are its size less one; it travels with a second one, of 32 bits, and a count in one number.
SIZE_BITS, COUNT_BITS, TASK_BITS = 2, 22, 32
PARTIAL = "fp long, check long, run long"
COUNTED = "lang string, size int, phrase string, n long"


def tokens(text: str) -> list[bytes]:
    """Words of one text, A-Z in lower case, with a full stop for each end of a piece."""
    return text.encode().lower().translate(MARKED).replace(b".", b" . ").split()


class Run:
    """Consecutive words as places in a list of distinct words (0: end of a piece), with prefix polynomials.

    Word sequences start at the first `own` places only; what follows belongs to
    the next run, too.
    """

    def __init__(self, row: dict, bits: int):
        import zstandard
        from xxhash import xxh3_128_digest, xxh64_intdigest

        unpack = zstandard.ZstdDecompressor().decompress
        self.run, self.lang, self.own = row["run"], row["lang"], row["own"]
        self.words = [b"."] + unpack(row["words"]).split(b" ")
        self.ids = np.frombuffer(unpack(row["ids"]), np.int32)
        self.mask = np.uint64((1 << bits) - 1 << SIZE_BITS)
        seed = xxh64_intdigest(self.lang.encode())
        hashes = np.frombuffer(bytes(16) + b"".join(xxh3_128_digest(w, seed) for w in self.words[1:]), np.uint64).reshape(-1, 2)
        power = np.full(len(self.ids), BASE, np.uint64)
        power[:1] = 1
        power = np.cumprod(power)
        # All arithmetic is modulo 2**64; an odd base has an inverse there.
        self.prefix = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(lane[self.ids] * power, dtype=np.uint64)]) for lane in hashes.T]
        power[1:] = pow(BASE, -1, 1 << 64)
        self.inverse = np.cumprod(power)
        self.ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(self.ids == 0, dtype=np.int32)])

    def _print(self, lane: int, at: np.ndarray, size: int) -> np.ndarray:
        prefix = self.prefix[lane]
        return (prefix[at + size] - prefix[at]) * self.inverse[at] + np.uint64(size)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, fingerprint) of every word sequence of this size within a piece."""
        starts = max(0, min(self.own, len(self.ids) - size + 1))
        at = np.flatnonzero(self.ends[size : size + starts] == self.ends[:starts])
        return at, self._print(0, at, size) & self.mask | np.uint64(size - 1)

    def _by_text(self, code: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        for k in range(size):
            code = np.unique(code * len(self.words) + self.ids[at + k], return_inverse=True)[1]
        return code

    def partial(self, size: int, at: np.ndarray, prints: np.ndarray) -> pa.Table:
        """Each text once: its fingerprint, a second one with its count, and the run that has it."""
        _, first, group, n = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        like = at[first[group]]
        if any((self.ids[at + k] != self.ids[like + k]).any() for k in range(size)):
            _, first, n = np.unique(self._by_text(group, at, size), return_index=True, return_counts=True)
        second = (self._print(1, at[first], size) >> np.uint64(32)).astype(np.int64)
        return pa.table({"fp": prints[first].view(np.int64), "check": second << COUNT_BITS | n, "run": np.full(len(first), self.run)})

    def places(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, fingerprint) of the sequences of this size that have one of the given fingerprints."""
        at, own = self.grams(size)
        kept = np.isin(own, prints[prints & np.uint64(LONGEST - 1) == size - 1])
        return at[kept], own[kept]

    def spelled(self, at: np.ndarray, size: int) -> tuple[list[str], np.ndarray]:
        """The distinct texts of the sequences at these places, and how often each is there."""
        _, first, n = np.unique(self._by_text(np.zeros(len(at), np.int64), at, size), return_index=True, return_counts=True)
        return [self.spell(p, size) for p in at[first]], n

    def spell(self, at: int, size: int) -> str:
        return b" ".join(self.words[i] for i in self.ids[at : at + size]).decode()


def _cut(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor().compress
        number = count(TaskContext.get().partitionId() << TASK_BITS)
        held: dict[str, tuple[dict, list[np.ndarray]]] = {}

        def new() -> tuple[dict, list[np.ndarray]]:
            known = defaultdict(count(1).__next__)
            known[b"."] = 0
            return known, []

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (known, parts) in held.items():
                words, whole = np.array(list(known), object), np.concatenate(parts)
                for first in range(0, len(whole), limit):
                    block = whole[first : first + limit + LONGEST - 1]
                    used, ids = np.unique(np.concatenate([[0], block]), return_inverse=True)
                    own = min(limit, len(whole) - first)
                    row = [next(number), lang, int(np.count_nonzero(block[:own])), own, pack(b" ".join(words[used[1:]])), pack(ids[1:].astype(np.int32).tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["run", "lang", "n_words", "own", "words", "ids"])
            held.clear()

        total = 0
        for batch in batches:
            for first, texts in in_groups(batch.column(1)):
                for lang, text in zip(batch.column(0).slice(first, len(texts)).to_pylist(), texts):
                    found = tokens(text)
                    if lang not in held:
                        held[lang] = new()
                    known, parts = held[lang]
                    parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                    parts.append(np.zeros(1, np.int32))
                    total += len(found) + 1
                    if total >= limit:
                        yield from flush()
                        total = 0
        yield from flush()

    return run


def _short(bits: int):
    """Fingerprints of all words and pairs of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Run(row, bits)
                for size in (1, 2):
                    yield from own.partial(size, *own.grams(size)).to_batches(1 << 16)

    return run


def _long(bits: int):
    """Fingerprints of the longer sequences all of whose pairs are frequent."""

    def run(runs: pa.Table, echo: pa.Table) -> pa.Table:
        own = Run(runs.to_pylist()[0], bits)
        pair = np.zeros(len(own.ids) + LONGEST, bool)
        pair[own.places(echo.column("fp").to_numpy().view(np.uint64), 2)[0]] = True
        pair[own.own :] = True  # pairs of the next run are unknown here
        tables = []
        for size in range(3, LONGEST + 1):
            at, prints = own.grams(size)
            likely = reduce(np.logical_and, [pair[at + k] for k in range(size - 1)])
            tables.append(own.partial(size, at[likely], prints[likely]))
        return pa.concat_tables(tables)

    return run


def _spell(bits: int):
    """Texts and counts of the fingerprints that a run spells: those it leads, by their total, and mixed ones, by its own count."""

    def run(runs: pa.Table, echo: pa.Table) -> pa.Table:
        own, tables = Run(runs.to_pylist()[0], bits), []
        prints, totals, mixed = (echo.column(c).to_numpy() for c in ("fp", "total", "mixed"))
        prints = prints.view(np.uint64)
        order = np.argsort(prints[~mixed])
        led, totals = prints[~mixed][order], totals[~mixed][order]
        for size in range(1, LONGEST + 1):
            at, found = own.places(led, size)
            found, first = np.unique(found, return_index=True)
            phrases, n = [own.spell(p, size) for p in at[first]], totals[np.searchsorted(led, found)]
            more, counts = own.spelled(own.places(prints[mixed], size)[0], size)
            columns = [[own.lang] * (len(n) + len(counts)), np.full(len(n) + len(counts), size, np.int32), phrases + more, np.concatenate([n, counts])]
            types = (pa.string(), pa.int32(), pa.string(), pa.int64())
            tables.append(pa.table({name: pa.array(c, t) for name, c, t in zip(("lang", "size", "phrase", "n"), columns, types)}))
        return pa.concat_tables(tables)

    return run


def _frequent(partial: DataFrame, min_count: int) -> DataFrame:
    """(run, fp, total, mixed, spells) of the fingerprints that all runs together have often enough.

    One run leads and will spell the text. A fingerprint is mixed if its second
    ones differ, so that it stands for several texts: then all its runs spell.
    """
    own = Window.partitionBy("fp")
    second = F.shiftright("check", COUNT_BITS)
    # Of the runs that have it; another one is first for each fingerprint, so all runs lead some.
    turn = F.col("run").bitwiseXOR(F.col("fp"))
    # Dealt first: what the window computes is added behind the shuffle.
    found = partial.repartition("fp").select(
        "run", "fp", F.sum(F.col("check").bitwiseAND((1 << COUNT_BITS) - 1)).over(own).alias("total"),
        (F.min(turn).over(own) == turn).alias("lead"), (F.min(second).over(own) < F.max(second).over(own)).alias("mixed"),
    )
    found = found.filter(F.col("total") >= min_count).withColumn("spells", F.col("lead") | F.col("mixed"))
    return found.select("run", "fp", F.when(F.col("spells"), F.col("total")).alias("total"), "mixed", "spells")


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, run_tokens: int = RUN_TOKENS, bits: int = 62) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all frequent phrases of 1 to 4 words, and (lang, n): all words of a language.

    Tasks cut their documents into runs, written once as numbers with their
    distinct words. A run sends each fingerprint once, with its count and a
    pointer to the run; runs learn which of their pairs are frequent
    in all. Phrases of three and four words are only sent if all their pairs are
    frequent, as those of frequent ones are. Last, texts are read off: one
    run spells a frequent fingerprint. Within a run all places of a
    fingerprint are compared word by word; between runs a second fingerprint (32
    bits beside the 62) must agree. Where either differs, all runs that have the fingerprint
    spell what it stands for and texts are counted instead, so `bits` (of the
    first one) changes no result. No table of phrases is broadcast, and a common phrase is one row a run.
    """
    if run_tokens > RUN_TOKENS:
        raise ValueError(f"a run has at most {RUN_TOKENS} tokens")
    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    runs = materialize(cut.mapInArrow(_cut(run_tokens), RUNS), "runs")
    keyed = runs.groupBy("run")
    short = _frequent(runs.mapInArrow(_short(bits), PARTIAL), min_count)
    pairs = F.col("fp").bitwiseAND(LONGEST - 1) == 1
    short = materialize(short.filter(pairs | F.col("spells")), "frequent")
    drop_old_shuffles(docs.sparkSession)
    longer = keyed.cogroup(short.filter(pairs).select("run", "fp").groupBy("run")).applyInArrow(_long(bits), PARTIAL)
    longer = materialize(_frequent(longer, min_count).filter("spells"), "frequent")
    drop_old_shuffles(docs.sparkSession)
    named = short.filter("spells").union(longer).select("run", "fp", "total", "mixed")
    spelled = keyed.cogroup(named.groupBy("run")).applyInArrow(_spell(bits), COUNTED)
    known = spelled.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
    return materialize(known, "phrases"), runs.groupBy("lang").agg(F.sum("n_words").alias("n"))


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def score_phrases(known: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of each phrase of two words or more, by its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = known.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("_w"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.expr("array_join(slice(_w, 1, k), ' ')").alias("_left"), F.expr("array_join(slice(_w, k + 1, size - k), ' ')").alias("_right"))
    parts = known.select("lang", F.col("phrase").alias("_part"), "f")
    left = parts.select("lang", F.col("_part").alias("_left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("_part").alias("_right"), F.col("f").alias("r"))
    met = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
    met = met.withColumn("_a", _exact("a") * F.lit(SCALE).cast("decimal(7,0)")).withColumn("_lr", _exact("l") + _exact("r"))
    best = met.groupBy("lang", "phrase", "size").agg(F.min(F.expr("struct(cast(_a div _lr AS bigint) AS score, k, a, l, r)")).alias("_best"))
    return best.select("lang", "phrase", "size", "_best.a", "_best.l", "_best.r", "_best.score")


def without_covered(phrases: DataFrame, known: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """The phrases that no frequent phrase one word longer, at either end, has `percent` of the occurrences of.

    Longer covers need no look: what lies between occurs at least as often as they do.
    """
    ends = F.array(*[F.expr(f"array_join(slice(_w, {first}, size - 1), ' ')") for first in (1, 2)])
    longer = known.filter("size >= 3").withColumn("_w", F.split("phrase", " ")).select("lang", "f", F.explode(ends).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_most"))
    met = phrases.join(most, ["lang", "phrase"], "left")
    covered = _exact("_most") * F.lit(100).cast("decimal(3,0)") >= _exact("a") * F.lit(percent).cast("decimal(3,0)")
    return met.filter(F.col("_most").isNull() | ~covered).drop("_most")


def mine_phrases(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, run_tokens: int = RUN_TOKENS, bits: int = 62) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` collocations.

    A null text is empty, a null lang is `und`; repeated rows count each time; other
    columns, doc_id included, are ignored. Ties of score go to the more frequent,
    then to the phrase first in byte order. A language without frequent phrases has
    no row, an empty table gives none. Texts of any length are cut into runs that overlap by three words.
    """
    known, totals = count_phrases(docs, min_count, run_tokens, bits)
    left = without_covered(score_phrases(known), known)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Best of each slice of a language first: no task sorts a whole language.
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = left.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    sliced = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).filter(F.col("_rank") <= top)
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
places AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(size)),
known AS MATERIALIZED (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM known WHERE size >= 2),
scored AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.k], ' ')
  JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1 : c.size], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, f, size, string_split(phrase, ' ') AS ws, unnest(range(2, size)) AS part FROM known WHERE size >= 3),
parts AS (SELECT lang, f, ws, part, unnest(range(1, size - part + 2)) AS i FROM spans),
most AS (SELECT lang, array_to_string(ws[i : i + part - 1], ' ') AS phrase, max(f) AS f FROM parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.f IS NULL OR 100::HUGEINT * m.f < 80::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""
