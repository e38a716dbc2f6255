"""Line de-duplication over an index that grows and shrinks: sharded cuckoo filters, exact reference counts behind them."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlore.llm.common import in_groups
from rowlore.plans.sizing import materialize, scratch_dir

MIN_POINTS = 10
BLANK = b" \t\n\x0b\x0c\r"
# Rows without doc_id are one document behind all others.
NO_ID = (1 << 63) - 1
# Copies of a key that a filter holds: one for a key of one document, two for a repeated key.
COPIES = 2
SLOTS = 4
KICKS = 200
SHARD_KEYS = 1 << 14
KEYED = "doc_id long, row long, k1 long, k2 long"
FILTERS = "shard long, slots binary, stash binary"


def line_key(line: bytes) -> bytes | None:
    """A line without blanks at its ends, A-Z in lower case; null if it has too few code points."""
    key = line.strip(BLANK).lower()
    if len(key) < MIN_POINTS or len(key) < 4 * MIN_POINTS and len(key.decode()) < MIN_POINTS:
        return None
    return key


def digest(key: bytes) -> bytes:
    """16 bytes that stand for a key everywhere."""
    return blake2b(key, digest_size=16).digest()


class Cuckoo:
    """A cuckoo filter of 16-bit marks in buckets of four slots; many keys at once.

    A key has two buckets, each of which follows from the other and the mark. Equal
    keys may be added more than once. Marks that find no slot after KICKS rounds
    of moving others wait in `stash`, so nothing that was added is ever missed.
    """

    def __init__(self, slots: np.ndarray, stash: np.ndarray):
        self.slots, self.stash = slots, stash

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mark.astype(np.int64) * 0x5BD1E995 & len(self.slots) - 1)

    def _homes(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = np.maximum(key >> 48 & 0xFFFF, 1).astype(np.uint16)
        return key & len(self.slots) - 1, mark

    def _code(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return np.minimum(bucket, self._other(bucket, mark)) << 16 | mark

    def count(self, key: np.ndarray) -> np.ndarray:
        """How many copies of each key are there: never too few, more if other keys share its mark and buckets."""
        one, mark = self._homes(key)
        two = self._other(one, mark)
        found = (self.slots[one] == mark[:, None]).sum(1) + np.where(two != one, (self.slots[two] == mark[:, None]).sum(1), 0)
        code = self._code(one, mark)
        return found + np.searchsorted(self.stash, code, "right") - np.searchsorted(self.stash, code, "left")

    def _place(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Fill free slots; true where there was none."""
        order = np.argsort(bucket, kind="stable")
        own = bucket[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        free = self.slots[own] == 0
        slot = np.argmax(free.cumsum(1) == rank[:, None] + 1, axis=1)
        fits = rank < free.sum(1)
        self.slots[own[fits], slot[fits]] = mark[order][fits]
        left = np.ones(len(bucket), bool)
        left[order[fits]] = False
        return left

    def add(self, key: np.ndarray) -> None:
        bucket, mark = self._homes(key)
        for kick in range(KICKS):
            left = self._place(bucket, mark)
            bucket, mark = self._other(bucket[left], mark[left]), mark[left]
            left = self._place(bucket, mark)
            bucket, mark = bucket[left], mark[left]
            if not len(bucket):
                return
            # One mark of each full bucket makes room and goes to its own other bucket.
            _, first = np.unique(bucket, return_index=True)
            slot = (mark[first] + kick) % SLOTS
            moved = self.slots[bucket[first], slot]
            self.slots[bucket[first], slot] = mark[first]
            mark[first] = moved
            bucket[first] = self._other(bucket[first], moved)
        self.stash = np.sort(np.concatenate([self.stash, self._code(bucket, mark)]))

    def remove(self, key: np.ndarray) -> None:
        """Take out one copy for each key given; each must have been added."""
        one, mark = self._homes(key)
        while len(one):
            code = self._code(one, mark)
            _, first = np.unique(code, return_index=True)
            gone = np.zeros(len(first), bool)
            for bucket in (one[first], self._other(one[first], mark[first])):
                here = (self.slots[bucket] == mark[first][:, None]) & ~gone[:, None]
                at = np.flatnonzero(here.any(1))
                self.slots[bucket[at], here[at].argmax(1)] = 0
                gone[at] = True
            places = np.searchsorted(self.stash, code[first][~gone])
            if len(places) and (len(self.stash) == 0 or not np.array_equal(self.stash[np.minimum(places, len(self.stash) - 1)], code[first][~gone])):
                raise ValueError("a key is taken out that was never added")
            self.stash = np.delete(self.stash, places)
            rest = np.ones(len(one), bool)
            rest[first] = False
            one, mark = one[rest], mark[rest]


def _load(filters: pa.Table, buckets: int) -> Cuckoo:
    if not filters.num_rows:
        return Cuckoo(np.zeros((buckets, SLOTS), np.uint16), np.zeros(0, np.int64))
    slots, stash = (filters.column(name)[0].as_py() for name in ("slots", "stash"))
    return Cuckoo(np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(stash, np.int64).copy())


def _probe(buckets: int):
    def run(keys: pa.Table, filters: pa.Table) -> pa.Table:
        found = _load(filters, buckets).count(keys.column("k2").to_numpy())
        return pa.table({"k1": keys.column("k1"), "k2": keys.column("k2"), "copies": pa.array(found.astype(np.int64))})

    return run


def _update(buckets: int):
    """The filter of a shard after its keys' counts changed from `old` by `n`."""

    def run(shard: tuple, changes: pa.Table, filters: pa.Table) -> pa.Table:
        own = _load(filters, buckets)
        key, old, n = (changes.column(name).to_numpy() for name in ("k2", "old", "n"))
        more = np.minimum(old + n, COPIES) - np.minimum(old, COPIES)
        own.remove(np.repeat(key, np.maximum(-more, 0)))
        own.add(np.repeat(key, np.maximum(more, 0)))
        return pa.table({"shard": [shard[0].as_py()], "slots": [own.slots.tobytes()], "stash": [own.stash.tobytes()]})

    return run


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each row."""
    for batch in batches:
        for first, texts in in_groups(batch.column(2)):
            found = [{digest(k) for line in t.encode().split(b"\n") if (k := line_key(line)) is not None} for t in texts]
            at = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            keys = np.frombuffer(b"".join(d for f in found for d in f), np.int64).reshape(-1, 2)
            own = [batch.column(i).slice(first, len(texts)).take(pa.array(at)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["doc_id", "row", "k1", "k2"])


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text that tells rows of one document apart, and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _keyed(docs: DataFrame) -> DataFrame:
    return _named(docs).mapInArrow(_lines_of, KEYED)


class LineIndex:
    """Which documents hold which lines, in a folder all executors share.

    Each change appends one version: the references (key, doc_id) that it adds, or
    the ids that it takes out, what it adds to the exact count of each key, and the
    filters as they are then. A version counts once its commit is written, so a
    change that fails half-way leaves the index as it was and may be tried again. Filters
    are cut into shards by key and hold a key once, or twice if several documents
    have it: what they rule out needs no look at the exact tables, what they do not
    rule out is decided by those. Shards are made anew, from the counts, when
    there are too many keys for them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._read_state()

    def _read_state(self) -> None:
        self.version, self.shards, self.buckets, self.keys = 0, 0, 0, 0
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(root):
            last = self.spark.read.schema("version long, shards long, buckets long, keys long").parquet(f"{self.path}/commits").orderBy(F.desc("version")).first()
            if last:
                self.version, self.shards, self.buckets, self.keys = last

    def _table(self, name: str, schema: str, since: int = 1) -> DataFrame:
        """All committed rows of one of the index's tables."""
        kept = F.col("version").between(since, self.version)
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(kept)

    @property
    def references(self) -> DataFrame:
        """(k1, k2, doc_id) of every key that a document of the index holds."""
        gone = self._table("gone", "doc_id long, version long").groupBy("doc_id").agg(F.max("version").alias("_gone"))
        held = self._table("references", "k1 long, k2 long, doc_id long, version long")
        held = held.join(gone, "doc_id", "left").filter("_gone IS NULL OR _gone < version")
        return held.select("k1", "k2", "doc_id")

    @property
    def counts(self) -> DataFrame:
        """(k1, k2, n_docs): the exact number of documents that hold each key."""
        held = self._table("counts", "k1 long, k2 long, n long, version long").groupBy("k1", "k2").agg(F.sum("n").alias("n_docs"))
        return held.filter("n_docs > 0")

    @property
    def filters(self) -> DataFrame:
        return self._table("filters", f"{FILTERS}, version long", self.version).drop("version")

    def _shard(self) -> Column:
        return F.pmod("k1", F.lit(self.shards))

    def probe(self, keys: DataFrame) -> DataFrame:
        """(k1, k2, copies) of distinct keys, by the filters alone."""
        if not self.version:
            return keys.select("k1", "k2", F.lit(0).cast("long").alias("copies"))
        left = keys.select("k1", "k2").withColumn("shard", self._shard()).groupBy("shard")
        return left.cogroup(self.filters.groupBy("shard")).applyInArrow(_probe(self.buckets), "k1 long, k2 long, copies long")

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}/version={self.version + 1}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _commit(self, changes: DataFrame, suspects: DataFrame) -> None:
        """Add one version with `changes` (k1, k2, n); `suspects` are those whose key may have a count already."""
        changes = self._write(changes, "counts")
        before = self.counts.join(suspects, ["k1", "k2"], "left_semi")
        changes = materialize(changes.join(before, ["k1", "k2"], "left").select("k1", "k2", "n", F.coalesce("n_docs", F.lit(0)).cast("long").alias("old")), "changes")
        entering = changes.filter("old = 0 AND n > 0").count() - changes.filter("old > 0 AND old + n = 0").count()
        keys = self.keys + entering
        filters, rows = self.filters, changes
        if keys > self.shards * self.buckets * SLOTS * 3 // (4 * COPIES):
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.shards = 1 << int(max(4 * parts, 2 * keys // SHARD_KEYS) - 1).bit_length()
            self.buckets = 1 << int(max(16, 4 * keys // (3 * self.shards))).bit_length()
            filters = self.spark.createDataFrame([], FILTERS)
            whole = self.counts.select("k1", "k2", F.col("n_docs").alias("n")).union(changes.select("k1", "k2", "n"))
            rows = whole.groupBy("k1", "k2").agg(F.sum("n").alias("n")).filter("n > 0").withColumn("old", F.lit(0).cast("long"))
        left = rows.withColumn("shard", self._shard()).groupBy("shard")
        self._write(left.cogroup(filters.groupBy("shard")).applyInArrow(_update(self.buckets), FILTERS), "filters")
        state = [(self.version + 1, self.shards, self.buckets, keys)]
        self.spark.createDataFrame(state, "version long, shards long, buckets long, keys long").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self._read_state()

    def insert(self, docs: DataFrame) -> None:
        """Add the lines of documents (doc_id, text); what a document of the index has already, adds nothing."""
        added = materialize(_keyed(docs).groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("_n")).drop("_n"), "added")
        suspects = materialize(self.probe(added.select("k1", "k2").distinct()).filter("copies > 0").select("k1", "k2"), "suspects")
        if self.version:
            here = self.references.join(suspects, ["k1", "k2"], "left_semi")
            added = added.join(here, ["k1", "k2", "doc_id"], "left_anti")
        added = self._write(added, "references")
        self._write(self.spark.createDataFrame([], "doc_id long"), "gone")
        self._commit(added.groupBy("k1", "k2").agg(F.count("*").alias("n")), suspects)

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents with these doc_id, as if they had never been added; others are passed over."""
        if not self.version:
            return
        ids = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
        leaving = self.references.join(ids, "doc_id", "left_semi").groupBy("k1", "k2").agg((-F.count("*")).alias("n"))
        leaving = materialize(leaving, "leaving")
        self._write(self.spark.createDataFrame([], "k1 long, k2 long, doc_id long"), "references")
        self._write(ids, "gone")
        self._commit(leaving, leaving.select("k1", "k2"))

    def first_holders(self, keys: DataFrame) -> DataFrame:
        """(k1, k2, first): the smallest doc_id of each of these distinct keys that several documents hold."""
        likely = self.probe(keys).filter(F.col("copies") >= COPIES).select("k1", "k2")
        repeated = self.counts.filter("n_docs > 1").join(likely, ["k1", "k2"], "left_semi").select("k1", "k2")
        # Reduced to one row a key before the join, and written, so that a join with it can split a common key.
        first = self.references.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
        return materialize(first.join(repeated, ["k1", "k2"], "left_semi"), "first")

    def without_repeats(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, n_lines, n_dropped) of documents of the index: lines that a smaller doc_id holds are left out.

        A line goes wherever its key has a holder with a smaller doc_id in the index, the
        documents of `docs` or others. Lines are compared without blanks at their ends and A-Z
        in lower case; shorter keys than ten code points stay. A null text is empty and
        has one empty line. Rows of one doc_id are one document and all keep its lines, rows
        without doc_id are one document behind all others. Other columns are ignored.
        """
        keyed = materialize(_keyed(docs), "keyed")
        first = self.first_holders(keyed.select("k1", "k2").distinct())
        late = keyed.join(first, ["k1", "k2"]).filter("doc_id > first")
        late = late.groupBy("doc_id", "row").agg(F.collect_set(F.struct("k1", "k2")).alias("late"))
        met = _named(docs).join(late, ["doc_id", "row"], "left")
        met = met.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.col("late.k1").alias("k1"), F.col("late.k2").alias("k2"))
        return met.mapInArrow(_drop, "doc_id long, text string, n_lines long, n_dropped long")


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in in_groups(batch.column(1)):
            out = []
            for text, k1, k2 in zip(texts, *(batch.column(i).slice(first, len(texts)) for i in (2, 3))):
                lines = text.split("\n")
                if not k1.is_valid:
                    out.append((text, len(lines), 0))
                    continue
                late = set(np.stack([k.values.to_numpy() for k in (k1, k2)], 1).view("V16").ravel().tolist())
                kept = [line for line in lines if (k := line_key(line.encode())) is None or digest(k) not in late]
                out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *columns], names=["doc_id", "text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All documents put into an index, new unless there is one at `path`, and their repeated lines dropped."""
    spark = docs.sparkSession
    index = LineIndex(spark, path or scratch_dir(spark, "lines"))
    index.insert(docs)
    return index.without_repeats(docs)


LINES_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM texts),
keyed AS (SELECT *, coalesce(doc_id, 9223372036854775807) AS own,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(own) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT own) >= 2),
marked AS (SELECT k.*, coalesce(own > first, false) AS late FROM keyed k LEFT JOIN firsts USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (late) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT late), '')) AS kept_sha256 FROM marked GROUP BY r
"""
