"""SimHash fingerprints, linked through the code words of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlore.llm.components import LINKS, components, roots
from rowlore.plans.sizing import broadcast_if_small, materialize

SHINGLE = 3
THRESHOLD = 3
SEED = 42
# Anchors are the words of the perfect one-error code of length 31: every 31 bits
# are within RADIUS of exactly one.
LENGTH = 31
RADIUS = 1
# Keys of more fingerprints than this are split by blocks of the bits that they say nothing of.
HOT = 20_000
PAIRS = 1 << 21


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, unsigned.

    Words of the text, A-Z in lower case, give shingles of three; fewer words are
    one shingle, none give zero. A bit is set if over half of the hashes set it.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fingerprint as a signed long) of every row; a null text counts as empty, `row` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "row", "fingerprint"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), _row_hash(text), text).mapInArrow(run, "doc_id long, row long, fingerprint long")


def _row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _syndromes(bits: np.ndarray) -> np.ndarray:
    """The exclusive-or of the places (1 to 31) of set bits: zero for code words."""
    out = np.zeros(len(bits), np.uint64)
    for place in range(1, LENGTH + 1):
        out ^= (bits >> np.uint64(place - 1) & np.uint64(1)) * np.uint64(place)
    return out


def _pairs_of() -> np.ndarray:
    """For each syndrome, the two-bit patterns whose places have it as exclusive-or."""
    table = np.zeros((LENGTH + 1, (LENGTH - 1) // 2), np.uint64)
    for s in range(1, LENGTH + 1):
        pairs = [(i, i ^ s) for i in range(1, LENGTH + 1) if i < i ^ s and i != s and i ^ s != s and i ^ s <= LENGTH]
        table[s] = [1 << (i - 1) | 1 << (j - 1) for i, j in pairs]
    return table


def anchors(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, anchor, home) of 64-bit fingerprints: all anchors within two bits, half by half.

    Of at most three differing bits, one half of 32 has at most one. There the
    nearest anchor of one fingerprint, its home, is within the covering radius
    plus one of the other: so each pair meets at a home, over 31 bits of a half.
    """
    two = _pairs_of()
    every = np.arange(len(prints))
    for half in range(2):
        bits = prints >> np.uint64(32 * half) & np.uint64((1 << LENGTH) - 1)
        place = _syndromes(bits)
        label = np.uint64(half << 32)
        wrong = place > 0
        flip = np.where(wrong, np.uint64(1) << np.maximum(place, np.uint64(1)) - np.uint64(1), np.uint64(0))
        yield every, (bits ^ flip) | label, True
        off = every[wrong]
        for k in range(two.shape[1]):
            yield off, (bits[off] ^ two[place[off].astype(np.int64), k]) | label, False


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = batch.column(0).to_numpy()
        for rows, anchor, home in anchors(signed.view(np.uint64)):
            columns = [pa.array(anchor.view(np.int64)), pa.array(signed[rows]), pa.array(np.full(len(rows), home))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "fingerprint", "home"])


def near_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links of at most THRESHOLD bits connect, fewer than fingerprints.

    Each reached fingerprint is compared with those not reached yet, so a dense
    group is done after a few rounds.
    """
    left, parent, child = np.arange(len(prints)), [], []
    while len(left) > 1:
        reached = [left[0]]
        left = left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= THRESHOLD
            if near.any():
                parent.append(np.full(int(near.sum()), at))
                child.append(left[near])
                reached.extend(left[near])
                left = left[~near]
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(parent or empty), np.concatenate(child or empty)


def _compare(key: np.ndarray, prints: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of each key; equal keys stand together.

    Small groups: their homes against all members, many groups at once. Large
    ones: `near_links`.
    """
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.append(first, len(key)))
    group = np.repeat(np.arange(len(first)), size)
    homes = np.bincount(group, weights=home, minlength=len(first)).astype(np.int64)
    left, right = [], []
    for g in np.flatnonzero((size > 64) & (homes > 0)):
        own = prints[first[g] : first[g] + size[g]]
        a, b = near_links(own)
        left.append(own[a])
        right.append(own[b])
    rows = np.flatnonzero(home & (size[group] > 1) & (size[group] <= 64))
    for i in range(0, len(rows), PAIRS // 64):
        part = rows[i : i + PAIRS // 64]
        many = size[group[part]]
        a = np.repeat(part, many)
        b = np.repeat(first[group[part]], many) + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        near = (a != b) & (np.bitwise_count(prints[a] ^ prints[b]) <= THRESHOLD)
        left.append(prints[a[near]])
        right.append(prints[b[near]])
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the keys of a task; rows come sorted by key, and a key may cross batches."""

    def links(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        a, b = _compare(columns[0], columns[1].view(np.uint64), columns[2])
        nodes, root = roots(a.view(np.int64), b.view(np.int64))
        own = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], names=["src", "dst"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(now[0]):
            continue
        # The last key of the batch waits for the rest of its rows.
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or (held and held[0][0][-1] != now[0][0]):
            whole = tuple(np.concatenate(c) for c in zip(*held, tuple(c[:cut] for c in now)))
            if len(whole[0]):
                yield links(whole)
            held = []
        held.append(tuple(c[cut:] for c in now))
    if held:
        yield links(tuple(np.concatenate(c) for c in zip(*held)))


def _crowded(dealt: DataFrame, hot: int) -> DataFrame | None:
    """Keys of more than `hot` rows, few as they are; None without any."""
    found = materialize(dealt.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select("key"), "crowded")
    return None if found.isEmpty() else broadcast_if_small(found)


def _by_blocks(dealt: DataFrame, rest: Column, width: int) -> DataFrame:
    """Each row under the four values of its free bits: three differing bits leave one of the four blocks alike.

    `free` becomes the bits of the other three blocks.
    """
    block = lambda i: F.shiftright(rest, i * width).bitwiseAND(F.lit((1 << width) - 1))
    below = lambda i: rest.bitwiseAND(F.lit((1 << i * width) - 1))
    above = lambda i: F.shiftleft(F.shiftright(rest, (i + 1) * width), i * width)
    blocks = F.array(*[F.struct(F.xxhash64("key", F.lit(i), block(i)).alias("key"), below(i).bitwiseOR(above(i)).alias("free")) for i in range(4)])
    return dealt.select("fingerprint", F.explode(blocks).alias("_b")).select("_b.key", "fingerprint", F.lit(True).alias("home"), "_b.free")


def dealt_by_anchor(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, fingerprint, home): all fingerprints that are compared with each other share a key.

    Fingerprints are dealt by anchor. One near to more than `hot` of them is split
    by the half that it says nothing of: two fingerprints differ in at most three of those 32
    bits, so they share one of its four blocks of 8. A key that is still crowded is split
    again, by four blocks of 6 of the other 24 bits.
    """
    spread = prints.select(F.col("fingerprint").cast("long")).mapInArrow(_replicate, "anchor long, fingerprint long, home boolean")
    # The label of an anchor's half stands above its bits.
    other = F.when(F.col("anchor") >= 1 << 32, F.col("fingerprint").bitwiseAND(F.lit((1 << 32) - 1))).otherwise(F.shiftrightunsigned("fingerprint", 32))
    dealt = materialize(spread.select(F.xxhash64("anchor").alias("key"), "fingerprint", "home", other.alias("free")), "anchors")
    keyed = None
    for width in (8, 6):
        if (crowded := _crowded(dealt, hot)) is None:
            break
        calm = dealt.join(crowded, "key", "left_anti").drop("free")
        keyed = calm if keyed is None else keyed.unionByName(calm)
        dealt = materialize(_by_blocks(dealt.join(crowded, "key", "left_semi"), F.col("free"), width), "blocks")
    return dealt.drop("free") if keyed is None else keyed.unionByName(dealt.drop("free"))


def fingerprint_links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (src, dst) that connect distinct fingerprints within THRESHOLD bits of each other.

    They are true ones or lead to the smallest fingerprint that those reach within a task.
    """
    keyed = dealt_by_anchor(prints, hot)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_link_sorted, LINKS)


def _grouped(docs: DataFrame, hot: int) -> DataFrame:
    """(doc_id, row, fingerprint, component_id) of every row."""
    own = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(own.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    groups = materialize(components(fingerprint_links(distinct, hot)), "groups")
    # Fingerprints without a link are components of their own.
    named = distinct.join(groups, distinct["fingerprint"] == groups["node"], "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    named = materialize(named, "named")
    least = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    table = materialize(named.join(least, "component").select("fingerprint", "component_id"), "membership")
    return own.join(table, "fingerprint")


def near_groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints are 16 hex digits; the component is the smallest doc_id that
    links lead to. Equal fingerprints are one node, however many documents have
    it. Rows with equal doc_id are kept; one without doc_id takes part, but
    names no component, so its own may be null. Other columns are ignored, an
    empty table gives an empty result.
    """
    found = _grouped(docs, hot)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of `docs` whose text is in a group that no smaller doc_id belongs to; rows without doc_id stay.

    Texts decide, not ids: of a doc_id with several texts only those go that are near to
    a text of a smaller doc_id.
    """
    copies = _grouped(docs, hot).filter("doc_id <> component_id").select("doc_id", F.col("row").alias("_near_row")).distinct()
    marked = docs.withColumn("_near_row", _row_hash(F.col("text").cast("string")))
    return marked.join(copies, ["doc_id", "_near_row"], "left_anti").select(*docs.columns)
