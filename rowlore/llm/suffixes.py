"""Removal of passages that documents with smaller ids have, by a distributed sort of suffixes.

A suffix is taken at each anchor: the place of the least hash of KMER bytes in a
window of WIDTH bytes. Equal windows have their anchor at the same place, so a
repeated string is found among the suffixes that start with equal bytes. Runs of
documents sort their suffixes; the sorted runs are exchanged with common prefixes
left out, and merged by loser trees that go on where known prefixes end.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 50
KMER = 20
STEPS = WIDTH - KMER + 1
LEFT = STEPS - 1
# A row of a sorted run: bytes from the anchor on, bytes before it backwards, first and last window.
ROW = WIDTH + LEFT + 2
RUN_BYTES = 6 << 20
LEAST_RUNS = 64
CHUNK = 1 << 18
# Anchors' bytes that more suffixes than this share are dealt by window instead.
HOT = 20_000
NO_ID = np.iinfo(np.int64).max
MESSAGE = "part long, run long, kind int, data binary"
HASHES, CODES, SUFFIXES, MASKS = range(4)
_TABLE = np.random.default_rng(11).integers(1, 1 << 32, 256, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def _owners(buf: np.ndarray) -> np.ndarray:
    """For each window of WIDTH bytes the place of its least KMER hash, the leftmost of equal ones."""
    h1 = _TABLE[buf]
    sizes, h = {1: h1}, h1
    size = 1
    while size * 2 <= KMER:
        h = h[:-size] * np.uint32(pow(0x9E3779B1, size, 1 << 32)) + h[size:]
        size *= 2
        sizes[size] = h
    rest = KMER - size
    if rest:
        h = h[: len(h) - rest] * np.uint32(pow(0x9E3779B1, rest, 1 << 32)) + sizes[rest][size:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    # Low bits hold the place within what is covered so far; ties then go left.
    least, span = h & np.uint32(0xFFFFFFE0), 1
    while span * 2 <= STEPS:
        least = np.minimum(least[:-span], least[span:] + np.uint32(span))
        span *= 2
    if span < STEPS:
        more = STEPS - span
        least = np.minimum(least[:-more], least[more:] + np.uint32(more))
    return np.arange(len(least)) + (least & np.uint32(31)).astype(np.int64)


@dataclass
class Run:
    """The documents of a run, one after another, and their anchors.

    order: input rows by id; starts, ends: places in `buf`, which has padding on
    both sides; at, first, last: anchors and the starts of the windows they own;
    doc: their document; key: hash of the anchor's bytes.
    """

    order: list[int]
    ids: np.ndarray
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    key: np.ndarray


def scan_run(ids: list, texts: list[bytes]) -> Run:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    own = np.array([NO_ID if ids[i] is None else ids[i] for i in order], np.int64)
    parts = [texts[i] for i in order]
    size = np.array([len(p) for p in parts], np.int64)
    ends = WIDTH + np.cumsum(size)
    starts = ends - size
    buf = np.frombuffer(b"".join([bytes(WIDTH), *parts, bytes(WIDTH)]), np.uint8)
    found: list[tuple[np.ndarray, ...]] = []
    i = 0
    while i < len(parts):
        j = i + 1
        while j < len(parts) and ends[j] - starts[i] <= CHUNK:
            j += 1
        low, high = int(starts[i]), int(ends[j - 1])
        if high - low >= WIDTH:
            owner = _owners(buf[low:high])
            for end in ends[i : j - 1] - low:
                owner[max(0, end - WIDTH + 1) : end] = -1
            cut = np.flatnonzero(np.diff(owner, prepend=-2))
            stop = np.append(cut[1:], len(owner)) - 1
            real = owner[cut] >= 0
            found.append((owner[cut[real]] + low, cut[real] + low, stop[real] + low))
        i = j
    at, first, last = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), (), ())))
    words = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, strides=(1,))
    key = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for shift in (0, 8, KMER - 8):
        key = _mixed(key ^ words[at + shift])
    doc = np.searchsorted(starts, at, side="right") - 1
    # Empty documents share a start with the next one; the last of them is meant.
    return Run(order, own, buf, starts, ends, at, first, last, doc, key)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (key >> np.uint64(40)).astype(np.int64) * parts >> 24


def _message(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    part, run, kind, data = zip(*rows) if rows else ((), (), (), ())
    numbers = [pa.array(c, t) for c, t in zip((part, run, kind), (pa.int64(), pa.int64(), pa.int32()))]
    return pa.table([*numbers, pa.array(data, pa.binary())], names=["part", "run", "kind", "data"])


def _by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """Ends of the parts in an array of ascending part numbers, with 0 in front."""
    return np.searchsorted(part, np.arange(parts + 1))


def send_hashes(run: Run, number: int, parts: int) -> pa.Table:
    """The distinct anchor hashes of a run, how often each is there, by part."""
    keys, counts = np.unique(run.key, return_counts=True)
    at = _by_part(_part(keys, parts), parts)
    often = np.minimum(counts, 255).astype(np.uint8)
    rows = []
    for p in range(parts):
        own = keys[at[p] : at[p + 1]]
        if len(own):
            low = (own & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
            high = (own >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8).tobytes()
            rows.append((p, number, HASHES, low + high + often[at[p] : at[p + 1]].tobytes()))
    return _message(rows)


def count_hashes(table: pa.Table, hot: int) -> pa.Table:
    """For each run of a part, two bits a hash: that other runs have it; that very many anchors have it."""
    runs, blobs = table.column("run").to_pylist(), table.column("data").to_pylist()
    part = table.column("part")[0].as_py()
    sizes = [len(b) // 6 for b in blobs]
    low = np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(blobs, sizes)]).astype(np.uint64)
    high = np.concatenate([np.frombuffer(b, np.uint8, n, 4 * n) for b, n in zip(blobs, sizes)]).astype(np.uint64)
    often = np.concatenate([np.frombuffer(b, np.uint8, n, 5 * n) for b, n in zip(blobs, sizes)]).astype(np.int64)
    _, group, members = np.unique(high << np.uint64(32) | low, return_inverse=True, return_counts=True)
    shared = members[group] > 1
    crowded = np.bincount(group, weights=often, minlength=len(members))[group] > hot
    rows, at = [], 0
    for run, n in zip(runs, sizes):
        bits = np.concatenate([shared[at : at + n], crowded[at : at + n]])
        rows.append((part, run, CODES, np.packbits(bits).tobytes()))
        at += n
    return _message(rows)


@dataclass
class Suffixes:
    """What a run sends: units (anchor, range of offsets) and the distinct sorted rows they have.

    anchor, low, high: for each unit the anchor and the least and largest distance
    of its windows' starts before it; entry: its row; rows: distinct rows by part,
    then bytes; least: smallest document id of each; bounds: of the parts in rows.
    """

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    entry: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    bounds: np.ndarray


def collect_suffixes(run: Run, codes: dict[int, bytes], parts: int) -> Suffixes:
    keys, inverse = np.unique(run.key, return_inverse=True)
    at = _by_part(_part(keys, parts), parts)
    shared, crowded = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for p, blob in codes.items():
        n = at[p + 1] - at[p]
        bits = np.unpackbits(np.frombuffer(blob, np.uint8), count=2 * n).astype(bool)
        shared[at[p] : at[p + 1]], crowded[at[p] : at[p + 1]] = bits[:n], bits[n:]
    # Documents of this run may share a hash that no other run has.
    ids = run.ids[run.doc]
    low_id, high_id = np.full(len(keys), NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low_id, inverse, ids)
    np.maximum.at(high_id, inverse, ids)
    wanted = np.flatnonzero((shared | (low_id < high_id))[inverse])
    low, high = run.at - run.last, run.at - run.first
    hot = crowded[inverse[wanted]]
    plain, many = wanted[~hot], wanted[hot]
    each = high[many] - low[many] + 1
    offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low[many], each)
    anchor = np.concatenate([plain, np.repeat(many, each)])
    low, high = np.concatenate([low[plain], offset]), np.concatenate([high[plain], offset])
    place = run.at[anchor]
    matrix = np.zeros((len(anchor), -(-ROW // 8) * 8), np.uint8)
    for i in range(WIDTH):
        matrix[:, i] = np.where(low < WIDTH - i, run.buf[place + i], 0)
    for i in range(LEFT):
        matrix[:, WIDTH + i] = np.where(high > i, run.buf[place - 1 - i], 0)
    matrix[:, ROW - 2], matrix[:, ROW - 1] = low, high
    key = run.key[anchor].copy()
    if len(many):
        words = matrix[len(plain) :].view("<u8")
        own = key[len(plain) :]
        for i in range(words.shape[1]):
            own = _mixed(own ^ words[:, i])
        key[len(plain) :] = own
    part = _part(key, parts)
    text = np.ascontiguousarray(matrix[:, :ROW]).view(f"S{ROW}").ravel()
    order = np.lexsort((text, part)) if len(text) else np.zeros(0, np.int64)
    text, part = text[order], part[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (part[1:] != part[:-1])
    head = np.flatnonzero(new)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(run.ids[run.doc[anchor]][order], head) if len(head) else np.zeros(0, np.int64)
    return Suffixes(anchor, low, high, entry, matrix[order[head], :ROW], least, _by_part(part[head], parts))


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix with the row before, and the bytes after it, of sorted rows."""
    common = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        unequal = rows[1:] != rows[:-1]
        common[1:] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), rows.shape[1])
    return common, rows[np.arange(rows.shape[1]) >= common[:, None]].tobytes()


def front_decode(common: np.ndarray, tails: np.ndarray, width: int = ROW) -> np.ndarray:
    """The rows again; several runs may follow each other, as each starts with a common prefix of 0."""
    given = np.arange(width) >= common[:, None]
    out = np.zeros((len(common), width), np.uint8)
    out[given] = tails
    row = np.arange(len(common), dtype=np.int32)
    for c in range(width):
        out[:, c] = out[np.maximum.accumulate(np.where(given[:, c], row, 0)), c]
    return out


def send_suffixes(own: Suffixes, number: int, parts: int) -> list[tuple[int, int, int, bytes]]:
    out = []
    for p in range(parts):
        i, j = own.bounds[p], own.bounds[p + 1]
        if j > i:
            common, tails = front_code(own.rows[i:j])
            size = np.array([j - i], "<i8").tobytes()
            out.append((p, number, SUFFIXES, size + own.least[i:j].astype("<i8").tobytes() + common.tobytes() + tails))
    return out


def merge(keys: list[list[bytes]], common: list[list[int]]) -> tuple[list[int], list[int]]:
    """Loser-tree merge of sorted runs with their common prefixes: (run, common prefix) of each output.

    Every contestant carries how much it shares with the last output. The one
    that shares more comes first, without a look at the bytes; only of equals
    are bytes compared, from there on, and the loser keeps what they share.
    """
    leaves = 1
    while leaves < len(keys):
        leaves *= 2
    known = [0 if i < len(keys) and keys[i] else -1 for i in range(leaves)]
    place = [0] * leaves
    losers = [0] * leaves
    length = len(next(k[0] for k in keys if k)) if any(keys) else 0

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two that share equally much with the last output."""
        at = known[a]
        if at < 0:
            return a, b
        x, y = keys[a][place[a]][at:], keys[b][place[b]][at:]
        bits = (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()
        differ = length - at - (bits + 7) // 8
        if not bits or x[differ] < y[differ]:
            known[b] = at + differ
            return a, b
        known[a] = at + differ
        return b, a

    winners = list(range(leaves))
    level = leaves
    while level > 1:
        level //= 2
        now = []
        for k in range(level):
            a, b = winners[2 * k], winners[2 * k + 1]
            if known[a] == known[b]:
                a, b = play(a, b)
            elif known[a] < known[b]:
                a, b = b, a
            now.append(a)
            losers[level + k] = b
        winners = now
    winner = winners[0]
    runs, shared = [], []
    while known[winner] >= 0:
        runs.append(winner)
        shared.append(known[winner])
        place[winner] = at = place[winner] + 1
        known[winner] = mine = common[winner][at] if at < len(keys[winner]) else -1
        node = (leaves + winner) // 2
        while node:
            other = losers[node]
            theirs = known[other]
            if theirs > mine:
                losers[node], winner, mine = winner, other, theirs
            elif theirs == mine and mine >= 0:
                winner, losers[node] = play(winner, other)
                mine = known[winner]
            node //= 2
    return runs, shared


def earlier_windows(rows: np.ndarray, common: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each merged row a bit per distance: that window starts in a document smaller than the row's least.

    Rows are in merged order; `common` is what each shares with the one before.
    Equal windows have equal bytes after and before their anchor. Which rows share
    the bytes after it follows from the common prefixes, for every length at once,
    and so do the bytes before it once the rows are ordered by them.
    """
    masks = np.zeros(len(rows), np.uint32)
    # A suffix that shares its anchor's bytes with no other has no equal window.
    new = common < KMER
    new[:1] = True
    group = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1) if len(rows) else np.zeros(0, np.int64)
    if not len(several):
        return masks
    joint = common.astype(np.int64)
    before = np.ascontiguousarray(rows[several, WIDTH : WIDTH + LEFT])
    order = np.argsort(before.view(f"S{LEFT}").ravel(), kind="stable")
    shared, _ = front_code(before[order])
    low, high = rows[several, ROW - 2], rows[several, ROW - 1]
    for m in range(STEPS):
        active = np.flatnonzero((low <= m) & (m <= high))
        if len(active) < 2:
            continue
        after = np.cumsum((joint < WIDTH - m) | new)[several]
        back = np.empty(len(several), np.int64)
        back[order] = np.cumsum(shared < m)
        key = (after * (len(several) + 1) + back)[active]
        by = np.argsort(key, kind="stable")
        sorted_key = key[by]
        head = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        own = least[several[active]]
        lowest = np.minimum.reduceat(own[by], head)
        smallest = np.empty(len(active), np.int64)
        smallest[by] = np.repeat(lowest, np.diff(np.append(head, len(by))))
        masks[several[active]] |= (smallest < own).astype(np.uint32) << np.uint32(m)
    return masks


def merge_part(table: pa.Table) -> pa.Table:
    """The sorted runs of a part merged; to each run the masks of its rows. Codes pass on to their run."""
    if table.column("kind")[0].as_py() == CODES:
        return table
    part, runs, blobs = table.column("part")[0].as_py(), table.column("run").to_pylist(), table.column("data").to_pylist()
    least, commons, tails = [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        least.append(np.frombuffer(blob, "<i8", n, 8))
        commons.append(np.frombuffer(blob, np.uint8, n, 8 + 8 * n))
        tails.append(np.frombuffer(blob, np.uint8, offset=8 + 9 * n))
    sizes = [len(c) for c in commons]
    rows = front_decode(np.concatenate(commons), np.concatenate(tails))
    texts = rows.view(f"V{ROW}").ravel().tolist()
    ends = np.cumsum(sizes)
    keys = [texts[e - n : e] for e, n in zip(ends, sizes)]
    source, shared = merge(keys, [c.tolist() for c in commons])
    # Rows of a run keep their order in the output.
    merged = np.empty(len(rows), np.int64)
    merged[np.argsort(np.array(source), kind="stable")] = np.arange(len(rows))
    masks = np.empty(len(rows), np.uint32)
    masks[merged] = earlier_windows(rows[merged], np.array(shared), np.concatenate(least)[merged])
    return _message([(part, run, MASKS, masks[e - n : e].astype("<u4").tobytes()) for run, e, n in zip(runs, ends, sizes)])


def removed_bytes(run: Run, own: Suffixes, masks: np.ndarray) -> np.ndarray:
    """For each byte of the run's buffer, whether a window that starts in a smaller document covers it."""
    n = len(run.buf) + 1
    place, ids = run.at[own.anchor], run.ids[run.doc[own.anchor]]
    later = ids > own.least[own.entry]
    starts = [(place - own.high)[later]]
    stops = [(place - own.low)[later] + WIDTH]
    rest = np.flatnonzero(~later & (masks[own.entry] > 0))
    bits = masks[own.entry[rest]]
    for m in range(STEPS):
        some = place[rest[(bits >> np.uint32(m) & np.uint32(1)).astype(bool)]] - m
        starts.append(some)
        stops.append(some + WIDTH)
    change = np.bincount(np.concatenate(starts), minlength=n) - np.bincount(np.concatenate(stops), minlength=n)
    return np.cumsum(change)[:-1] > 0


def run_number(runs: int) -> Column:
    """The run of a row, any one: by id, text and place, so that equal rows spread over all runs, too."""
    return F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(runs))


def without_earlier_passages(docs: DataFrame, run_bytes: int = RUN_BYTES, least_runs: int = LEAST_RUNS, hot: int = HOT) -> DataFrame:
    """`docs` with the kept text, and n_bytes, n_removed, n_spans, kept_sha256 of its UTF-8 bytes.

    A byte goes if a string of WIDTH bytes that covers it also starts in a
    document with a smaller doc_id; strings stay within a document and are judged
    on the input. A null text is empty and becomes an empty text. Rows with
    equal doc_id are not smaller than each other; a null doc_id is larger than
    all. Kept bytes that are no whole character any more are left out of the
    text, not of the digest. Input columns of the names added are replaced.

    Three exchanges go by runs of documents, whose texts are shuffled once: of
    anchor hashes, to know which occur in more than one run; of front-coded
    sorted suffixes of those; of what merging them found. A suffix that many
    documents have is sent once a run. If more than `hot` different suffixes
    share an anchor's bytes, each of their windows is dealt by its own bytes.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    runs = parts = max(least_runs, -(-total // run_bytes))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(*columns).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    own = own.withColumn("_run", run_number(runs)).repartition(tasks, "_run")
    kept = T.StructType([T.StructField(c, T.StringType() if c == "text" else docs.schema[c].dataType) for c in columns])
    schema = T.StructType([*kept.fields, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def scanned(table: pa.Table) -> tuple[int, Run]:
        texts = table.column("text").to_pylist()
        return table.column("_run")[0].as_py(), scan_run(table.column("doc_id").to_pylist(), texts)

    def of_kind(table: pa.Table, kind: int) -> dict[int, bytes]:
        rows = zip(*(table.column(c).to_pylist() for c in ("part", "kind", "data")))
        return {p: d for p, k, d in rows if k == kind}

    def hashes(table: pa.Table) -> pa.Table:
        number, run = scanned(table)
        return send_hashes(run, number, parts)

    def suffixes(table: pa.Table, codes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _message([])
        number, run = scanned(table)
        found = of_kind(codes, CODES)
        out = send_suffixes(collect_suffixes(run, found, parts), number, parts)
        # The run needs its codes again; they pass the merge by, spread over all tasks.
        passed = [(-1 - number * parts - p, number, CODES, d) for p, d in found.items()]
        return _message(out + passed)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        number, run = scanned(table)
        rows = list(zip(*(answers.column(c).to_pylist() for c in ("part", "kind", "data"))))
        codes = {(-1 - p) % parts: d for p, k, d in rows if k == CODES}
        found = collect_suffixes(run, codes, parts)
        masks = np.zeros(len(found.rows), np.uint32)
        for p, k, d in rows:
            if k == MASKS:
                masks[found.bounds[p] : found.bounds[p + 1]] = np.frombuffer(d, "<u4")
        gone = removed_bytes(run, found, masks)
        total = np.concatenate([[0], np.cumsum(gone)])
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        begin = run.starts[run.ends > run.starts]
        rise[begin] = gone[begin]
        spans = np.concatenate([[0], np.cumsum(rise)])
        texts, digests = [], []
        for a, b in zip(run.starts.tolist(), run.ends.tolist()):
            part = run.buf[a:b]
            data = (part[~gone[a:b]] if total[b] > total[a] else part).tobytes()
            digests.append(hashlib.sha256(data).hexdigest())
            texts.append(data.decode(errors="ignore"))
        done = table.drop_columns(["_run"]).take(pa.array(run.order, pa.int64()))
        done = done.set_column(done.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        for name, values in (("n_bytes", run.ends - run.starts), ("n_removed", total[run.ends] - total[run.starts]), ("n_spans", spans[run.ends] - spans[run.starts])):
            done = done.append_column(name, pa.array(values, pa.int64()))
        return done.append_column("kept_sha256", pa.array(digests, pa.string()))

    by_run = own.groupBy("_run")
    sent = by_run.applyInArrow(hashes, MESSAGE)
    codes = sent.groupBy("part").applyInArrow(lambda t: count_hashes(t, hot), MESSAGE)
    rows = by_run.cogroup(codes.groupBy("run")).applyInArrow(suffixes, MESSAGE)
    answers = rows.groupBy("part").applyInArrow(merge_part, MESSAGE)
    return by_run.cogroup(answers.groupBy("run")).applyInArrow(cut, schema)
