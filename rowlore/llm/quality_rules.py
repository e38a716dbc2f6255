"""Quality rules: fixed counts, and a hashed n-gram likelihood ratio against trusted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "base_failed", "kept")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
BUCKETS = 1 << 15
# Mean log-likelihood ratio an n-gram below which a document is rejected.
THRESHOLD = -0.4
# Runs of letters, of digits, or of anything else but white space.
TOKEN = "\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]+"
# So many trusted ids, 8 bytes each, are broadcast; more are joined by shuffle.
TRUSTED_BROADCAST = 2_000_000


def text_counts(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as longs.

    Arrays stay within their row: nothing is exploded or shuffled. Each array is
    a column of its own step and used several times above it, so that it is
    made once a row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split("_text", f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, SPACE_CHARACTERS, "")) > 0)
    step = docs.withColumn("_text", text)
    step = step.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    step = step.withColumn("_lines", lines)
    at = [f"get(_hashes, i + {k})" for k in range(1, WINDOW)]
    windows = f"slice(transform(_hashes, (h, i) -> xxhash64(h, {', '.join(at)})), 1, greatest(size(_hashes) - {WINDOW - 1}, 0))"
    step = step.withColumn("_windows", F.expr(windows))
    # Windows that occur again, in order of hash and place; mostly there are none.
    again = "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h, i))) END"
    step = step.withColumn("_sorted", F.expr(again))
    places = """sort_array(transform(filter(_sorted, (s, k) ->
        coalesce(s.h = get(_sorted, k - 1).h, false) OR coalesce(s.h = get(_sorted, k + 1).h, false)), s -> s.i))"""
    covered = f"aggregate({places}, struct(0L AS n, -{WINDOW} AS last), (a, i) -> struct(a.n + least({WINDOW}, i - a.last) AS n, i AS last), a -> a.n)"
    symbols = F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))
    return step.select(
        *docs.columns,
        F.size("_hashes").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACE_CHARACTERS, "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN _sorted IS NULL THEN 0L ELSE {covered} END").alias("n_repeat_words"),
    )


def _tokens(text: str) -> Column:
    return F.transform(F.expr(f"regexp_extract_all(coalesce(cast({text} AS string), ''), r'{TOKEN}', 0)"), lambda t: F.xxhash64(t))


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: `weights`, the log-ratio of the trusted to the raw multinomial of each hash bucket.

    Single tokens and pairs of every document count for the raw corpus, those of
    the documents whose doc_id is in `trusted` for the target. Counts meet in at
    most `buckets` sums a task before the shuffle. Add-one smoothing; without
    trusted documents every weight is zero.
    """
    ids = trusted.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("_trusted", F.lit(1))
    if ids.count() <= TRUSTED_BROADCAST:
        ids = F.broadcast(ids)
    step = docs.select("doc_id", "text").join(ids, "doc_id", "left").select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"), _tokens("text").alias("_t"))
    grams = F.expr(f"concat(transform(_t, h -> pmod(h, {buckets}L)), slice(transform(_t, (h, i) -> pmod(xxhash64(h, get(_t, i + 1)), {buckets}L)), 1, greatest(size(_t) - 1, 0)))")
    counted = step.select("_trusted", F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_trusted").alias("target"))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counted, "bucket", "left").fillna(0, ["raw", "target"])
    rows = every.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("_rows"),
        F.sum("raw").alias("_raw"), F.sum("target").alias("_target"),
    )
    weight = f"ln((r.target + 1D) / (_target + {buckets}D)) - ln((r.raw + 1D) / (_raw + {buckets}D))"
    return rows.select(F.expr(f"transform(_rows, r -> CASE WHEN _target = 0 THEN 0D ELSE {weight} END)").alias("weights"))


def likelihood_ratio(docs: DataFrame, weights: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`docs` with `ratio`: the mean weight of its tokens and pairs, 0 for a text without any."""
    step = docs.withColumn("_w", weights.scalar()).withColumn("_t", _tokens("text"))
    total = f"""aggregate(_t, struct(0D AS s, cast(NULL AS bigint) AS p), (a, h) -> struct(
        a.s + _w[cast(pmod(h, {buckets}L) AS int)] + CASE WHEN a.p IS NULL THEN 0D ELSE _w[cast(pmod(xxhash64(a.p, h), {buckets}L) AS int)] END AS s,
        h AS p), a -> a.s)"""
    ratio = F.expr(f"CASE WHEN size(_t) = 0 THEN 0D ELSE {total} / (2 * size(_t) - 1) END")
    return step.withColumn("ratio", ratio).select(*docs.columns, "ratio")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """`docs` with the counts, `ratio`, `base_failed` and `kept`.

    A document fails the base rules with under ten words, or with over a fifth of
    its words in five-word windows that occur again. Of the others those are kept
    whose ratio reaches the threshold. Null and empty texts have no words and
    fail. Each row is judged alone; rows with equal or null doc_id are kept apart.
    Input columns of the names added, or with the names of steps, are left out.
    """
    docs = docs.select(*(c for c in docs.columns if c not in ADDED and not c.startswith("_")))
    found = likelihood_ratio(text_counts(docs), bucket_weights(docs, trusted, buckets), buckets)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    # A filter on `kept` must not move below the counts: it would repeat their arrays inside
    # each other's lambdas. Spark moves none below a row number.
    found = found.withColumn("_row", F.monotonically_increasing_id()).withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold) & (F.col("_row") >= 0)).drop("_row")
