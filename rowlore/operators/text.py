"""Document text: T1 chunks, T2 extraction, T3 summaries, T4 embeddings, T12 completion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlore.functions.vectors import bag_vector, hashed_buckets
from rowlore.model import CHUNK_OVERLAP, CHUNK_TOKENS
from rowlore.plans.prompts import KNOWN, UNKNOWN
from rowlore.plans.sizing import BROADCAST_ROWS, materialize

Provider = Callable[[list[str]], list]

# Markup removed with its content, and the entities decoded.
DROPPED_ELEMENTS = ("script", "style", "head", "noscript", "template")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
# A term counting for more than 1/HOT_SHARE of all term rows is hot; there are at most HOT_SHARE of them.
HOT_SHARE = 1000
# Bytes of a key that is broadcast without being that hot: BROADCAST_ROWS of them stay below BROADCAST_BYTES.
SHORT_KEY = 256


def tokens(text: Column) -> Column:
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def chunk_text(
    df: DataFrame, text: str = "text", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Overlapping chunks of whitespace tokens, `chunk_number` from 0.

    The text column is replaced by the chunks, so exploded rows do not repeat it.
    """
    step = size - overlap
    count, listed = F.size("_tokens"), F.col("_tokens")
    last = F.ceil(F.greatest(count - size, F.lit(0)) / step).cast("int")
    chunks = F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                i.alias("chunk_number"),
                F.array_join(F.slice(listed, i * step + 1, F.lit(size)), " ").alias("chunk_text"),
                F.least(count - i * step, F.lit(size)).alias("token_count"),
            ),
        ),
    )
    rest = [c for c in df.columns if c != text]
    return (
        df.select(*rest, tokens(F.col(text)).alias("_tokens"))
        .select(*rest, F.explode(chunks).alias("_c"))
        .select(*rest, "_c.*")
    )


def extract_text(html: Column, is_page: Column | bool = False) -> Column:
    """Readable text where `is_page` holds; what is no page, or not known to be one, passes through unchanged.

    The flag comes from the file type: the content decides nothing.
    """
    text = html
    for element in DROPPED_ELEMENTS:
        text = F.regexp_replace(text, rf"(?is)<{element}\b[^>]*>.*?</{element}\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    return F.when(is_page if isinstance(is_page, Column) else F.lit(is_page), text).otherwise(html)


def join_counts(rows: DataFrame, counts: DataFrame, key: str, weight: str) -> DataFrame:
    """Look counts up for rows whose keys may be very uneven.

    Keys above 1/HOT_SHARE of the total weight, at most HOT_SHARE many, are broadcast; so are
    short keys from a power of two on, the least that BROADCAST_ROWS or fewer of them reach. What
    is left has no hot key and is shuffled. Where nothing is left, rows stay where they are.
    """
    counts = materialize(counts, "counts")
    short, power = F.octet_length(key) <= SHORT_KEY, F.floor(F.log2(weight))
    powers = counts.groupBy(power.alias("power")).agg(F.count_if(short).alias("short"), F.count_if(~short).alias("long"), F.sum(weight).alias("w"))
    found = powers.orderBy(F.desc("power")).collect()
    total, some, least = sum(r["w"] for r in found), 0, None
    for r in found:
        some += r["short"]
        if some > BROADCAST_ROWS:
            break
        least = r["power"]
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    if least is not None:
        is_hot = is_hot | (short & (power >= least))
    if some <= BROADCAST_ROWS and not any(r["long"] for r in found):
        return rows.join(F.broadcast(counts), key)
    hot = counts.where(is_hot)
    marked = rows.join(F.broadcast(hot.withColumnRenamed(weight, "_hot")), key, "left")
    known = marked.where(F.col("_hot").isNotNull()).withColumnRenamed("_hot", weight)
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(counts.where(~is_hot), key)
    return known.unionByName(rest)


def summarize(df: DataFrame, doc_id: str, text: str = "text", sentences: int = 3) -> DataFrame:
    """The highest-scoring sentences of each document, in text order.

    A sentence scores the mean corpus count of its distinct words; ties go to the
    earlier sentence.
    """
    cut = F.transform(F.split(F.col(text), r"[.!?\n]+"), lambda s: F.struct(F.trim(s).alias("sentence"), F.array_distinct(words(s)).alias("terms")))
    kept = F.filter(cut, lambda s: F.size(s["terms"]) > 0)
    # Written once: counting, scoring and choosing all read the sentences.
    split = materialize(df.select(doc_id, F.posexplode(kept).alias("position", "_s")).select(doc_id, "position", "_s.*"), "sentences")
    terms = split.select(doc_id, "position", F.explode("terms").alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("n"))
    # Sums of counts are whole numbers: exact whatever the order of addition.
    scored = (
        join_counts(terms, counts, "term", "n")
        .groupBy(doc_id, "position")
        .agg(F.sum("n").alias("_sum"), F.count("*").alias("_terms"))
        .withColumn("score", F.col("_sum") / F.col("_terms"))
    )
    w = Window.partitionBy(doc_id).orderBy(F.desc("score"), "position")
    best = scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sentences)
    return (
        best.join(split.select(doc_id, "position", "sentence"), [doc_id, "position"])
        .groupBy(doc_id)
        .agg(F.array_sort(F.collect_list(F.struct("position", "sentence"))).alias("_s"))
        .select(
            doc_id,
            F.concat(F.array_join(F.transform("_s", lambda s: s["sentence"]), ". "), F.lit(".")).alias("summary"),
        )
    )


def embed_text(text: Column, width: int) -> Column:
    """T4, default provider: hashed bag of words of unit length."""
    return bag_vector(width)(hashed_buckets(words(text), width))


def _batched(provider: Provider, source: str, target: str, batch_size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[source].tolist()
            out: list = []
            for i in range(0, len(texts), batch_size):
                out.extend(provider(texts[i : i + batch_size]))
            yield frame.assign(**{target: out})

    return run


def embed_with(df: DataFrame, provider: Provider, text: str = "text", batch_size: int = 16) -> DataFrame:
    """Vectors from a picklable provider `list[str] -> list[list[float]]`."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return df.mapInPandas(_batched(provider, text, "embedding", batch_size), schema)


def record_lines(prompt: Column) -> Column:
    """T12 without a model: the record lines of a prompt as its answer, or that there are none."""
    lines = F.transform(F.split(prompt, r"\r\n|[\n\r]"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    rows = F.filter(lines, lambda line: line.startswith("ROW "))
    return F.when(F.size(rows) > 0, F.concat(F.lit(f"{KNOWN}: "), F.array_join(rows, " | "))).otherwise(UNKNOWN)


def complete_batch(
    df: DataFrame, provider: Provider | None = None, prompt: str = "prompt", concurrency: int | None = None, batch_size: int = 16
) -> DataFrame:
    """Completions of a prompt table: `record_lines`, in the plan itself, or those of a given provider.

    A provider is a picklable function over lists of prompts; `concurrency` bounds its parallel calls.
    """
    if provider is None:
        return df.withColumn("completion", record_lines(F.col(prompt)))
    schema = T.StructType([*df.schema.fields, T.StructField("completion", T.StringType())])
    df = df.repartition(concurrency) if concurrency else df
    return df.mapInPandas(_batched(provider, prompt, "completion", batch_size), schema)
