"""Value and field summaries: A1-A3, A6, A7, A8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlore.model import TOP_VALUES_LIMIT, resolve_field


def top_values(df: DataFrame, value: Column, limit: int = TOP_VALUES_LIMIT) -> DataFrame:
    """A1: most frequent values, nulls dropped first, ties by value.

    Counting combines map-side, so a value holding a third of all rows costs one
    partial row per task.
    """
    counted = (
        df.select(value.cast("string").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value")
    )
    return counted.limit(limit) if limit > 0 else counted


def top_data_values(df: DataFrame, field: str, limit: int = TOP_VALUES_LIMIT) -> DataFrame:
    """A1 on a data field by name."""
    return top_values(df, resolve_field(df, field), limit)


def top_tag_values(df: DataFrame, tag: str, limit: int = TOP_VALUES_LIMIT, tags: str = "tags") -> DataFrame:
    """The same over the elements of a tag's list, case kept."""
    unnested = df.select(F.explode(F.col(tags)[tag]).alias("value"))
    return top_values(unnested, F.col("value"), limit)


def filterable_fields(
    df: DataFrame, sample_rows: int | None = None, order: tuple[str, ...] = (), tags: str = "tags", data: str = "data"
) -> DataFrame:
    """A3: distinct tag and data keys, compared without case; all rows unless sampled."""
    if sample_rows:
        df = df.orderBy(*order).limit(sample_rows)
    kind = dict(df.dtypes)[data]
    keys = F.map_keys(F.col(data).try_cast("map<string,variant>")) if kind == "variant" else F.map_keys(F.col(data))

    def labelled(names: Column, where: str) -> Column:
        return F.transform(
            F.coalesce(names, F.array().cast("array<string>")),
            lambda k: F.struct(F.lit(where).alias("kind"), k.alias("name")),
        )

    pairs = F.concat(labelled(F.map_keys(F.col(tags)), "tag"), labelled(keys, "data"))
    return (
        df.select(F.explode(pairs).alias("f"))
        .groupBy(F.col("f.kind").alias("kind"), F.lower("f.name").alias("field"))
        .agg(F.min("f.name").alias("name"), F.count("*").alias("records"))
    )


def dedup_first(df: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The first row of each key.

    `min_by` combines map-side: a key repeated in a third of all rows sends one
    candidate per task, not its rows.
    """
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def import_summary(df: DataFrame, by: tuple[str, ...], imported: Column | None = None) -> DataFrame:
    """Source and imported rows per file, extension, batch or dataset."""
    ok = F.lit(True) if imported is None else imported
    return df.groupBy(*by).agg(
        F.count("*").alias("source_rows"),
        F.count_if(ok).alias("imported_rows"),
        F.count_if(~ok).alias("failed_rows"),
    )


def batch_count(df: DataFrame, batch: str = "import_batch_id") -> DataFrame:
    """Records per import batch."""
    return df.groupBy(batch).agg(F.count("*").alias("records"))
