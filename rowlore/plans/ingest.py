"""Files to records and catalog entries: the ingest plan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlore.functions.maps import last_wins
from rowlore.functions.names import effective_dataset_name, normalize_column, row_key, schema_id
from rowlore.functions.sentences import row_sentence
from rowlore.functions.values import infer_type
from rowlore.model import VECTOR_WIDTH, DecodeOptions
from rowlore.operators.catalog import collect_columns, describe_cells, first_rows
from rowlore.operators.text import embed_text
from rowlore.plans.sizing import materialize
from rowlore.sources.decoders import decode


@dataclass(frozen=True)
class Ingested:
    records: DataFrame
    schemas: DataFrame


FILE = ("dataset", "path")


def catalog_of(rows: DataFrame, typed: bool, sample_rows: int | None = None) -> DataFrame:
    """C1 per dataset and file from decoded rows: `(dataset, path, columns)`."""
    sample = first_rows(rows.select(*FILE, "row_number", "cells"), sample_rows, ("row_number",), FILE)
    cells = sample.select(
        *FILE, F.col("row_number").alias("seq"), F.posexplode("cells").alias("position", "_c")
    ).select(*FILE, "seq", "position", F.col("_c.key").alias("column"), F.col("_c.value").alias("value"))
    # Ragged rows shift positions: a column sits where it was first seen.
    placed = cells.join(
        cells.groupBy(*FILE, "column").agg(F.min("position").alias("_p")), [*FILE, "column"]
    ).select(*FILE, "seq", F.col("_p").alias("position"), "column", "value")
    kind = infer_type(F.col("value")) if typed else None
    return collect_columns(describe_cells(placed, typed, FILE, kind), FILE)


def ingest_tabular(
    spark: SparkSession,
    path: str | list[str],
    extension: str,
    dataset: str,
    imported_at: datetime,
    collection: str = "tabular",
    options: DecodeOptions = DecodeOptions(),
    width: int = VECTOR_WIDTH,
    tags: dict[str, list[str]] | None = None,
) -> Ingested:
    """Decode files of one extension, a folder's or those given, into records and one catalog entry per file.

    Ids come from the import time and the file, so repeating an import gives the
    same rows; no value is drawn at random.
    """
    when = F.lit(imported_at).cast("timestamp")
    rows = decode(spark, path, extension, options)
    if extension != "csv":
        # Records and catalog both read the rows: decode in Python once.
        rows = materialize(rows, "decoded")
    rows = rows.withColumn("dataset", effective_dataset_name(F.lit(dataset), F.col("file")))
    rows = rows.withColumn("schema_id", schema_id(F.col("file"), when, F.concat_ws("|", "dataset", "path"))).withColumn(
        "import_batch_id", F.sha2(F.concat_ws("|", "dataset", "path", when.cast("string")), 256)
    )
    keyed = last_wins(
        F.transform(
            F.map_entries(F.col("data").try_cast("map<string,variant>")),
            lambda e: F.struct(normalize_column(e["key"]).alias("key"), e["value"].alias("value")),
        )
    )
    shown = row_sentence(
        F.col("worksheet"), F.col("row_number"), F.col("cells"), F.col("schema_id"), F.col("import_batch_id")
    )
    source = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("_worksheet", "_rowNumber", "schema_id", "import_batch_id")]),
        F.array("worksheet", F.col("row_number").cast("string"), "schema_id", "import_batch_id"),
    )
    given = {"dataset_name": [dataset], **(tags or {})}
    tag_map = F.create_map(
        *[x for k, v in given.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))],
        F.lit("file"), F.array("file"),
    )
    records = (
        rows.withColumn("_entries", keyed)
        .withColumn("text", shown)
        .select(
            F.lit(collection).alias("collection"),
            "dataset",
            row_key(F.col("dataset"), F.col("path"), F.col("worksheet"), F.col("row_number")).alias("id"),
            "file", "worksheet", "row_number", "text",
            tag_map.alias("tags"),
            F.to_variant_object(
                F.map_from_arrays(
                    F.transform("_entries", lambda e: e["key"]), F.transform("_entries", lambda e: e["value"])
                )
            ).alias("data"),
            source.alias("source"),
            embed_text(F.col("text"), width).alias("embedding"),
            "schema_id", "import_batch_id",
            F.unix_micros(when).alias("ingest_seq"),
        )
    )
    ids = rows.groupBy(*FILE).agg(
        F.min("file").alias("file"), F.min("schema_id").alias("id"), F.min("import_batch_id").alias("import_batch_id")
    )
    schemas = catalog_of(rows, extension != "csv").join(ids, list(FILE)).select(
        F.lit(collection).alias("collection"), "id", F.col("dataset").alias("dataset_name"),
        F.col("file").alias("source_file"), "file", when.alias("import_date"), "import_batch_id",
        F.create_map(F.lit("document_type"), F.lit("schema")).alias("metadata"), "columns",
    )
    return Ingested(records, schemas)


def store_schemas(catalog: DataFrame | None, new: DataFrame) -> DataFrame:
    """Add or replace catalog entries by id; the file defaults to the source file.

    Of new entries with one id the last import stays: by date, then file, then batch, where there is one.
    """
    marked = F.map_concat(
        F.map_filter(
            F.coalesce("metadata", F.expr("cast(map() as map<string, string>)")), lambda k, v: k != "document_type"
        ),
        F.create_map(F.lit("document_type"), F.lit("schema")),
    )
    ready = new.withColumn("metadata", marked).withColumn(
        "file", F.coalesce(F.nullif("file", F.lit("")), "source_file")
    )
    order = [c for c in ("import_date", "file", "import_batch_id") if c in ready.columns]
    w = Window.partitionBy("id").orderBy(*(F.desc(c) for c in order))
    ready = ready.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    if catalog is None:
        return ready
    return catalog.join(ready.select("id").distinct(), "id", "left_anti").unionByName(ready, allowMissingColumns=True)
