"""Ingest only the files a folder has gained since the last run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlore.model import VECTOR_WIDTH, DecodeOptions
from rowlore.operators.store import RecordStore, Written
from rowlore.plans.ingest import ingest_tabular
from rowlore.sources.folders import extension, file_name, literal_path

# Files of one micro-batch; their paths pass through the driver.
BATCH_FILES = 1000
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, max_files: int = BATCH_FILES) -> DataFrame:
    """New files as rows with their content, at most `max_files` in a micro-batch."""
    return (
        spark.readStream.format("binaryFile")
        .option("maxFilesPerTrigger", max_files)
        .schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", pattern)
        .load(path)
        .withColumn("file", file_name(F.col("path")))
        .withColumn("extension", extension(F.col("path")))
    )


def line_stream(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """New files as text lines with their path."""
    return (
        spark.readStream.schema("value string")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )


def run_once(stream: DataFrame, target: str, checkpoint: str, partition_by: tuple[str, ...] = ()) -> None:
    """Process everything that is new, then stop; a second run adds nothing."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).option("path", target)
    )
    (writer.partitionBy(*partition_by) if partition_by else writer).start().awaitTermination()


def ingest_new_files(
    spark: SparkSession,
    path: str,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    pattern: str = "*",
) -> None:
    """Hand each micro-batch of new files to `handle(files, batch_id)`.

    A batch may be repeated after a failure: `handle` should upsert by record id.
    """
    (
        file_stream(spark, path, pattern)
        .drop("content")
        .writeStream.foreachBatch(handle)
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .start()
        .awaitTermination()
    )


def ingest_new_tables(
    spark: SparkSession,
    path: str,
    file_extension: str,
    dataset: str,
    store: RecordStore,
    collection: str,
    checkpoint: str,
    options: DecodeOptions = DecodeOptions(),
    width: int = VECTOR_WIDTH,
    batches: list[tuple[int, Written]] | None = None,
) -> None:
    """Decode the files a folder has gained since the last run, and upsert their records.

    Each micro-batch reads its own files only. Record ids follow from file and row, the import time is that of the
    batch's newest file: a batch that is repeated after a failure writes the same records again and changes
    nothing. `batches` gets what each upsert did.
    """

    def handle(files: DataFrame, batch_id: int) -> None:
        found = files.agg(F.collect_list("path").alias("paths"), F.max("modificationTime").alias("at")).first()
        if not found["paths"]:
            return
        paths = [literal_path(p) for p in sorted(found["paths"])]
        done = ingest_tabular(spark, paths, file_extension, dataset, found["at"], collection, options, width)
        written = store.upsert(collection, done.records)
        if batches is not None:
            batches.append((batch_id, written))

    ingest_new_files(spark, path, handle, checkpoint, f"*.{file_extension}")
