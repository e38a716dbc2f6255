"""Folder and object-store scans: S1-S4, S14."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What Spark's writers name the part of each task: its number, and an id of the write.
PART = r"/part-(\d+)-(\p{XDigit}{8}(?:-\p{XDigit}{4}){3}-\p{XDigit}{12})(?:[.-]c\d+)?(?=\.[^/]*$|$)"


def extension(path: Column) -> Column:
    """Lower-case extension without its dot, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def literal_path(path: str) -> str:
    """A path whose own characters stand for themselves, where a reader takes patterns."""
    return re.sub(r"([\[\]{}*?\\^])", r"\\\1", path)


def file_name(path: Column) -> Column:
    """The last part of a URI, as in `_metadata.file_path`; paths of binary files are no URIs."""
    return F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))


def whole_path(path: Column) -> Column:
    """One path for all parts of a file that tasks of one write have left in a folder, other paths as they are."""
    return F.regexp_replace(path, PART, "/$2")


def part_number(path: Column) -> Column:
    """Place of a part in its file, 0 for other files."""
    return F.coalesce(F.regexp_extract(path, PART, 1).try_cast("bigint"), F.lit(0))


def whole_files(files: DataFrame) -> DataFrame:
    """Scanned files with the parts of one write as one file: their bytes added, the time of the last."""
    whole = files.withColumn("path", whole_path(F.col("path"))).groupBy("path", "extension").agg(
        F.max("modificationTime").alias("modificationTime"), F.sum("length").alias("length")
    )
    file = F.substring_index("path", "/", -1).alias("file")
    return whole.select("path", "modificationTime", "length", file, "extension")


def scan_files(
    spark: SparkSession, path: str | list[str], pattern: str = "*", recursive: bool = True, content: bool = False
) -> DataFrame:
    """One row per file; `recursive=False` takes the root's own files only.

    The content is only read when asked for, and each file is read by one task. A
    file that cannot be read fails the job: none is left out silently.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", pattern)
    )
    files = reader.load(path)
    kept = ["path", "modificationTime", "length", *(["content"] if content else [])]
    return files.select(*kept).withColumn("file", F.substring_index("path", "/", -1)).withColumn(
        "extension", extension(F.col("path"))
    )


def route(files: DataFrame) -> DataFrame:
    """Adds `route`, `tabular` for files that a registered decoder takes, else `text`."""
    from rowlore.sources.decoders import DECODERS

    return files.withColumn(
        "route", F.when(F.col("extension").isin(*DECODERS), "tabular").otherwise("text")
    )


def extension_counts(files: DataFrame) -> DataFrame:
    """Files and bytes per extension."""
    return files.groupBy("extension").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """The text route: one row per file with its whole text."""
    texts = (
        spark.read.option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    return texts.withColumn("file", file_name(F.col("path"))).withColumn("extension", extension(F.col("path")))
