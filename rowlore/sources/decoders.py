"""Decoders by file extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlore.functions.maps import entries_to_variant
from rowlore.functions.values import typed_variant
from rowlore.model import DecodeOptions
from rowlore.sources.delimited import csv_rows
from rowlore.sources.workbooks import xlsx_rows

# A decoder yields path, file, worksheet, row_number, cells and data of a folder, or of the files it is given.
Decoder = Callable[[SparkSession, str | list[str], DecodeOptions], DataFrame]
ROW_COLUMNS = ("path", "file", "worksheet", "row_number", "cells", "data")


def _csv(spark: SparkSession, path: str | list[str], options: DecodeOptions) -> DataFrame:
    rows = csv_rows(spark, path, options)
    return rows.withColumn("data", entries_to_variant(F.col("cells"), typed_variant))


DECODERS: dict[str, Decoder] = {"csv": _csv, "xlsx": xlsx_rows}


def register_decoder(extension: str, decoder: Decoder) -> None:
    DECODERS[extension.lower().lstrip(".")] = decoder


def decode(spark: SparkSession, path: str | list[str], extension: str, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    return DECODERS[extension.lower().lstrip(".")](spark, path, options).select(*ROW_COLUMNS)
