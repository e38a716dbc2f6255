"""Delimited text to one record per line, in JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlore.functions.maps import last_wins
from rowlore.functions.names import normalize_header
from rowlore.model import DecodeOptions
from rowlore.plans.sizing import broadcast_if_small, materialize
from rowlore.sources.folders import file_name, part_number, whole_path

# A line never holds a line break, so it can stand for a field separator.
SEPARATOR = "\n"
CELLS = "array<struct<key:string,value:string>>"


def split_line(line: Column) -> Column:
    """Fields of one line; a quote toggles quoting anywhere, a doubled one inside quotes is a quote.

    Between quotes every second piece is quoted text. An empty piece outside
    quotes, between two others, is a doubled quote seen from inside.
    """
    marked = F.transform(
        F.split(line, '"', -1),
        lambda s, i: F.when(i % 2 == 1, s)
        .when((s == "") & (i > 0), F.lit('"'))
        .otherwise(F.replace(s, F.lit(","), F.lit(SEPARATOR))),
    )
    # The empty piece after a closing quote at the end of the line is no doubled quote.
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    closed = line.endswith('"') & (quotes % 2 == 0)
    joined = F.array_join(marked, "")
    quoted = F.split(
        F.when(closed, F.regexp_replace(joined, r'"\z', "")).otherwise(joined), SEPARATOR, -1
    )
    plain = F.split(line, ",", -1)
    return (
        F.when(line == "", F.array().cast("array<string>"))
        .when(F.contains(line, F.lit('"')), quoted)
        .otherwise(plain)
    )


def numbered_lines(spark: SparkSession, path: str | list[str], pattern: str = "*.csv", recursive: bool = True) -> DataFrame:
    """Lines with their path, block and row id; ids grow by one within a block."""
    return (
        spark.read.option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", pattern)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )


def header_names(fields: Column, options: DecodeOptions) -> Column:
    named = F.transform(fields, normalize_header) if options.normalize_headers else fields
    return F.transform(
        named,
        lambda h, i: F.when(
            F.trim(h) == "", F.concat(F.lit(options.column_prefix), (i + 1).cast("string"))
        ).otherwise(h),
    )


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    options: DecodeOptions = DecodeOptions(),
    pattern: str = "*.csv",
    recursive: bool = True,
    whole: bool = False,
) -> DataFrame:
    """Every line below the header with its 1-based number, fields and the file's header.

    Files stay splittable. One pass counts the lines of each file block and takes its first
    one, which is the header of the block that begins the file; one reads the rows. Headers
    further down take a pass of their own. The small tables between
    them are written to the shared folder. The lines themselves are not shuffled
    while the block table is provably small; beyond the bound the join shuffles
    on (path, block), whose groups are one block large. With `whole`, the parts of one
    write are one file: each has a header, and lines are numbered on from part to part.
    """
    lines = numbered_lines(spark, path, pattern, recursive)
    per_block = lines.groupBy("path", "block").agg(F.min("rid").alias("first"), F.count("*").alias("n"), F.min_by("value", "rid").alias("top"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    header_line = options.header_row_index + 1
    placed_blocks = per_block.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("skipped", F.lit(0))
    if whole:
        below = F.greatest(F.col("n") + F.least(F.col("offset") - header_line, F.lit(0)), F.lit(0))
        so_far = Window.partitionBy(whole_path(F.col("path"))).orderBy(part_number(F.col("path")), "path")
        earlier = F.sum(below).over(so_far) - F.sum(below).over(Window.partitionBy("path"))
        placed_blocks = placed_blocks.withColumn("skipped", earlier)
    counted = materialize(placed_blocks.drop("n"), "blocks")
    blocks = counted.drop("top")
    at = F.col("rid") - F.col("first") + F.col("offset") + 1
    lost = F.raise_error("a file changed or was split differently while it was read")
    line = F.when(F.col("first").isNotNull(), at).otherwise(lost.cast("bigint"))
    placed = lines.join(broadcast_if_small(blocks), ["path", "block"], "left").withColumn("line", line.cast("int"))
    if header_line == 1:
        first = counted.where(F.col("offset") == 0).withColumn("value", F.col("top"))
    else:
        first = placed.where(F.col("line") == header_line)
    headers = materialize(first.select("path", header_names(split_line(F.col("value")), options).alias("header")), "headers")
    return (
        placed.where(F.col("line") > header_line)
        .join(broadcast_if_small(headers), "path", "left")
        .select(
            "path",
            file_name(F.col("path")).alias("file"),
            (F.col("line") + F.col("skipped")).cast("int").alias("row_number"),
            F.col("value").alias("raw"),
            split_line(F.col("value")).alias("fields"),
            "header",
        )
    )


def line_cells(fields: Column, header: Column, options: DecodeOptions) -> Column:
    """Ordered entries of one line: extra fields get generated names, missing ones no entry."""
    return F.transform(
        fields,
        lambda v, i: F.struct(
            F.coalesce(
                F.get(header, i), F.concat(F.lit(options.column_prefix), (i + 1).cast("string"))
            ).alias("key"),
            F.when(v == "", F.lit(options.blank_value)).otherwise(v).alias("value"),
        ),
    )


def csv_rows(
    spark: SparkSession,
    path: str | list[str],
    options: DecodeOptions = DecodeOptions(),
    pattern: str = "*.csv",
    recursive: bool = True,
    whole: bool = False,
) -> DataFrame:
    """`(path, file, worksheet, row_number, cells, is_empty)`, one row per data line.

    Empty lines, judged on their data fields, are left out unless the options
    keep them. `whole` takes the parts of one write as one file.
    """
    lines = read_lines(spark, path, options, pattern, recursive, whole)
    cells = (
        lines.withColumn("_cells", line_cells(F.col("fields"), F.col("header"), options))
        .withColumn("cells", last_wins(F.col("_cells")).cast(CELLS))
        .withColumn("is_empty", ~F.exists("cells", lambda e: e["value"] != ""))
        .select("path", "file", F.col("file").alias("worksheet"), "row_number", "cells", "is_empty")
    )
    return cells.where(~F.col("is_empty")) if options.skip_empty_rows else cells
