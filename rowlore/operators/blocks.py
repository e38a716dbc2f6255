"""Texts of any size put together in order, as numbered blocks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlore.plans.sizing import broadcast_if_small, materialize

# Rows of one block.
BLOCK_ROWS = 64


def numbered(df: DataFrame, by: tuple[str, ...], order: tuple[Column | str, ...], name: str = "row") -> DataFrame:
    """Rows numbered from 1 within `by`, in an order that is total there.

    Rows are sorted by ranges of group and order, so a group of any size is spread over
    partitions. Each counts its own; what earlier partitions have of a group is
    added from one row per partition and group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    placed = materialize(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    ends = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    starts = broadcast_if_small(ends.select(F.col("_part").alias("_p"), "_first", "_before", *(F.col(c).alias(f"_{c}") for c in by)))
    same = reduce(and_, [F.col("_p") == F.col("_part"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)])
    row = (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name)
    return placed.join(starts, same).select(*df.columns, row)


def text_blocks(df: DataFrame, by: tuple[str, ...], texts: dict[str, tuple[Column, str]], rows: int = BLOCK_ROWS, row: str = "row") -> DataFrame:
    """`(by..., block, first_row, rows, texts...)` of numbered rows: each text is a column of lines and what joins them.

    A group's whole text is its blocks in order, joined the same way. Lines that are null
    are left out. A block gathers `rows` rows, however many its group has.
    """
    block = F.floor((F.col(row) - 1) / rows)
    named = df.select(*by, F.col(row).alias("_row"), block.alias("block"), *(line.alias(f"_{name}") for name, (line, _) in texts.items()))
    listed = F.array_sort(F.collect_list(F.struct("_row", *(f"_{name}" for name in texts))))
    grouped = named.groupBy(*by, "block").agg(F.min("_row").alias("first_row"), F.count("*").alias("rows"), listed.alias("_lines"))

    def joined(name: str, between: str) -> Column:
        lines = F.filter(F.transform("_lines", lambda e: e[f"_{name}"]), lambda t: t.isNotNull())
        return F.array_join(lines, between).alias(name)

    return grouped.select(*by, "block", "first_row", "rows", *(joined(name, between) for name, (_, between) in texts.items()))
