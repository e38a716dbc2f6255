"""Size checks before a broadcast, and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Inputs below this many bytes per core are worth one shuffle before CPU-heavy work.
SPREAD_BYTES = 32 << 20
# Bytes of a sorted range, as estimated.
RANGE_BYTES = 64 << 20


def measured(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[int, int]:
    """Rows and JSON bytes of a side, counting no further than `max_rows + 1` rows."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))
    row = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only for a side proven small; else leave the join to AQE.

    Beyond the bound the same join runs as a shuffle join, where AQE splits
    skewed partitions.
    """
    rows, size = measured(df, max_rows)
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input too small to fill them, such as a single row group.

    A table of the size a cluster is for is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def in_ranges(df: DataFrame, *columns: str) -> DataFrame:
    """Rows sorted over all tasks, of RANGE_BYTES or so at most: more ranges than shuffles have where those do not do."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-size // RANGE_BYTES)
    more = (parts,) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
    return df.repartitionByRange(*more, *columns).sortWithinPartitions(*columns)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in `spark.checkpoint.dir`. Only with a local master, as in
    tests, a folder of this machine stands in where that is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or os.path.join(tempfile.gettempdir(), "rowlore-scratch")


# Paths given out by this driver, until they are cleared.
_MADE: list[str] = []


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    _MADE.append(f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Remove what this driver has written aside so far; results that still read it must be done with."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in _MADE]
    _MADE.clear()
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True) for p in paths)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written table that survives a lost executor."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)
