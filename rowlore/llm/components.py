"""Connected components of a graph given as links between numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlore.plans.sizing import materialize

LINKS = "src long, dst long"


def roots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node reachable from each) of the links left-right."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as links to the smallest node of their component there."""
    for batch in batches:
        nodes, root = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        own = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], names=["src", "dst"])


def _closer(links: DataFrame) -> DataFrame:
    """One round: each node's larger neighbours, then its smaller ones, are linked to the smallest node near it.

    Neither half takes components apart or joins two; the number of links does not
    grow. Minima are combined before the shuffle, and a node with very many
    links is a skewed key of a plain join, which AQE splits.
    """
    both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least("src", F.min("dst")).alias("low"))
    large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    down = large.filter("src <> dst").distinct()
    least = down.groupBy("src").agg(F.min("dst").alias("low"))
    small = down.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return small.union(least.select("src", F.col("low").alias("dst"))).filter("src <> dst").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (src, dst), the component being its smallest node.

    Null ends and links of a node to itself add nothing. Each round writes its
    links to the shared folder, so lineage stays short and a lost executor costs a
    re-read. The rounds end when every link leads to a smallest node: about as
    many as the logarithm of the longest path.
    """
    ends = links.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst")
    now = materialize(ends.mapInArrow(_stars, LINKS).distinct(), "links")
    while True:
        # Done when no node has two links and no end of a link has one of its own.
        linked = now.groupBy("src").agg(F.count("*").alias("n"))
        chained = now.select(F.col("dst").alias("src")).join(linked, "src", "left_semi")
        if linked.filter("n > 1").isEmpty() and chained.isEmpty():
            break
        now = materialize(_closer(now), "links")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
