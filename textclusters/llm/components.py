"""Connected components of a graph whose links are rows of a DataFrame."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textclusters.llm.shared import cut


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest node of its component.

    Labels sink by minimum and pointer jumping until no link joins two labels.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        p, q = label[x], label[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of each batch by a spanning star per component."""
    for batch in batches:
        node, root = spanning_links(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])


def connected_components(links: DataFrame) -> DataFrame:
    """Columns (node, root) for every node of links(a, b): root is the smallest
    node of its component; nodes that are their own root are left out.

    Alternating large-star and small-star rounds: every node hands its larger
    neighbours, then its smaller ones, to the smallest neighbour that it knows.
    The rounds are logarithmic in the number of nodes in practice. Nothing but
    one count and one checksum for each round comes to the driver. A node with
    very many links is a join key, which Spark splits where it is skewed.
    """
    rows = links.selectExpr("cast(a AS bigint) AS a", "cast(b AS bigint) AS b").where("a <> b")
    rows = cut(rows.mapInArrow(_contract, "node long, root long").distinct())
    known = None
    while True:
        both = rows.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(rows.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        rows = cut(small.select(F.col("x.u").alias("node"), F.col("x.m").alias("root")).where("node > root").distinct())
        now = rows.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).first()
        if now == known:
            return rows
        known = now
