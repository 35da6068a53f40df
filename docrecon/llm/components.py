"""Connected components of links, without ever bringing links or components to the driver."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import batch_of, forget, settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD = 1 << 20  # links a task joins at once
FILE_ROWS = 100_000  # links that need no further task or file


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(high, low)``: every node of the links but the least of its component, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != root[root]).any():
            root = root[root]
    high = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[high], nodes[root[high]]


def _joined(edges: DataFrame) -> DataFrame:
    """Links that join the same nodes; each task turns those that it holds into stars."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64())])

    def work(batches):
        held, rows = [], 0
        for b in batches:
            held.append([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            rows += b.num_rows
            if rows >= HELD:
                yield batch_of(schema, *forest(*[np.concatenate(x) for x in zip(*held)]))
                held, rows = [], 0
        if rows:
            yield batch_of(schema, *forest(*[np.concatenate(x) for x in zip(*held)]))

    return edges.select("high", "low").mapInArrow(work, "high long, low long")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as so many rows need; small tables have no hundreds of files."""
    n = max(1, -(-rows // FILE_ROWS))
    return df.coalesce(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _star(edges: DataFrame, rows: int) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, move to its least one.

    ``edges`` has ``high > low``.  The least neighbour is a sum over each task first; the joins are
    on the node, and Spark splits a node with many edges, as the other side is written before.
    """
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.toDF("node", "other")
    least = settled(
        _few(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least")), rows), "least")
    large = both.where(F.col("other") > F.col("node")).join(least, "node").select(
        F.col("other").alias("high"), F.col("least").alias("low")).distinct()
    large = settled(_few(large, rows), "large-star")
    own = settled(_few(large.groupBy("high").agg(F.min("low").alias("least")), rows), "least")
    joined = large.join(own, "high")
    small = joined.select(F.col("low").alias("high"), F.col("least").alias("low")).where("high <> low")
    moved = small.union(own.select("high", F.col("least").alias("low")))
    out = settled(_few(_joined(_few(moved, rows)).distinct(), rows), "star")
    forget(least, large, own, edges)
    return out


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a lesser node, or links to larger ones only."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("low", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.agg(F.count(F.expr("if(up > 1 or up = 1 and down = 1, 1, null)"))).first()[0] == 0


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``(node, component)``, written, for all nodes of ``links(a, b)``; the component is its least
    node.

    Tasks join the links that they hold; alternating large and small stars join those of different
    tasks.  Rounds grow with the logarithm of the nodes.  Only counts reach the driver.  ``rows`` is the
    number of links, for callers whose ``links`` is not written.
    """
    rows = links.count() if rows is None else rows
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    edges = settled(_few(_joined(_few(edges, rows)).distinct(), rows), "links")
    while not _all_stars(edges):
        edges = _star(edges, rows)
    ends = F.explode(F.array("high", "low")).alias("node")
    out = settled(_few(edges.select(ends, F.col("low").alias("component")).distinct(), rows), "components")
    forget(edges)
    return out


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that gave ``label``, and of ``links(a, b)``, both written.

    Only links between components of ``label`` are searched; the rest keep or change their name.
    """
    ends = [label.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    over = components(between, links.count())
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti")
    named = label.select("node", "component").union(new.select("node", F.col("node").alias("component")))
    names = over.select(F.col("node").alias("component"), F.col("component").alias("name"))
    out = settled(_few(named.join(names, "component", "left").select(
        "node", F.coalesce("name", "component").alias("component")), label.count()), "components")
    forget(over)
    return out
