"""Links among items that meet in cells, without all pairs of a cell."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import batch_of, forget, settled
from docrecon.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE = 512  # items of a cell that are searched as one index


def meetings(named: DataFrame) -> DataFrame:
    """``(cell, node, lead)`` for cells with several nodes; ``lead`` is the least of them.

    ``named(cell, node)`` may repeat rows.  They shuffle once and pass in order; a task holds one
    batch and one row of a cell, however large the cell.
    """
    schema = pa.schema([("cell", pa.int64()), ("node", pa.int64()), ("lead", pa.int64())])
    n = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches):
        # Of the cell that is under way: its name, least and last node, and whether it was written.
        cell = lead = last = None
        written = False
        for b in batches:
            c, x = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(c):
                continue
            start = 0 if cell is None else 1
            if start:
                c, x = np.append(cell, c), np.append(last, x)
            fresh = np.ones(len(c), bool)
            fresh[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1])
            c, x = c[fresh], x[fresh]
            begins = np.ones(len(c), bool)
            begins[1:] = c[1:] != c[:-1]
            at = np.flatnonzero(begins)
            size = np.diff(np.append(at, len(c)))
            leads = np.repeat(x[at], size)
            several = np.repeat(size > 1, size)
            if start:
                leads[:size[0]] = lead
                several[:size[0]] = size[0] > 1 or written
                if written or size[0] == 1:
                    several[0] = False  # that row is written, or waits for another
            else:
                lead = x[0]
            yield batch_of(schema, c[several], x[several], leads[several])
            written = bool(size[-1] > 1 or (len(size) == 1 and start and written))
            cell, lead, last = c[-1], leads[-1], x[-1]

    dealt = named.select("cell", "node").repartition(n, "cell").sortWithinPartitions("cell", "node")
    return dealt.mapInArrow(work, "cell long, node long, lead long")


def linked(
    cells: DataFrame,
    prepare: Callable[[DataFrame], tuple[Callable[[DataFrame], DataFrame], DataFrame, list]],
    search: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``(node, component)`` of all nodes with a link; ``cells`` is what ``meetings`` returns, written.

    Every node is first compared with the least of its leads, then with those of its leads that are
    still in another component: about as many pairs as nodes, which settles groups of near copies.
    Cells whose nodes are then still in several components are searched page by page: all nodes
    outside the lead's component look up all pages.  So every pair across components that shares a
    cell is either compared or excluded by the search's bound.

    ``prepare(pairs)`` gets the first pairs ``(a, b)``.  It returns a function from pairs to those
    that hold, a table ``(node, ...)`` of what a search needs, and tables to forget afterwards.  ``search`` gets rows
    ``(cell, page, probe, node, label, ...)`` and returns pairs ``(a, b)`` with ``a < b``.
    """
    star = settled(
        cells.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "cell-star")
    holds, known, used = prepare(star)
    sure = settled(holds(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), "cell-links")
    label = components(sure)
    ends = [label.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab"]
    apart = star.join(ends[0], "a", "left").join(ends[1], "b", "left").where(
        F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    also = settled(holds(apart), "cell-links")
    links = sure.union(also)
    first = label if also.isEmpty() else components(links)

    labelled = cells.join(first, "node", "left").select(
        "cell", "node", F.coalesce("component", "node").alias("label"))
    several = labelled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.min_by("label", "node").alias("main"), F.expr("bit_xor(xxhash64(node))").alias("same1"),
        F.sum(F.expr("shiftright(xxhash64(node), 24)")).alias("same2"),
    ).where("members > 2 and low <> high")
    # Cells with the same nodes need one search.
    once = settled(
        several.groupBy("members", "main", "same1", "same2").agg(F.min("cell").alias("cell")), "cell-mixed")
    rest = settled(
        labelled.join(once.select("cell", "members", "main"), "cell").join(known, "node"), "cell-rest")
    others = [c for c in known.columns if c != "node"]
    pages = F.ceil(F.col("members") / PAGE).cast("int")
    indexed = rest.select(
        "cell", F.pmod(F.xxhash64("node"), pages).cast("int").alias("page"), F.lit(False).alias("probe"),
        "node", "label", *others)
    probes = rest.where("label <> main").select(
        "cell", F.explode(F.sequence(F.lit(0), pages - 1)).alias("page"), F.lit(True).alias("probe"),
        "node", "label", *others)
    found = search(indexed.union(probes)).join(star, ["a", "b"], "left_anti")
    more = settled(holds(found), "cell-links")
    out = first if more.isEmpty() else components(links.union(more))
    older = {id(x): x for x in (label, first) if x is not out}
    forget(star, sure, also, more, *older.values(), once, rest, *used)
    return out


def grouped(batches, fields: list[str], flat: str, width: int):
    """``(held rows, probe rows)`` of each page in sorted batches of ``search`` input, as lists of
    columns; ``flat`` is a list column of ``width`` numbers."""
    group, held = None, []
    for b in batches:
        cell, page, probe = (b.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "page", "probe"))
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in fields]
        columns.append(b.column(flat).flatten().to_numpy().reshape(-1, width))
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(page) != 0) | (np.diff(probe) != 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
            if i == j:
                continue
            if (cell[i], page[i]) != group:
                group, held = (cell[i], page[i]), []
            part = [x[i:j] for x in columns]
            if not probe[i]:
                held.append(part)
            elif held:
                if len(held) > 1:
                    held[:] = [[np.concatenate(x) for x in zip(*held)]]
                yield group, held[0], part
