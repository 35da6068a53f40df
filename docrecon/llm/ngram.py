"""N-gram Jaccard join: documents as points of group counts, in count-vector R-trees.

Shingles are hashed into groups; how many fall in each group is a document's point.  Two sets share
at most the sum of the coordinate minima, so an R-tree over points finds every pair that could
reach the threshold, and those are verified exactly.

One tree over all documents would be one task, so points are first dealt into cells, each with a
tree of its own.  Sets that reach the threshold differ in at most k shingles; of more than k groups,
at least one has the very same shingles in both.  The hash of a group's content therefore names a
cell, and no pair is lost.  Cells that only one set has need no tree: a filter of cells seen twice
keeps them out of the shuffle.

The trees are searched twice.  First each point looks up the likeliest of the points before it in
its tile, about one pair a point, which joins groups of near copies.  Where a cell then still holds
several components, its points look up all points of other components in all tiles of like size.
Near sets share many cells, so each node lists its least ones: a pair is written in the first cell
that both list, and only if points finer than the tree's allow the threshold.

A node has a row in each of its cells, so written cells hold no points.  Both searches deal them with
their points slice by slice, and the disk holds the points of one slice at a time.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm import bloom
from docrecon.llm.cells import PAGE, meetings
from docrecon.llm.common import batch_of, forget, raw_texts, settled
from docrecon.llm.components import components, extended

cloudpickle.register_pickle_by_value(sys.modules[__name__])

AXES = 64  # coordinates of a point
FAN = 16  # entries of a tree node
FILTER_BITS = 28  # of a filter over cells or sets; 32 MB
PROBES = 2  # bits of a key in a filter
HELD = 1 << 20  # bytes of text shingled at once
ASKED = 1 << 10  # points that look up a tree at once
LISTED = 16  # cells listed with a node
MIDDLE = 512  # groups of a middle point, at most
SPREADS = (((3, 2), 0.21), ((23, 20), 0.5))  # width of classes, spare groups for each that may differ
SLICES = 8  # slices of the cells that are searched one after another, at most
SLICE_ROWS = 400_000  # rows of cells that need no further slice
STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)


def word_hashes(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a lower-cased text that ends in white space."""
    b = np.frombuffer(stream, np.uint8)
    white = WHITE[b]
    turn = np.flatnonzero(np.diff(white, prepend=True))
    starts, ends = turn[::2], turn[1::2]
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    power = np.full(len(b), BASE)
    power[:1] = 1
    run = np.cumsum(BYTE[b] * np.cumprod(power))
    back = np.full(len(b), inverse)
    back[:1] = 1
    before = np.where(starts > 0, run[starts - 1], np.uint64(0))
    return mixed((run[ends - 1] - before) * np.cumprod(back)[starts]), starts


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words is one shingle."""
    stream = b"\n".join(texts).lower() + b"\n"
    w, starts = word_hashes(stream)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    weight = mixed(np.arange(1, words + 1, dtype=np.uint64) * BASE)
    inner = len(w) - words + 1
    rolled = np.zeros(max(inner, 0), np.uint64)
    if inner > 0:
        for k in range(words):
            rolled += w[k:k + inner] * weight[k]
        rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            some = (w[a:b] * weight[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([some], np.uint64) ^ STEP))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def in_parts(batches, column: str):
    """``(batch rows, texts)`` of about HELD bytes each."""
    for b in batches:
        texts, at, size = raw_texts(b.column(column)), 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= HELD or k + 1 == len(texts):
                yield b.slice(at, k + 1 - at), texts[at:k + 1]
                at, size = k + 1, 0


def spread(num: int, den: int) -> tuple[tuple[int, int], float]:
    """Width of the classes and share of spare groups with which few sets have more weak groups than
    spare ones, at a threshold of ``num / den``: the first of SPREADS that the smallest sets of a
    class allow, as counts in groups scatter about as Poisson's."""
    for (up, down), share in SPREADS:
        crowd = num / max(1, den - num) / (1 + share) * down / up  # shingles in a group
        if math.exp(-crowd) * (1 + crowd) <= 1.05 * share / (1 + share):
            break
    return (up, down), share


class Cells:
    """Cells of sets at a threshold of ``num / den``, in classes of the smaller set's size."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges, self.groups, self.spare = [1], [], []
        (up, down), share = spread(num, den)
        while self.edges[-1] < 1 << 40:
            low = self.edges[-1]
            high = max(low + 1, low * up // down)
            small = high - 1
            differ = (small + small * den // num) * (den - num) // (den + num)
            spare = math.ceil(share * differ) + 1 if differ else 0  # about as many groups are weak
            self.edges.append(high)
            # No difference allowed: equal sets only, which need no cell.
            self.groups.append(differ + 1 + spare if differ else 0)
            self.spare.append(spare)

    def classes(self, n: int) -> range:
        """Classes in which a set of ``n`` may meet a partner."""
        least = -(-n * self.num // self.den)
        at = np.searchsorted(self.edges, [least, n], "right") - 1
        return range(int(at[0]), int(at[1]) + 1)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Cells of a sorted set.

        Weak groups, of one shingle or none, agree too easily: a common passage would make their
        cells meet.  With e spare groups at least e + 1 agree, so a set with no more than e weak
        groups needs no cell for them; a set with more gets them all.
        """
        out, high, scattered = [], s >> np.uint64(32), mixed(s ^ STEP)
        for c in self.classes(len(s)):
            groups = self.groups[c]
            if not groups:
                continue
            at = (high * np.uint64(groups)) >> np.uint64(32)  # ascending, as the set is
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            names, counts = at[starts], np.diff(np.append(starts, len(at)))
            content = np.add.reduceat(scattered, starts)
            cell = mixed(content ^ mixed(names + np.uint64(c << 40) + np.uint64(1)))
            if groups - int((counts > 1).sum()) <= self.spare[c]:
                out.append(cell[counts > 1])
            else:
                empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), names)
                out += [cell, mixed(mixed(empty + np.uint64(c << 40) + np.uint64(1)))]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def points_of(sets: list[np.ndarray]) -> np.ndarray:
    """Counts of each set's shingles in AXES groups."""
    return np.array([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=AXES) for s in sets],
                    np.int32).reshape(-1, AXES)


def fine_point(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in a power of two of groups, about four in each; a byte a group."""
    bits = max(6, (len(s) // 4).bit_length())
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    while counts.max() > 255:
        bits += 1
        counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes) -> int:
    """Summed coordinate minima of two fine points; the finer is folded to the other's groups."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) < len(q):
        p, q = q, p
    if len(p) > len(q):
        p = p.reshape(len(q), -1).sum(axis=1)
    return int(np.minimum(p, q).sum(dtype=np.int64))


def middle_point(fine: bytes) -> bytes:
    """A fine point in at most MIDDLE groups; a byte a group or, where that is too little, four."""
    if len(fine) <= MIDDLE:
        return fine
    counts = np.frombuffer(fine, np.uint8).reshape(MIDDLE, -1).sum(axis=1, dtype=np.uint32)
    return counts.astype(np.uint8 if counts.max() < 256 else "<u4").tobytes()


class Forest:
    """Packed R-trees, one a group: every node keeps the largest count of each coordinate below it
    and the smallest size, which bound the overlap of a query with all of it."""

    def __init__(self, group: np.ndarray, at: np.ndarray, size: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        # Tile by size, then by the coordinates' differences, so that near points share nodes.
        self.order = np.lexsort((at[:, 1], at[:, 0], size, group))
        group, top, least = group[self.order], at[self.order], size[self.order]
        self.levels = [(top, least, None, None)]
        while True:
            begins = np.ones(len(group), bool)
            begins[1:] = group[1:] != group[:-1]
            start = np.flatnonzero(begins)
            if len(start) == len(group):
                break
            place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
            cut = np.flatnonzero(place % FAN == 0)
            below = np.diff(np.append(cut, len(group)))
            group, top, least = group[cut], np.maximum.reduceat(top, cut), np.minimum.reduceat(least, cut)
            self.levels.append((top, least, cut, below))
        self.roots = group

    def near(self, group: np.ndarray, at: np.ndarray, size: np.ndarray):
        """``(query, point, shared)``: indices of points in the query's group, whose summed
        coordinate minima ``shared`` allow the threshold."""
        node = np.searchsorted(self.roots, group)
        there = node < len(self.roots)
        there[there] = self.roots[node[there]] == group[there]
        query, node = np.flatnonzero(there), node[there]
        shared = np.zeros(len(query), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least, _, _ = self.levels[depth]
            if depth < len(self.levels) - 1:
                _, _, cut, below = self.levels[depth + 1]
                many = below[node]
                first = np.cumsum(many) - many
                inside = np.arange(int(many.sum())) - np.repeat(first, many)
                query, node = np.repeat(query, many), np.repeat(cut[node], many) + inside
            shared = np.zeros(len(query), np.int64)
            for a in range(0, len(query), 1 << 14):
                q, x = query[a:a + (1 << 14)], node[a:a + (1 << 14)]
                shared[a:a + (1 << 14)] = np.minimum(at[q], top[x]).sum(axis=1)
            # overlap o of sets a and b reaches num/den when (num + den) o >= num (a + b)
            keep = (self.num + self.den) * shared >= self.num * (size[query] + least[node])
            query, node, shared = query[keep], node[keep], shared[keep]
        return query, self.order[node], shared


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def named(s: np.ndarray) -> int:
    """Hash of a set, signed."""
    return int(_signed(mixed(mixed(s).sum(dtype=np.uint64, keepdims=True)))[0])


def described(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``(id, size, node, at, fine)`` of every row, and rows ``(segment, once, twice)`` of the filters over
    cells, in one pass; ``node`` is the hash of the set, equal for equal sets, ``at`` its point and
    ``fine`` its fine point."""
    rows = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("node", pa.int64()), ("at", pa.list_(pa.int32())),
                      ("fine", pa.binary())])
    whole = pa.schema([*rows, *bloom.PARTIAL])

    def widened(batch):
        return pa.RecordBatch.from_arrays(
            [batch.column(f.name) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in whole],
            schema=whole)

    def work(batches):
        cells = Cells(num, den)
        seen: set[int] = set()  # sets of this task whose cells are in the filter already
        held, count = [], 0
        for b, texts in in_parts(batches, "text"):
            sets = shingle_sets(texts, words)
            nodes = [named(s) if len(s) else None for s in sets]
            yield widened(batch_of(rows, b.column("id"), [len(s) for s in sets], nodes, list(points_of(sets)),
                                   [fine_point(s) for s in sets]))
            if len(seen) > 1_000_000:
                seen.clear()
            for s, node in zip(sets, nodes):
                if len(s) and node not in seen:
                    seen.add(node)
                    held.append(bloom.positions(cells.keys(s), FILTER_BITS, PROBES).ravel())
                    count += held[-1].size
                    if count >= bloom.HELD:
                        yield widened(bloom.packed(held))
                        held, count = [], 0
        if count:
            yield widened(bloom.packed(held))

    return docs.mapInArrow(work, f"id long, size long, node long, at array<int>, fine binary, {bloom.PARTIAL_DDL}")


def cells_of(docs: DataFrame, words: int, num: int, den: int, twice: np.ndarray) -> DataFrame:
    """``(cell, node, lead)``, written, of the cells that pass the filter ``twice`` and several nodes have."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)
    schema = pa.schema([("cell", pa.int64()), ("node", pa.int64())])

    def work(batches):
        cells = Cells(num, den)
        seen: set[int] = set()  # sets of this task whose cells are written already
        for _, texts in in_parts(batches, "text"):
            names, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            if len(seen) > 1_000_000:
                seen.clear()
            for s in shingle_sets(texts, words):
                node = named(s) if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                keys = cells.keys(s)
                keys = keys[bloom.passes(shared.value, keys, PROBES)]
                names.append(keys)
                nodes.append(np.full(len(keys), node))
            yield batch_of(schema, _signed(np.concatenate(names)), np.concatenate(nodes))

    out = settled(meetings(docs.select("text").mapInArrow(work, "cell long, node long")), "ngram-cells")
    shared.destroy()
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, shingles)``, written, of the named sets, once each.

    A filter of fixed size over the names keeps the other documents' sets out of the shuffle.
    """
    def bits(batches):
        yield from bloom.partial_filters(
            (b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches), FILTER_BITS, PROBES)

    wanted = bloom.merged(nodes.select("node").mapInArrow(bits, bloom.PARTIAL_DDL), FILTER_BITS, twice=False)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def work(batches):
        seen: set[int] = set()
        for _, texts in in_parts(batches, "text"):
            sets = [s for s in shingle_sets(texts, words) if len(s)]
            node = np.array([named(s) for s in sets], np.int64)
            ok = np.flatnonzero(bloom.passes(shared.value, node.view(np.uint64), PROBES)) if len(sets) else []
            mine = list({int(node[k]): k for k in ok if int(node[k]) not in seen}.values())
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(int(node[k]) for k in mine)
            yield batch_of(schema, node[mine] if mine else [], [_signed(sets[k]) for k in mine])

    found = docs.select("text").mapInArrow(work, "node long, shingles array<long>")
    out = settled(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "ngram-shingles")
    shared.destroy()
    return out


def bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` whose fine points allow the threshold: a set's fine point is some thirty
    times smaller than the set, so few sets meet that do not link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches):
        for b in batches:
            least = -(-num * b.column("sizes").to_numpy(zero_copy_only=False) // (num + den))
            fits = [most_shared(x.as_py(), y.as_py()) >= k for x, y, k in zip(b.column("x"), b.column("y"), least.tolist())]
            keep = pa.array(fits, pa.bool_())
            yield batch_of(schema, b.column("a").filter(keep), b.column("b").filter(keep))

    left = points.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("fine").alias("x"))
    right = points.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("fine").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("m") + F.col("n")).alias("sizes"), "x", "y")
    return both.mapInArrow(work, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(den * common >= num * (F.size("x") + F.size("y") - common)).select("a", "b")


def sliced_cells(rows: DataFrame, search: Callable[[DataFrame], DataFrame], name: str) -> list[DataFrame]:
    """What ``search`` makes of slices of ``rows(cell, ...)``, written one after another; a cell is in
    one slice.  Together the slices are all rows."""
    n = min(SLICES, max(1, -(-rows.count() // SLICE_ROWS)))
    return [settled(search(rows if n == 1 else rows.where(F.pmod("cell", F.lit(n)) == k)), name) for k in range(n)]


def tiled(cells: DataFrame, sizes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``(cell, tile, page, members, node, size)`` and ``(cell, tile, pages)``, both written.

    Cells with the same nodes need one tree.  A cell of more than PAGE nodes is cut into tiles of
    like size and these into pages; sets that reach the threshold are at most one tile apart.
    """
    several = cells.groupBy("cell", "lead").agg(
        F.count(F.lit(1)).alias("members"), F.expr("bit_xor(xxhash64(node))").alias("same1"),
        F.sum(F.expr("shiftright(xxhash64(node), 24)")).alias("same2"))
    once = several.groupBy("members", "lead", "same1", "same2").agg(F.min("cell").alias("cell"))
    width = 1.000001 * math.log(den / num) or 1.0
    tile = F.when(F.col("members") > PAGE, F.floor(F.log("size") / width)).otherwise(0)
    placed = cells.select("cell", "node").join(once.select("cell", "members"), "cell").join(sizes, "node").withColumn(
        "tile", tile.cast("int"))
    placed = settled(placed, "cell-points")
    tiles = settled(placed.where(F.col("members") > PAGE).groupBy("cell", "tile").agg(
        F.ceil(F.count(F.lit(1)) / PAGE).cast("int").alias("pages")), "cell-tiles")
    paged = placed.join(tiles, ["cell", "tile"], "left").withColumn(
        "page", F.pmod(F.xxhash64("node"), F.coalesce("pages", F.lit(1))).cast("int")).drop("pages")
    paged = settled(paged, "cell-pages")
    forget(placed)
    return paged, tiles


def _columns(b: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    out = [b.column(k).to_numpy(zero_copy_only=False) for k in names]
    return [*out, b.column("at").flatten().to_numpy().reshape(-1, AXES)]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Ascending numbers of the runs of equal keys in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def likeliest(paged: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b, shared)``: for each point ``b`` the point ``a`` before it in its page whose bound is
    highest.

    Sorted rows pass in a stream: a task holds one batch and what came before it in its page.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.float64())])
    n = int(paged.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = _columns(b, ["cell", "tile", "page", "node", "size"])
            old = 0 if held is None else len(held[0])
            if old:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            group = _groups(*rows[:3])
            node, size, at = rows[3:]
            trees = Forest(group, at, size, num, den)
            for k in range(old, len(node), ASKED):
                some = slice(k, k + ASKED)
                q, p, shared = trees.near(group[some], at[some], size[some])
                q = q + k
                before = node[p] < node[q]
                q, p, shared = q[before], p[before], shared[before]
                likely = shared / (size[q] + size[p])
                best = np.lexsort((node[p], -likely, q))
                best = best[np.unique(q[best], return_index=True)[1]]
                yield batch_of(schema, node[p[best]], node[q[best]], likely[best])
            held = [x[group == group[-1]] for x in rows]

    dealt = paged.select("cell", "tile", "page", "node", "size", "at").repartition(
        n, "cell", "tile", "page").sortWithinPartitions("cell", "tile", "page", "node")
    return dealt.mapInArrow(work, "a long, b long, shared double")


class Middles:
    """Middle points of rows, each in its own number of groups, a power of two from AXES to MIDDLE."""

    def __init__(self, points: np.ndarray):
        length = np.array([len(x) for x in points], np.int64)
        self.width = np.minimum(length, MIDDLE)
        rows = [(np.flatnonzero(length == k), int(k)) for k in np.unique(length)]
        read = [(mine, np.frombuffer(b"".join(points[mine]), np.uint8 if k <= MIDDLE else "<u4").reshape(len(mine), -1))
                for mine, k in rows]
        self.at = {k: np.zeros((len(points), k), np.int32) for k in np.unique(self.width).tolist()}
        for k, folded in self.at.items():
            for mine, counts in read:
                if counts.shape[1] >= k:
                    folded[mine] = counts.reshape(len(mine), k, -1).sum(axis=2, dtype=np.int32)

    def coarse(self) -> np.ndarray:
        """Counts in AXES groups."""
        out = np.zeros((len(self.width), AXES), np.int32)
        for k, counts in self.at.items():
            mine = self.width == k
            out[mine] = counts[mine].reshape(-1, AXES, k // AXES).sum(axis=2, dtype=np.int32)
        return out

    def shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Summed coordinate minima of pairs of rows, in the groups of the coarser one."""
        out, width = np.zeros(len(p), np.int64), np.minimum(self.width[p], self.width[q])
        for k in np.unique(width).tolist():
            mine = np.flatnonzero(width == k)
            for a in range(0, len(mine), 1 << 12):
                some = mine[a:a + (1 << 12)]
                out[some] = np.minimum(self.at[k][p[some]], self.at[k][q[some]]).sum(axis=1)
        return out


def met_before(listed: np.ndarray, cell: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the rows of a pair both list a cell less than the one they meet in."""
    out = np.zeros(len(p), bool)
    for a in range(0, len(p), 1 << 12):
        x, y = listed[p[a:a + (1 << 12)]], listed[q[a:a + (1 << 12)]]
        less = x < cell[p[a:a + (1 << 12)], None]
        out[a:a + (1 << 12)] = ((x[:, :, None] == y[:, None, :]).any(axis=2) & less).any(axis=1)
    return out


def across(paged: DataFrame, tiles: DataFrame, label: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of points in different components that share a cell and whose
    bound allows the threshold.

    All points outside the component of a cell's least node look up all pages of like size.  In a cell
    of one page they are rows of the page themselves and look up those before them.  A pair meets in every cell it shares; it is left out where both nodes list a lesser one, in which it
    meets as well.  Where their lists have no cell in common, it is written in every cell."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    n = int(paged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["cell", "tile", "page", "probe", "known", "node", "size", "label", "listed", "middle"]

    def work(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(k).to_numpy(zero_copy_only=False) for k in columns]
            rows[8] = np.full((b.num_rows, LISTED), np.iinfo(np.int64).max)
            lists = b.column("listed")
            many = np.diff(lists.offsets.to_numpy())
            rows[8][np.arange(LISTED) < many[:, None]] = lists.flatten().to_numpy()
            old = 0 if held is None else len(held[0])
            if old:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            group = _groups(*rows[:3])
            cell, (probe, there), (node, size, of, listed, middle) = rows[0], (x.astype(bool) for x in rows[3:5]), rows[5:]
            asks = old + np.flatnonzero(probe[old:])
            known = np.flatnonzero(there)
            if len(asks) and len(known):
                middles = Middles(middle)
                at = middles.coarse()
                trees = Forest(group[known], at[known], size[known], num, den)
                for k in range(0, len(asks), ASKED):
                    some = asks[k:k + ASKED]
                    q, p, _ = trees.near(group[some], at[some], size[some])
                    q, p = some[q], known[p]
                    apart = (of[q] != of[p]) & ((p < q) | ~probe[p])
                    q, p = q[apart], p[apart]
                    first = ~met_before(listed, cell, q, p)
                    q, p = q[first], p[first]
                    fits = (num + den) * middles.shared(q, p) >= num * (size[q] + size[p])
                    x, y = node[q[fits]], node[p[fits]]
                    yield batch_of(schema, np.minimum(x, y), np.maximum(x, y))
            last = (group == group[-1]) & there
            held = [x[last] for x in rows]

    def listing(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("listed"),
                 pa.array([middle_point(x) for x in b.column("fine").to_pylist()], pa.binary())],
                names=["node", "listed", "middle"])

    # Of a cell of two nodes, the only pair has been looked up.
    narrow = paged.where("members > 2").select("cell", "tile", "page", "members", "node", "size")
    labelled = narrow.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    mixed_cells = labelled.groupBy("cell").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "node").alias("main")
    ).where("low <> high").select("cell", "main")
    inside = settled(labelled.join(mixed_cells, "cell"), "cell-inside")
    # A node has at most as many cells as a set has groups.
    least = inside.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("cell")), 1, LISTED).alias("listed"))
    about = settled(least.join(points.select("node", "fine"), "node").mapInArrow(
        listing, "node long, listed array<long>, middle binary"), "cell-about")
    asks = F.col("label") != F.col("main")
    role = lambda df, probe, known: df.withColumns({"probe": probe, "known": F.lit(known)})

    def search(part):
        members = part.join(about, "node")
        small = role(members.where(F.col("members") <= PAGE), asks, True).select(columns)
        several = members.where(F.col("members") > PAGE)
        indexed = role(several, F.lit(False), True).select(columns)
        large = role(several.where(asks), F.lit(True), False).drop("page").withColumn(
            "tile", F.explode(F.array(*[F.col("tile") + F.lit(k) for k in (-1, 0, 1)]))).join(
            tiles, ["cell", "tile"]).withColumn(
            "page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).select(columns)
        dealt = indexed.union(small).union(large).repartition(n, "cell", "tile", "page").sortWithinPartitions(
            "cell", "tile", "page", "probe")
        return dealt.mapInArrow(work, "a long, b long").distinct()

    parts = sliced_cells(inside, search, "cell-across")
    forget(inside, about)
    if len(parts) == 1:
        return parts[0]
    out = settled(functools.reduce(DataFrame.union, parts).distinct(), "cell-across")
    forget(*parts)
    return out


def joined(docs: DataFrame, cells: DataFrame, points: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``(node, component)``, written, of all nodes with a link; every pair that shares a cell is
    excluded by its bound, verified, or within a component already.

    Most groups are joined by one verified pair a node; then pairs that are still apart follow.
    ``cells`` is deleted once it is dealt into pages."""
    paged, tiles = tiled(cells, points.select("node", "size"), num, den)
    forget(cells)
    highest = lambda pairs: pairs.groupBy("a", "b").agg(F.max("shared").alias("shared"))
    parts = sliced_cells(paged, lambda part: highest(
        likeliest(part.join(points.select("node", "at"), "node"), num, den)), "cell-best")
    best = parts[0]
    if len(parts) > 1:
        best = settled(highest(functools.reduce(DataFrame.union, parts)), "cell-best")
        forget(*parts)
    nodes_of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    star = settled(bounded(best.select("a", "b"), points, num, den), "cell-star")
    sets = sets_of(docs, nodes_of(star), words)
    nearest = star.join(best, ["a", "b"]).groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    nearest = settled(nearest.select("a", "b"), "cell-nearest")
    sure = settled(verified(nearest, sets, num, den), "cell-links")
    label = components(sure)
    ends = [label.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab"]
    apart = star.join(nearest, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left").where(
        F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    also = settled(verified(apart, sets, num, den), "cell-links")
    first = label if also.isEmpty() else extended(label, also)
    others = across(paged, tiles, first, points, num, den)
    untried = settled(bounded(others.join(best, ["a", "b"], "left_anti"), points, num, den), "cell-others")
    unread = settled(nodes_of(untried).join(sets, "node", "left_anti"), "cell-unread")
    if unread.isEmpty():
        late, known = [], sets
    else:
        late = [sets_of(docs, unread, words)]
        known = sets.union(late[0].join(sets, "node", "left_anti"))
    more = settled(verified(untried, known, num, den), "cell-links")
    out = first if more.isEmpty() else extended(first, more)
    older = {id(x): x for x in (label, first) if x is not out}
    forget(best, star, nearest, paged, tiles, sets, sure, also, others, untried, unread, *late, more, *older.values())
    return out


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
    num: int = 85, den: int = 100,
) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row.

    A row's set is its distinct shingles of ``words`` words (A-Z lower-cased; a shorter text is one
    shingle; null or no words: empty and linked with nothing).  Rows link when their sets' Jaccard
    similarity is at least ``num / den``; ``component_id`` is the least id that links reach, the
    row's own included.  Rows are told apart by their sets, so repeated rows and ids are one class.
    A null id is no least id; where a component has no other, its ``component_id`` is null.  Other
    columns are not read.  Shingles and sets are told apart by 64-bit hashes.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    both = settled(described(docs, words, num, den), "ngram-sets")
    all_docs = both.where("segment is null")
    twice = bloom.merged(both.where("segment is not null").select("segment", "once", "twice"), FILTER_BITS)
    cells = cells_of(docs, words, num, den, twice)
    points = settled(all_docs.where("size > 0").groupBy("node").agg(
        F.min("id").alias("own"), F.first("size").alias("size"), F.first("at").alias("at"),
        F.first("fine").alias("fine")), "ngram-points")
    # The filters and the points of all rows are not needed any more.
    named_docs = settled(all_docs.select("id", "size", "node"), "ngram-rows")
    forget(both)
    label = joined(docs, cells, points, words, num, den)
    owned = settled(
        points.select("node", "own").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "ngram-named")
    lowest = owned.groupBy("component").agg(F.min("own").alias("low"))
    least = owned.join(lowest, "component").select("node", "low")
    out = settled(named_docs.join(least, "node", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id")), "ngram-components")
    forget(named_docs, points, label, owned)
    return out
