"""Ranked lexical search: presence masks group each item's documents, the best masks are scored first.

Every document keeps only the terms that some item asks for.  For an item, bitmaps of its terms are
laid over the documents of a task: a document's mask tells which terms it holds.  Documents with one
mask form a group, and no document of a group can score more than the terms of its mask allow.
Groups are evaluated from the highest such maximum down, until the maximum is below the worst score
that is still among the best ``k``; the rest need no score.  The best of all tasks are then ranked.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.common import batch_of, forget, raw_texts, settled, sliced

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A-Z are lower-cased; other ASCII but a-z and digits ends a term.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
TERMS = 1 << 17  # terms of items, with repeats, that one pass takes to every task
ROWS = 1 << 14  # documents held in a task at once
FIRST = 64  # documents scored at least before a threshold is looked at again
SPREAD = 64  # parts of an item's candidates that are cut to ``k`` before they meet
WORD = 64  # bits of a word of a mask


class Item(NamedTuple):
    """One item: its id, its terms' numbers and their weights."""

    number: int
    terms: np.ndarray
    weights: np.ndarray


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def contribution(tf, m):
    """Of one occurrence count in documents of normalised length ``m``, times 10**6 at most."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def masks_of(item: Item, rows_of: dict, size: int) -> np.ndarray:
    """Presence mask of every document: one row a document, ``WORD`` terms to a column."""
    masks = np.zeros((size, -(-len(item.terms) // WORD)), np.uint64)
    for k, term in enumerate(item.terms.tolist()):
        if term in rows_of:
            masks[rows_of[term][0], k // WORD] |= np.uint64(1 << k % WORD)
    return masks


def grouped(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a term, in order of their mask; the first of each distinct mask; the masks."""
    rows = np.flatnonzero(masks.any(axis=1))
    rows = rows[np.lexsort(masks[rows].T)]
    sorted_ = masks[rows]
    first = np.flatnonzero(np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)])) if len(rows) else rows
    return rows, first, sorted_[first]


def best(item: Item, rows_of: dict, m: np.ndarray, ids: np.ndarray, k: int, held) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of ``held`` (scores, ids) and of these documents, with all ties at the end.

    ``rows_of`` gives a term's documents and its counts there, ``m`` the normalised lengths.
    """
    scores, names = held
    rows, first, masks = grouped(masks_of(item, rows_of, len(m)))
    if not len(rows):
        return held
    least_m = np.minimum.reduceat(m[rows], first)
    most = np.zeros(len(first), np.int64)
    for j, term in enumerate(item.terms.tolist()):
        if term in rows_of:
            on = (masks[:, j // WORD] >> np.uint64(j % WORD)) & np.uint64(1) == 1
            most[on] += item.weights[j] * contribution(rows_of[term][1].max(), least_m[on])
    order = np.argsort(-most, kind="stable")
    ends = np.append(first[1:], len(rows))
    sizes = np.cumsum((ends - first)[order])
    at = 0
    while at < len(order):
        floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else 1
        if most[order[at]] < floor:
            break  # no group from here on can reach the k-th score
        upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + FIRST)) + 1
        take = [g for g in order[at:upto].tolist() if most[g] >= floor]
        chosen = np.sort(np.concatenate([rows[first[g]:ends[g]] for g in take]))
        got = np.zeros(len(chosen), np.int64)
        for j, term in enumerate(item.terms.tolist()):
            if term in rows_of:
                where, tf = rows_of[term]
                place = np.minimum(np.searchsorted(where, chosen), len(where) - 1)
                hit = where[place] == chosen
                got[hit] += item.weights[j] * contribution(tf[place[hit]], m[chosen[hit]])
        some = got > 0
        scores, names = np.concatenate([scores, got[some]]), np.concatenate([names, ids[chosen[some]]])
        at = upto
    if len(scores) > k:
        keep = np.lexsort((names, -scores))[:k]
        scores, names = scores[keep], names[keep]
    return scores, names


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(id, n, terms, counts)``, written: of each row of ``docs(id, text)`` with a term, how many
    terms it has and the counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def count(batches):
        number = shared.value
        for b in sliced(batches, 1000):
            ids, sizes, terms, counts = [], [], [], []
            for i, t in zip(b.column("id").to_pylist(), raw_texts(b.column("text"))):
                words = terms_of(t)
                if not words:
                    continue
                seen = Counter(filter(number.__contains__, words))
                ids.append(i)
                sizes.append(len(words))
                terms.append([number[w] for w in seen])
                counts.append(list(seen.values()))
            yield batch_of(schema, ids, sizes, terms, counts)

    return settled(docs.mapInArrow(count, "id long, n long, terms array<int>, counts array<int>"), "search-postings")


def candidates(rows: DataFrame, items: list[Item], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(item_id, id, score)``: the best ``k`` of each task for each item."""
    shared = rows.sparkSession.sparkContext.broadcast([tuple(x) for x in items])
    schema = pa.schema([("item_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    last = (1 << 63) - 1  # stands for a null id, which comes last among equal scores

    def blocks(batches):
        """Tables of at most ``ROWS`` documents."""
        waiting, size = [], 0
        for b in sliced(batches, ROWS):
            if size + b.num_rows > ROWS:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, size = [], 0
            waiting.append(b)
            size += b.num_rows
        if size:
            yield pa.Table.from_batches(waiting).combine_chunks()

    def find(batches):
        asked = [Item(*x) for x in shared.value]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
        for block in blocks(batches):
            flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in block.column(name).chunks])
            terms, counts = flat("terms"), flat("counts").astype(np.int64)
            owner = np.repeat(np.arange(block.num_rows), pc.list_value_length(block.column("terms")).to_numpy())
            order = np.lexsort((owner, terms))
            terms, counts, owner = terms[order], counts[order], owner[order]
            names, starts = np.unique(terms, return_index=True)
            ends = np.append(starts[1:], len(terms))
            rows_of = {t: (owner[a:z], counts[a:z]) for t, a, z in zip(names.tolist(), starts.tolist(), ends.tolist())}
            m = 50 + (50 * block.column("n").to_numpy() * n_docs) // n_terms
            ids = pc.fill_null(block.column("id"), last).to_numpy()
            found = [best(item, rows_of, m, ids, k, held) for item, held in zip(asked, found)]
        for item, (scores, ids) in zip(asked, found):
            yield batch_of(schema, [item.number] * len(ids), pa.array(ids, mask=ids == last), scores)

    return rows.mapInArrow(find, "item_id long, id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item, cut in parts first, so that no task gets all of an item's."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]

    def cut(df: DataFrame, *by: Column) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)

    item = F.col("item_id")
    return cut(cut(found, item, F.pmod(F.xxhash64("id"), F.lit(SPREAD))).drop("rank"), item)


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(item, rank, id, score)``: the ``k`` highest-scoring documents of every item, scores above 0.

    Terms are runs of ASCII letters and digits and of all other characters outside ASCII; only A-Z
    are lower-cased.  A term weighs ``floor(1000 * ln((2N + 2) / (2 df + 1)))`` and adds to a
    document ``weight * (10**9 tf div (1000 tf + 20 m))``, where ``m`` is 50 plus 50 times the
    document's terms over the mean.  Equal scores go by ascending id, a null id last.

    Every row of ``docs`` is a document, repeated rows too; null and empty texts have no terms, and
    count nowhere.  Rows with one item id are one item, whose terms are those of all its texts; a
    null id is an item as well.  An item without a document that scores gives no rows, and so do
    empty tables.  Other columns are not read.

    Items go to the tasks by broadcast, at most ``TERMS`` terms at a time: more items mean more
    passes, each over all documents.  A task holds ``ROWS`` documents and ``k`` rows an item.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary())])

    def split(batches):
        for b in batches:
            pairs = [(i, w) for i, t in zip(b.column("item_id").to_pylist(), raw_texts(b.column("text"))) for w in set(terms_of(t))]
            yield batch_of(schema, [i for i, _ in pairs], [w for _, w in pairs])

    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    asked = settled(asked.mapInArrow(split, "item_id long, term binary").distinct(), "search-items")
    passes = -(-asked.count() // TERMS)
    out = spark.createDataFrame([], "item_id long, id long, score long")
    for at in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == at).toArrow()
        vocabulary = {w: j for j, w in enumerate(sorted(set(part.column("term").to_pylist())))}
        of: dict[int | None, list[int]] = {}
        for i, w in zip(part.column("item_id").to_pylist(), part.column("term").to_pylist()):
            of.setdefault(i, []).append(vocabulary[w])
        rows = postings(texts, vocabulary)
        n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        held = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in zip(held.column(0).to_pylist(), held.column(1).to_pylist()):
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        made = [Item(i, np.array(sorted(t)), weights[sorted(t)]) for i, t in of.items()]
        if n_docs:
            out = out.unionByName(settled(candidates(rows, made, n_docs, n_terms, k), "search-found"))
        forget(rows)
    forget(asked)
    return top(out, k).select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"),
                              F.col("id").alias(id_col), "score")
