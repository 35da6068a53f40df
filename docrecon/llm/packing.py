"""Packing documents into fixed-length sequences as a cutting-stock problem.

Token lengths of pieces form a histogram of length classes.  A linear program over patterns (sets of
classes that fit one sequence) is solved by column generation: a knapsack dynamic program prices new
patterns with the duals.  Patterns are rounded down, what is left is packed first-fit-decreasing,
and the slots of the patterns are dealt to the ranked pieces of each class.  Only the histogram, with
one number for each class, reaches the driver.
"""

from __future__ import annotations

import json
import os
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.common import batch_of, kept, settled, sliced

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 4096
WIDTH = 16  # token lengths of a class
CACHED = 1_200_000  # words of two generations, and half as many stems, per worker process
CACHED_CHARS = 40
ROUNDS = 20_000  # basis changes; stopping early leaves a valid, less tight packing
GAP = 1e-3  # the program's value is at least its present one divided by the best pattern's worth
MISSES = 20_000  # new words encoded at once
ROWS = 2_000  # texts encoded at once


class WordEncoder:
    """Ids of white-space separated words by the tokenizers library, each distinct word once.

    The vocabulary's normalizer and splitter work within words, so a text's ids are those of its
    words in turn.  A word of letters with plain marks after it is the ids of both parts; new
    stems are encoded many at once, each ending with its one end-of-word token.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def one_by_one(self, words: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def stems(self, stems: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(stems) or (len(ids) and ends[-1] != len(ids)):
            return self.one_by_one(stems)
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words, by word."""
        parts = self.parts
        if len(parts) > CACHED // 2:
            parts.clear()
            parts[""] = b""
        plain, odd, stems, tails = [], [], set(), set()
        for w in words:
            stem = key = w.rstrip(MARKS)
            if stem.isascii():
                key = stem.lower()
            if not (stem.isalpha() and key.lower().isalpha()):
                odd.append(w)
                continue
            tail = w[len(stem):]
            if key not in parts:
                stems.add(key)
            if tail not in parts:
                tails.add(tail)
            plain.append((w, key, tail))
        new, ends = list(stems), list(tails)
        parts.update(zip(new, self.stems(new)))
        parts.update(zip(ends, self.one_by_one(ends)))
        out = {w: parts[s] + parts[t] if t else parts[s] for w, s, t in plain}
        out.update(zip(odd, self.one_by_one(odd)))
        return out

    def encode_all(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of texts (null: none) as little-endian unsigned 32-bit integers.

        Arrow splits the texts and numbers their distinct words, so Python sees each of them once.
        Words met since the last change of generations are in ``words``, those of the generation
        before in ``old``; so words that keep coming back are never encoded again.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(pa.array(texts, pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        words, old = self.words, self.old
        found = list(map(words.get, distinct))
        new = []
        for k, w in enumerate(distinct):
            if found[k] is None:
                found[k] = old.get(w)
                if found[k] is None:
                    new.append(k)
                else:
                    words[w] = found[k]
        for at in range(0, len(new), MISSES):
            some = new[at:at + MISSES]
            learned = self.learn([distinct[k] for k in some])
            for k in some:
                found[k] = learned[distinct[k]]
            words.update((w, x) for w, x in learned.items() if len(w) <= CACHED_CHARS)
        if len(words) > CACHED // 2:
            self.words, self.old = {}, words
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, places, raw = ids.buffers()
        places = np.frombuffer(places, np.int64)[ids.offset:ids.offset + len(ids) + 1]
        cuts = places[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(split) + 1)
        raw = raw.to_pybytes() if raw is not None else b""
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


MARKS = ".,;:!?#*$%&|"


def pieces_of(df: DataFrame, spec: str, end_id: int, id_col: str, text_col: str,
              capacity: int, width: int) -> DataFrame:
    """Pieces of at most ``capacity`` tokens, with the class of their length and their rank among
    the pieces of that class in the same task."""
    shared = df.sparkSession.sparkContext.broadcast(spec)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([(c, pa.int64()) for c in
                        ("id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "rank")])
    ddl = ", ".join(f"{c} long" for c in schema.names)

    def work(batches):
        encoder = kept(("words", hash(shared.value)), lambda: WordEncoder(shared.value))
        task = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        end = int(end_id).to_bytes(4, "little")
        for b in sliced(batches, ROWS):
            out = []
            for i, ids in zip(b.column("id").to_pylist(), encoder.encode_all(b.column("text"))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start:4 * (start + capacity)]
                    k = -(-(len(part) // 4) // width)
                    ranks[k] = ranks.get(k, -1) + 1
                    out.append((i, start, len(part) // 4, zlib.crc32(part), total, k, task, ranks[k]))
            yield batch_of(schema, *(list(zip(*out)) or [[]] * len(schema)))

    return rows.mapInArrow(work, ddl)


def price(values: np.ndarray, sizes: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the worth of the best pattern, and for each class the best one that has it."""
    best, last = np.zeros(units + 1), np.full(units + 1, -1)
    for room in range(1, units + 1):
        fit = np.searchsorted(sizes, room, "right")
        best[room] = best[room - 1]
        if fit:
            worth = best[room - sizes[:fit]] + values[:fit]
            k = int(worth.argmax())
            if worth[k] > best[room] + 1e-12:
                best[room], last[room] = worth[k], k
    patterns = np.zeros((len(sizes), len(sizes)))
    for k, size in enumerate(sizes.tolist()):
        patterns[k, k], room = 1, units - size
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                patterns[last[room], k] += 1
                room -= sizes[last[room]]
    return float(best[units]), patterns


def solve(demand: np.ndarray, sizes: np.ndarray, units: int, rounds: int = ROUNDS):
    """Patterns (columns) and how often to use each: the linear program over all patterns.

    Patterns that the knapsack has priced so far enter the basis one by one; when none improves it,
    the knapsack prices new ones, until its best proves the basis optimal to within GAP.
    """
    m = len(sizes)
    basis, cost = np.diag((units // sizes).astype(float)), np.ones(m)
    inverse = np.diag(1 / np.diag(basis))
    # A little noise keeps basis changes from going in circles; it is far below one piece.
    need = demand + np.random.default_rng(1).random(m) * 1e-3
    x = inverse @ need
    pool = np.zeros((m, 0))
    for done in range(rounds):
        values = cost @ inverse
        low = int(values.argmin())
        if values[low] < -1e-9:  # fewer pieces of a class than a pattern has slots
            column, price_of = -np.eye(m)[low], 0.0
        else:
            worths = values @ pool
            if not len(worths) or worths.max() <= 1 + GAP / 10:
                worth, fresh = price(np.maximum(values, 0), sizes, units)
                if worth <= 1 + GAP:
                    break
                pool = np.concatenate([pool[:, worths > 0.9], fresh], axis=1)
                worths = values @ pool
            column, price_of = pool[:, int(worths.argmax())].copy(), 1.0
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        k = int(np.where(up, x / np.where(up, step, 1), np.inf).argmin())
        basis[:, k], cost[k] = column, price_of
        if done % 100 == 99:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[k] / step[k]
            inverse -= np.outer(step, row)
            inverse[k] = row
        x = np.maximum(inverse @ need, 0)
    patterns = cost > 0
    return basis[:, patterns].astype(int), x[patterns]


def plan(histogram: dict[int, int], units: int) -> list[tuple[dict[int, int], int]]:
    """``(pattern, times)``: slots for at least as many pieces of each class as there are."""
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    out = []
    if len(sizes):
        patterns, times = solve(left.astype(float), sizes, units)
        for column, n in zip(patterns.T, np.floor(times + 1e-6).astype(np.int64).tolist()):
            used = np.flatnonzero(column)
            if n > 0:
                out.append(({int(sizes[u]): int(column[u]) for u in used}, n))
                left[used] -= column[used] * n
    # What rounding leaves is less than one pattern for each class: first fit, largest first.
    bins: list[tuple[int, dict[int, int]]] = []
    for size, n in sorted(zip(sizes.tolist(), left.tolist()), reverse=True):
        for _ in range(max(0, n)):
            at = next((k for k, (room, _) in enumerate(bins) if room >= size), None)
            if at is None:
                bins.append((units, {}))
                at = len(bins) - 1
            room, pattern = bins[at]
            pattern[size] = pattern.get(size, 0) + 1
            bins[at] = (room - size, pattern)
    return out + [(pattern, 1) for _, pattern in bins]


def slots(patterns) -> pd.DataFrame:
    """For each class, which ranks go to which run of sequences: at most (classes x patterns) rows."""
    rows, filled, sequence = [], {}, 0
    for k, (pattern, times) in enumerate(patterns):
        for c, each in pattern.items():
            at = filled.get(c, 0)
            rows.append((c, at, at + each * times, each, sequence))
            filled[c] = at + each * times
        sequence += times
    return pd.DataFrame(rows, columns=["class", "low", "high", "each", "first"]).astype("int64")


def pack(
    df: DataFrame, spec: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, width: int = WIDTH,
) -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` for every piece.

    ``spec`` is the JSON text of a ``tokenizers`` file.  A document is its ids and ``end_id``; a null
    or empty text is ``end_id`` alone.  Documents are cut at multiples of ``capacity``; no sequence
    is longer than that, and pieces in it are gapless from 0.  Every row is a document of its own,
    so repeated rows are packed as often as they stand there.  Other columns are not read.

    Ranks are per task and class, with offsets of the tasks before, so no class meets in one task.
    The broadcast slot table has at most (capacity / width) squared rows, whatever the data.
    """
    spark = df.sparkSession
    pieces = settled(pieces_of(df, spec, end_id, id_col, text_col, capacity, width), "pieces")
    counted = pieces.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["class"]: r.n for r in counted.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(histogram, capacity // width))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("class", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(offsets, ["class", "task"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    dealt = spark.createDataFrame(
        table, "class long, low long, high long, each long, first long"
    ).withColumnRenamed("class", "of")
    placed = ranked.join(
        F.broadcast(dealt),
        (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    ).withColumn("sequence_id", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "class", "rank")
    offset = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        offset.alias("offset"),
    )
