"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

The strings are the words of a text between two marks, in lower case; letters set apart by spaces
are one word again.  Two strings are alike by the subsequences of three characters they share, also
with others in between, each weighed by ``DECAY`` to the power of the characters it stretches over.
So ``idiot``, ``id.iot`` and ``i d i o t`` stay near each other.

Landmarks are words that labelled texts single out, and common ones.  The kernel against them, turned
by the inverse root of their own kernel matrix, is the Nyström map on which the machine is trained.
A text's label holds for the text, not for each word, so the words a toxic text is trained on are
chosen again from the machine of the round before.  As the kernel is a sum over subsequences, the
trained machine is one weight for each subsequence of the landmarks: a fixed table that is broadcast.
A text's score is a logistic function of its highest words.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import batch_of, forget, settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DECAY = 0.7  # for every character that a subsequence stretches over
REACH = 7  # characters from the first to the last of a subsequence, at most
CLASS_BITS = 7  # characters fall into 2**7 classes
WIDTH = 24  # characters of a string; longer words are cut in overlapping ones
SAMPLE = 6_000  # labelled documents learned from: half of it toxic, half not
STRINGS = 20_000  # rare strings of either class that the machine is trained on, and half the frequent ones
LANDMARKS = 256
ROUNDS = 3
STRICT = 2.0  # weight of clean strings once toxic texts are represented by their highest
RIDGE = 1.0
HIGHEST = 4  # words of a text that its score rests on
BLOCK = 1 << 13  # strings mapped at once in training
LEAST = -1.0  # value of a missing word, and of any lower one
MARKS = {k: None for k in range(33, 127) if not chr(k).isalnum()}
APART = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")  # three or more single characters
HELD = 1 << 22  # characters scored at once


class Model(NamedTuple):
    """Weight of every subsequence, offset of the machine, and the logistic function's weights."""

    table: np.ndarray
    offset: float
    logistic: np.ndarray


def strings_of(token: str) -> list[str]:
    """Strings of a lower-cased token: without ASCII marks, cut where it is long."""
    word = token.translate(MARKS)
    return [word[k:k + WIDTH] for k in range(0, max(1, len(word) - WIDTH // 2), WIDTH // 2)]


class Strings(dict):
    """Numbers of the strings of tokens, given as they are met; ``texts`` lists the strings."""

    def __init__(self):
        super().__init__()
        self.number: dict[str, int] = {}

    def __missing__(self, token: str) -> tuple[int, ...]:
        self[token] = out = tuple(self.number.setdefault(s, len(self.number)) for s in strings_of(token))
        return out

    def of(self, text: str) -> list[int]:
        """Numbers of the distinct strings of a text; letters set apart also make one token."""
        low = text.lower()
        tokens = set(low.split())
        tokens.update("".join(m.group().split()) for m in APART.finditer(low))
        return list({i for t in tokens for i in self[t]})


def classes() -> np.ndarray:
    """Class of each code point below 2**16: own ones for a-z and digits, others share the rest."""
    points = np.arange(1 << 16, dtype=np.uint64)
    mixed = (points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    out = (40 + mixed % np.uint64((1 << CLASS_BITS) - 40)).astype(np.int32)
    out[ord("a"):ord("z") + 1] = np.arange(1, 27)
    out[ord("0"):ord("9") + 1] = np.arange(27, 37)
    return out


START, END = 37, 38


@lru_cache(maxsize=None)
def places(size: int) -> tuple[tuple[int, int, int, float], ...]:
    """Subsequences of a string of ``size`` characters: places and weight, of unit length together."""
    raw = [(i, j, k, DECAY ** (k - i + 1)) for i in range(size) for k in range(i + 2, min(size, i + REACH))
           for j in range(i + 1, k)]
    norm = math.sqrt(sum(w * w for *_, w in raw)) or 1.0
    return tuple((i, j, k, w / norm) for i, j, k, w in raw)


def by_size(strings: list[str]):
    """``(numbers, matrix of classes)`` of the strings of each size, marks included."""
    of = classes()
    sizes = np.array([len(s) for s in strings], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        flat = np.frombuffer("".join([strings[k] for k in at.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        marked = np.empty((size + 2, len(at)), np.int32)
        marked[0], marked[-1] = START, END
        marked[1:-1] = of[flat & 0xFFFF].reshape(len(at), size).T
        yield at, marked


def subsequences(marked: np.ndarray):
    """``(index in the table of every string, weight)`` of each subsequence, one place at a time."""
    first, second = marked << (2 * CLASS_BITS), marked << CLASS_BITS
    for i, j, k, w in places(len(marked)):
        yield first[i] | second[j] | marked[k], w


def values(strings: list[str], table: np.ndarray, offset: float) -> np.ndarray:
    """Value of the machine for each string."""
    out = np.full(len(strings), offset, np.float32)
    for at, marked in by_size(strings):
        total = np.zeros(len(at), np.float32)
        for index, w in subsequences(marked):
            total += np.float32(w) * table[index]
        out[at] += total
    return out


class Landmarks:
    """Strings whose subsequences are numbered, so that the kernel against them is a sum of rows."""

    def __init__(self, strings: list[str]):
        parts = [(index, at, w) for at, marked in by_size(strings) for index, w in subsequences(marked)]
        self.known = np.unique(np.concatenate([index for index, _, _ in parts]))
        self.row = np.zeros(1 << (3 * CLASS_BITS), np.int32)
        self.row[self.known] = np.arange(1, len(self.known) + 1)
        self.features = np.zeros((len(self.known) + 1, len(strings)), np.float32)
        for index, at, w in parts:
            self.features[self.row[index], at] += w
        self.features[0] = 0
        power, turn = np.linalg.eigh(self.kernel(strings).astype(np.float64))
        self.turn = (turn / np.sqrt(np.maximum(power, 1e-3))).astype(np.float32)

    def kernel(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), self.features.shape[1]), np.float32)
        for at, marked in by_size(strings):
            total = np.zeros((len(at), out.shape[1]), np.float32)
            for index, w in subsequences(marked):
                row = self.row[index]
                some = np.flatnonzero(row)
                total[some] += np.float32(w) * self.features[row[some]]
            out[at] = total
        return out

    def mapped(self, strings: list[str]) -> np.ndarray:
        """The Nyström map of strings, and a last column of ones."""
        out = np.ones((len(strings), self.turn.shape[1] + 1), np.float32)
        for at in range(0, len(strings), BLOCK):
            out[at:at + BLOCK, :-1] = self.kernel(strings[at:at + BLOCK]) @ self.turn
        return out

    def table(self, w: np.ndarray) -> np.ndarray:
        """One weight for each subsequence, for a machine with weights ``w`` on the map."""
        out = np.zeros(len(self.row), np.float32)
        out[self.known] = self.features[1:] @ (self.turn @ w.astype(np.float32))
        return out


def svm(x: np.ndarray, up: np.ndarray, down: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights of the squared-hinge machine, the offset last: Newton's method on the rows within.

    Each row of ``x`` costs ``up`` where its value is below 1 and ``down`` where it is above -1.
    """
    w, value = np.zeros(x.shape[1]), np.zeros(len(x))
    hold = np.eye(x.shape[1]) * ridge
    hold[-1, -1] = 1e-6
    before = None
    for _ in range(steps):
        within = np.stack([value < 1, value > -1])
        if before is not None and (within == before).all():
            break
        before = within
        cost, pull = up * within[0] + down * within[1], up * within[0] - down * within[1]
        left, right = hold.copy(), np.zeros(len(w))
        for at in range(0, len(x), BLOCK):
            part = x[at:at + BLOCK].astype(np.float64)
            left += (part * cost[at:at + BLOCK, None]).T @ part
            right += part.T @ pull[at:at + BLOCK]
        w = np.linalg.solve(left, right)
        value = x @ w.astype(np.float32)
    return w


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression, the offset last."""
    x = np.column_stack([x, np.ones(len(x))])
    w, hold = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.1
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
    return w


def highest(found: np.ndarray) -> np.ndarray:
    """The ``HIGHEST`` values, in descending order, none below ``LEAST``."""
    out = np.full(HIGHEST, LEAST)
    best = np.sort(found)[-HIGHEST:][::-1]
    out[:len(best)] = np.maximum(best, LEAST)
    return out


def _share(strings: list[str]) -> list[str]:
    """About ``STRINGS`` of the strings, by their hash; all where they are no more."""
    below = (1 << 32) * STRINGS / max(1, len(strings))
    return [s for s in strings if zlib.crc32(s.encode("utf-8", "surrogatepass")) < below]


def machine(bags: list[list[str]], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Table and offset learned from texts as sets of strings."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    in_toxic, in_clean = Counter(), Counter()
    for bag, t in zip(bags, toxic.tolist()):
        (in_toxic if t else in_clean).update(bag)
    rate = n_toxic / n_clean
    # How far a string's share of toxic texts stands above chance: the leading landmarks.
    lead = {s: (t - rate * in_clean[s]) / math.sqrt(t + rate * in_clean[s] + 1) for s, t in in_toxic.items()}
    marks = sorted(lead, key=lambda s: (-lead[s], s))[:LANDMARKS * 2 // 3]
    held = set(marks)
    marks += sorted((s for s in in_clean if s not in held), key=lambda s: (-in_clean[s], s))[:LANDMARKS - len(marks)]
    space = Landmarks(marks)

    # The strings that most texts hold, and about STRINGS of the others of either class.
    held = in_toxic + in_clean
    names = sorted((s for s, n in held.items() if n > 1), key=lambda s: (-held[s], s))[:2 * STRINGS]
    often = set(names)
    for of in (in_toxic, in_clean):
        names += _share([s for s in sorted(of) if s not in often])
    names = list(dict.fromkeys(names))
    x = space.mapped(names)
    # A string counts against the class once for every clean text that holds it; both classes weigh
    # alike.  At first all strings of toxic texts count for it, then only each text's highest.
    up = np.array([in_toxic[s] for s in names], np.float64)
    down = np.array([in_clean[s] for s in names], np.float64) * rate
    number = {s: k for k, s in enumerate(names)}
    mine = [np.array([number[s] for s in bag if s in number], np.int64) for bag, t in zip(bags, toxic.tolist()) if t]
    for k in range(ROUNDS):
        w = svm(x, up, down * (1 if k == 0 else STRICT), RIDGE)
        if k < ROUNDS - 1:
            value = x @ w.astype(np.float32)
            up = np.zeros(len(names))
            for held in mine:
                top = held[np.argsort(-value[held], kind="stable")[:HIGHEST]]
                up[top[value[top] > 0]] += 1
    return space.table(w[:-1]), float(w[-1])


def fit(texts: list[str], toxic: np.ndarray) -> Model | None:
    """Model from texts and their labels; none where a class is missing.

    The logistic function is fitted on values from machines that have not seen the text: each half
    of the texts is judged by the machine of the other.
    """
    if not toxic.any() or toxic.all():
        return None
    strings = Strings()
    numbers = [strings.of(t) for t in texts]
    names = list(strings.number)
    bags = [[names[i] for i in x] for x in numbers]
    tops, fold = np.full((len(texts), HIGHEST), LEAST), np.zeros(len(texts), np.int64)
    for kind in (toxic, ~toxic):  # both classes in both halves
        fold[kind] = np.arange(kind.sum()) % 2
    for k in (0, 1):
        mine = np.flatnonzero(fold == k)
        if toxic[mine].any() and not toxic[mine].all():
            found = values(names, *machine([bags[i] for i in mine.tolist()], toxic[mine]))
            for i in np.flatnonzero(fold != k).tolist():
                tops[i] = highest(found[numbers[i]])
    return Model(*machine(bags, toxic), logistic(tops, toxic.astype(float)))


def learn(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id",
) -> Model | None:
    """Model from texts of ``docs`` and ``labels(id, toxic)``; none where a class is missing.

    ``sample`` bounds the labelled texts that are learned from, half of it for either class: ids are
    drawn by their hash, so that about as many are expected and all are taken where they are fewer.
    Of rows that share an id the least text counts; an id is toxic if any of its labels is 1.  Null
    ids and null labels teach nothing.  Only drawn texts shuffle, and only they reach the driver.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(label_id_col).isNotNull()).groupBy(
        F.col(label_id_col).cast("long").alias("id")).agg((F.max("toxic") == 1).alias("toxic"))
    known = settled(known, "toxic-labels")
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for kind, n in sizes.items():
        share = F.when(F.col("toxic") == kind, F.lit(min(1.0, sample / 2 / n))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) / float(1 << 32) < share)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(
        F.broadcast(drawn), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).toArrow()
    forget(known)
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    texts, toxic = rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), bool)
    return fit([texts[k] or "" for k in order.tolist()], toxic[order])


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row: how likely its text is toxic, from 0 to 1.

    Null and empty texts have no words and the score of such a text; without a model all scores are
    0.  Rows are scored one by one: repeated rows and null ids pass through; other columns are not
    read.  No shuffle; the broadcast table has 2**21 numbers.
    """
    shared = df.sparkSession.sparkContext.broadcast(None if model is None else tuple(model))
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def scored(texts: list[str]) -> np.ndarray:
        if shared.value is None:
            return np.zeros(len(texts))
        table, offset, weights = shared.value
        strings = Strings()
        numbers = [strings.of(t) for t in texts]
        found = values(list(strings.number), table, offset)
        tops = np.array([highest(found[x]) for x in numbers])
        return 1 / (1 + np.exp(-(tops @ weights[:-1] + weights[-1])))

    def work(batches):
        for b in batches:
            at, held = 0, 0
            texts = [t or "" for t in b.column("text").to_pylist()]
            for k, t in enumerate(texts):
                held += len(t)
                if held >= HELD or k == len(texts) - 1:
                    yield batch_of(schema, b.column("id").slice(at, k + 1 - at), scored(texts[at:k + 1]))
                    at, held = k + 1, 0

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, "id long, score double").withColumnRenamed("id", id_col)
