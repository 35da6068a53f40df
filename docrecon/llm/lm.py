"""Language-model scoring by prediction by partial matching (PPM).

A byte-context trie holds how often each byte follows each context.  A byte that a context has seen
is predicted by its share; otherwise an escape is coded and the next shorter context is asked,
without the bytes that the longer ones would have given (symbol exclusion).  Escapes have the weight
of the distinct bytes a context has seen (method C).
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import batch_of, raw_texts, settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 4  # bytes of context
NODES = 1 << 15  # a context is in the trie when it has 1/NODES of all bytes: at most NODES of a length
WARM = 1 << 22  # a gram with 1/WARM of all bytes is broadcast with its probability: at most WARM of them
GROUPED = 1 << 20  # grams that are gathered, in whole groups, before their probabilities are found
HELD = 1 << 22  # bytes whose grams are sorted at once
START = b"\n" * ORDER  # context before a text
END = 0xFF  # ends a text; never a byte of UTF-8
STOP = b"\n"  # the end as a token; no word holds white space
SHARE = 1 << 20  # a token with at least 1/SHARE of all tokens is frequent: at most SHARE of them
SHORT = 64  # bytes of a frequent token


class Ppm(NamedTuple):
    """Trie over contexts, latest byte first, with log10 probabilities of the next byte.

    ``child[d][256 * node + byte]`` is the node of depth d + 1 whose context is longer by ``byte``;
    0 stands for none.  ``rows[first[d] + node]`` has the probabilities of a node of depth d.
    """

    child: list[np.ndarray]
    first: list[int]
    rows: np.ndarray


def model_score(model: Ppm, text: bytes) -> tuple[float, np.ndarray, np.ndarray]:
    """Log10 probability of those bytes of a text and its end whose whole context is in the trie;
    the packed grams of the other bytes, and how often each occurs."""
    child, first, rows = model
    b = np.frombuffer(START + text + bytes([END]), np.uint8).astype(np.int32)
    size, at = len(b) - len(START), len(START)
    node = np.ones(size, np.int32)
    for d, table in enumerate(child):
        node = table[node * 256 + b[at - d - 1:at - d - 1 + size]]
    inside = node > 0
    points = float(rows[node[inside] + first[ORDER], b[at:][inside]].sum(dtype=np.float64))
    cold = np.flatnonzero(~inside) + at
    packed = np.zeros(len(cold), np.int64)
    for d in range(ORDER + 1):
        packed |= b[cold - d].astype(np.int64) << 8 * d
    return points, *np.unique(packed, return_counts=True)


def blend(counts: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each byte from count vectors of ever shorter contexts."""
    out, escape = np.zeros(256), 0.0
    open_ = np.ones(256, bool)
    for n in counts:
        here = open_ & (n > 0)
        kinds = int(here.sum())
        if kinds:
            whole = math.log10(n[here].sum() + kinds)
            out[here] = escape + np.log10(n[here]) - whole
            escape += math.log10(kinds) - whole
            open_ &= ~here
    if open_.any():
        out[open_] = escape - math.log10(open_.sum())
    return out


def build(levels: list[tuple[np.ndarray, np.ndarray]]) -> Ppm:
    """Model from counts per depth of packed (context, byte) grams; uniform without any."""
    child, first, rows = [], [0], [np.zeros(256)]
    above = {0: (1, [])}  # of a context: its node, and its and all shorter contexts' counts
    for d, (grams, n) in enumerate(levels):
        grams, n = np.asarray(grams, np.int64), np.asarray(n, np.float64)
        order = np.argsort(grams)
        grams, n = grams[order], n[order]
        contexts, starts = np.unique(grams >> 8, return_index=True)
        here = {}
        if d == 0 and not len(contexts):
            contexts, starts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        if d:
            child.append(np.zeros((len(above) + 1) * 256, np.int32))
            first.append(len(rows))
            rows.append(np.zeros(256))
        for k, (c, a, b) in enumerate(zip(contexts.tolist(), starts, np.append(starts[1:], len(grams))), 1):
            mine = np.zeros(256)
            mine[grams[a:b] & 0xFF] = n[a:b]
            shorter = above[c & ((1 << 8 * (d - 1)) - 1)] if d else above[0]
            here[c] = (k, [mine, *shorter[1]])
            if d:
                child[-1][shorter[0] * 256 + (c >> 8 * (d - 1))] = k
            rows.append(blend(here[c][1]))
        above = here
    return Ppm(child, first, np.array(rows, np.float32))


def adaptive_score(text: bytes, order: int = ORDER) -> float:
    """Log10 probability of a text by a model that starts empty and learns byte by byte."""
    trie: dict[bytes, Counter] = {}
    past, total = START, 0.0
    for s in text + bytes([END]):
        out: set[int] = set()
        found = False
        for k in range(order, -1, -1):
            seen = trie.get(past[len(past) - k:])
            here = {x: c for x, c in seen.items() if x not in out} if seen else {}
            if here and not found:
                whole = sum(here.values()) + len(here)
                found = s in here
                total += math.log10((here[s] if found else len(here)) / whole)
                out |= set(here)
        if not found:
            total -= math.log10(256 - len(out))
        for k in range(order + 1):
            trie.setdefault(past[len(past) - k:], Counter())[s] += 1
        past = (past + bytes([s]))[-order:] if order else b""
    return total


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of ORDER bytes of context and a byte, packed, and how often they occur."""
    stream = b"".join([START + t + bytes([END]) for t in texts])
    b = np.frombuffer(stream, np.uint8).astype(np.int64)
    inside = np.ones(len(b), bool)  # where a gram's byte stands
    starts = np.cumsum([0, *(len(t) + ORDER + 1 for t in texts[:-1])])
    for k in range(ORDER):
        inside[starts + k] = False
    packed = np.zeros(len(b), np.int64)
    for d in range(ORDER + 1):
        packed[ORDER:] |= b[ORDER - d:len(b) - d] << 8 * d
    return np.unique(packed[inside], return_counts=True)


def in_parts(texts: list[bytes]):
    """Lists of texts of about HELD bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= HELD:
            yield held
            held, size = [], 0
    if held:
        yield held


def train_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(token, gram, n)``: counts of tokens (gram is null) and of byte grams (token is null)."""
    schema = pa.schema([("token", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for b in batches:
            texts = [t.lower() for t in raw_texts(b.column(0))]
            if texts:
                words = Counter()
                for t in texts:
                    words.update(t.split())
                words[STOP] += len(texts)
                yield batch_of(schema, list(words), pa.nulls(len(words), pa.int64()), list(words.values()))
                for part in in_parts(texts):
                    grams, n = gram_counts(part)
                    yield batch_of(schema, pa.nulls(len(n), pa.binary()), grams, n)

    counted = df.select(F.col(text_col).alias("text")).mapInArrow(count, "token binary, gram long, n long")
    return counted.groupBy("token", "gram").agg(F.sum("n").alias("n"))


def trie_levels(grams: DataFrame, nodes: int = NODES):
    """Per depth, the counts of the contexts that have 1/``nodes`` of all bytes (all, at depth 0 and
    1): at most ``nodes`` contexts of 256 bytes each come to the driver for a depth."""
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for d in range(ORDER + 1):
        gram = F.col("gram").bitwiseAND((1 << 8 * (d + 1)) - 1)
        level = grams.groupBy(gram.alias("gram")).agg(F.sum("n").alias("n"))
        if d > 1:
            context = F.shiftright("gram", 8).alias("context")
            large = level.groupBy(context).agg(F.sum("n").alias("all")).where(F.col("all") * nodes >= total)
            level = level.join(F.broadcast(large), F.shiftright("gram", 8) == F.col("context"))
        got = level.select("gram", "n").toArrow()
        yield got.column("gram").to_numpy(), got.column("n").to_numpy()


def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked value stands in the sorted keys (anywhere when absent), and whether it does."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def gram_points(asked: np.ndarray, grams: np.ndarray, n: np.ndarray, low) -> np.ndarray:
    """Log10 probability of the byte of each asked gram after its context, by method C with exclusion.

    ``grams`` and ``n`` are all counts of full grams that share their two latest context bytes with
    an asked one; ``low`` has the counts of the two shortest depths, sorted.  The bytes that a
    context has seen were also seen by all shorter ones, so what exclusion leaves of a shorter one
    is a difference of two sums.
    """
    levels = list(low)
    for d in range(2, ORDER + 1):
        names, at = np.unique(grams & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels.append((names, np.bincount(at, n, len(names)).astype(np.int64)))
    points = np.zeros(len(asked))
    open_ = np.ones(len(asked), bool)
    out_kinds, out_sum = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)  # left out at this depth
    for d in range(ORDER, -1, -1):
        names, times = levels[d]
        contexts, starts = np.unique(names >> 8, return_index=True)
        if not len(contexts):
            continue
        kinds, whole = np.diff(starts, append=len(names)), np.add.reduceat(times, starts)
        gram = asked & ((1 << 8 * (d + 1)) - 1)
        context, known = found(contexts, gram >> 8)
        left = np.where(known, kinds[context] - out_kinds, 0)
        rest = np.log10(np.maximum(whole[context] - out_sum + left, 1))
        place, seen = found(names, gram)
        hit, miss = open_ & seen, open_ & ~seen & (left > 0)
        points[hit] += np.log10(times[place[hit]]) - rest[hit]
        points[miss] += np.log10(left[miss]) - rest[miss]
        open_ &= ~seen
        out_kinds = np.where(known, kinds[context], 0)
        if d:
            shorter, there = found(levels[d - 1][0], names & ((1 << 8 * d) - 1))
            assert there.all()
            out_sum = np.where(known, np.add.reduceat(levels[d - 1][1][shorter], starts)[context], 0)
    points[open_] -= np.log10(256 - out_kinds[open_])
    return points


def probabilities(asked: DataFrame, grams: DataFrame, low) -> DataFrame:
    """``(gram, points)`` of the asked grams, each with its log10 probability under all ``grams``.

    Grams meet in groups of two latest context bytes: each gram once, however often it occurs.
    """
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast(low)
    schema = pa.schema([("gram", pa.int64()), ("points", pa.float64())])

    def work(batches):
        def done(gram, n):
            known = n > 0
            asked = gram[~known]
            return batch_of(schema, asked, gram_points(asked, gram[known], n[known], shared.value))

        held, size = [], 0
        for b in batches:
            held.append((b.column("gram").to_numpy(), b.column("n").to_numpy()))
            size += b.num_rows
            if size >= GROUPED:
                gram, n = (np.concatenate(x) for x in zip(*held))
                group = gram >> 8 & 0xFFFF
                cut = int(np.flatnonzero(group == group[-1])[0])
                if cut:
                    yield done(gram[:cut], n[:cut])
                held, size = [(gram[cut:], n[cut:])], len(gram) - cut
        if held:
            yield done(*(np.concatenate(x) for x in zip(*held)))

    both = grams.select("gram", "n").union(asked.select("gram", F.lit(0).cast("long").alias("n")))
    both = both.withColumn("group", F.shiftright("gram", 8).bitwiseAND(0xFFFF))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "group").sortWithinPartitions("group").select("gram", "n")
    return dealt.mapInArrow(work, "gram long, points double")


def score(
    df: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    share: int = SHARE, adaptive: bool = False, nodes: int = NODES, warm: int = WARM,
) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``df``.

    ``score`` is the log10 probability of the A-Z lower-cased text and its end under the model of
    ``training`` (with ``adaptive``: under one that starts empty for each text).  ``base_score``
    is a smoothed unigram model over words and the end.  Null texts are empty.  Each row counts by
    itself, so rows may repeat and ids may be null; other columns are not read.

    All of ``training`` is counted, and every context counts in the score, however rare it is.
    Only what is broadcast is bounded: a trie of the contexts that have 1/``nodes`` of all bytes (1 KB
    each), the probabilities of other grams with 1/``warm`` of them, and tokens with at least
    1/``share`` of all.  Occurrences of the rest, summed per row, meet the probabilities of their
    grams and the counts of their tokens in shuffle joins.
    """
    spark = df.sparkSession
    counts = settled(train_counts(training, text_col), "lm-counts")
    tokens = counts.where(F.col("token").isNotNull()).select("token", "n")
    whole = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                       F.coalesce(F.sum(F.when(F.col("token") == F.lit(STOP), F.col("n"))), F.lit(0)).alias("stops")).first()
    grams = counts.where(F.col("gram").isNotNull()).select("gram", "n")
    levels = list(trie_levels(grams, nodes))
    model = build(levels)
    low = [(g[order], n[order]) for g, n in levels[:2] for order in [np.argsort(g)]]  # complete
    size = int(levels[0][1].sum())
    often = probabilities(grams.where(F.col("n") * warm >= size), grams, low).toArrow().sort_by("gram")
    often = (often.column("gram").to_numpy(), often.column("points").to_numpy())
    common = tokens.where((F.col("n") * share >= whole.n) & (F.length("token") <= SHORT))
    common = common.toArrow()
    known = dict(zip(common.column("token").to_pylist(), common.column("n").to_pylist()))
    scale = math.log10(whole.n + 0.1 * (whole.v + 1))
    shared = spark.sparkContext.broadcast((tuple(model), often, known, whole.stops, scale, adaptive))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([
        ("row", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base_score", pa.float64()), ("score", pa.float64()),
        ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())),
        ("grams", pa.list_(pa.int64())), ("occur", pa.list_(pa.int64())),
    ])

    def work(batches):
        model, often, known, stops, scale, adaptive = shared.value
        logs = {t: math.log10(n + 0.1) - scale for t, n in known.items()}
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for i, text in zip(b.column("id").to_pylist(), raw_texts(b.column("text"))):
                text = text.lower()
                words = Counter(text.split())
                seen, base, rare = int(stops > 0), math.log10(stops + 0.1) - scale, {}
                for w, n in words.items():
                    p = logs.get(w)
                    if p is None:
                        rare[w] = n
                    else:
                        seen += n
                        base += n * p
                if adaptive:
                    points, cold, occur = adaptive_score(text), [], []
                else:
                    points, cold, occur = model_score(model, text)
                    at, here = found(often[0], cold)
                    points += float((often[1][at[here]] * occur[here]).sum())
                    cold, occur = cold[~here], occur[~here]
                out.append((row, i, sum(words.values()) + 1, seen, base, points, list(rare), list(rare.values()),
                            cold, occur))
                row += 1
            yield batch_of(schema, *(list(zip(*out)) or [[]] * len(schema)))

    scored = settled(rows.mapInArrow(
        work, "row long, id long, n_tokens long, n_known long, base_score double, score double, "
              "rare array<binary>, times array<long>, grams array<long>, occur array<long>"), "lm-rows")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select(
        "row", F.col("t.rare").alias("token"), F.col("t.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    sums = rare.join(tokens, "token", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * (F.log10(n + 0.1) - F.lit(scale))).alias("points"))
    cold = scored.select("row", F.explode(F.arrays_zip("grams", "occur")).alias("t")).select(
        "row", F.col("t.grams").alias("gram"), F.col("t.occur").alias("occur"))
    chances = settled(probabilities(cold.select("gram").distinct(), grams, low), "lm-points")
    more = cold.join(chances.withColumnRenamed("points", "each"), "gram").groupBy("row").agg(
        F.sum(F.col("occur") * F.col("each")).alias("cold"))
    done = scored.drop("rare", "times", "grams", "occur").join(sums, "row", "left").join(more, "row", "left")
    return done.select(
        F.col("id").alias(id_col), "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(whole.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("points", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("cold", F.lit(0.0))).alias("score"),
    )
