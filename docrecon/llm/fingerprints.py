"""Document fingerprints: a randomised edit embedding, sampled, banded and verified.

All texts share one table of random bits.  A walk reads a text: at each step it writes the present
character, and moves on to the next one if the bit of that step and character says so.  After an edit
the walks of two texts soon meet again, so a small edit distance becomes a small Hamming distance.
A fingerprint holds a fixed number of coordinates of the walk's output.  Which ones depends on the
length of the walk only: each coordinate has its own random order of all steps and takes the first of
those that the walk has, so texts of like length mostly sample the same steps.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.cells import grouped, linked, meetings
from docrecon.llm.common import batch_of, settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COORDINATES = 64  # bytes of a fingerprint
GRAM = 4  # steps of output that a coordinate reads
PERIOD = 256  # steps after which the bits repeat
HELD = 6_000_000  # characters walked at once
CHUNK = 64
BANDS = 24  # each samples BAND coordinates
BAND = 3


def walk_table() -> np.ndarray:
    """Steps that a character class stays, by phase and class: until its next set bit."""
    bits = np.random.default_rng(20240601).integers(0, 2, (PERIOD, 256), dtype=np.uint8)
    bits[PERIOD - 1] |= bits.sum(axis=0) == 0
    twice = np.concatenate([bits, bits])
    stay = np.zeros((PERIOD, 256), np.int32)
    wait = np.argmax(twice, axis=0) + PERIOD
    for phase in range(2 * PERIOD - 1, -1, -1):
        wait = np.where(twice[phase] == 1, 1, wait + 1)
        if phase < PERIOD:
            stay[phase] = wait
    return stay.ravel()


def sample_records() -> list[np.ndarray]:
    """For each coordinate, the steps that come first in its order among all steps up to them."""
    draw = np.random.default_rng(20240602)
    out = []
    for _ in range(COORDINATES):
        at, level, steps = 0, draw.random(), [0]
        while at < 1 << 48:
            at += int(draw.geometric(level)) if level > 1e-15 else 1 << 49
            steps.append(at)
            level *= draw.random()
        out.append(np.array(steps, np.int64))
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of COORDINATES bytes for each text; equal texts have equal rows."""
    out = np.zeros((len(texts), COORDINATES), np.uint8)
    stay, records = walk_table(), sample_records()
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]), reverse=True)
    at = 0
    while at < len(order):
        size, end = 0, at
        while end < len(order) and (end == at or size + len(texts[order[end]]) <= HELD):
            size += len(texts[order[end]])
            end += 1
        part = order[at:end]
        out[part] = _walked([texts[k] for k in part], stay, records)
        at = end
    return out


def _walked(texts: list[str], stay: np.ndarray, records: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of texts that come longest first."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int32)
    length = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    step = np.zeros(len(codes), np.int64)  # at which each character is first written
    now = np.zeros(len(texts), np.int64)
    for low in range(0, int(length[0]) if len(texts) else 0, CHUNK):
        active = int(np.searchsorted(-length, -low, "left"))  # texts longer than ``low``
        offsets = low + np.arange(CHUNK)[:, None]
        place = first[:active] + offsets
        inside = offsets < length[:active]
        seen = classes[np.where(inside, place, 0)]
        steps = np.empty((CHUNK, active), np.int64)
        j = now[:active]
        for k in range(min(CHUNK, int(length[0]) - low)):
            steps[k] = j
            j = j + stay[((j & (PERIOD - 1)) << 8) | seen[k]] * inside[k]
        now[:active] = j
        step[place[inside]] = steps[inside]
    return _sampled(codes, first, length, step, now, records)


def _sampled(codes, first, length, step, total, records) -> np.ndarray:
    """Hashed output of the walks at the sampled steps; past the end stands a blank symbol."""
    n = len(total)
    wanted = np.stack([r[np.searchsorted(r, np.maximum(total - 1, 0), "right") - 1] for r in records], axis=1)
    owner = np.repeat(np.arange(n), COORDINATES)
    at = wanted.ravel()
    wide = int(total.max(initial=0)) + GRAM + 2
    keyed = step + np.repeat(np.arange(n), length) * wide
    char = np.searchsorted(keyed, owner * wide + at, "right") - 1
    last = (first + length - 1)[owner]
    mixed = np.zeros(len(at), np.uint64)
    following = np.append(step, 0)
    for k in range(GRAM):
        there = at + k < total[owner]
        symbol = np.where(there, codes[np.maximum(char, 0)] if len(codes) else 0, 0).astype(np.uint64)
        mixed = (mixed ^ (symbol + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        onward = (char < last) & (following[char + 1] <= at + k + 1)
        char = char + onward
    return (mixed >> np.uint64(56)).astype(np.uint8).reshape(n, COORDINATES)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal coordinates, row by row."""
    return (a == b).mean(axis=1)


def band_names(prints: np.ndarray) -> np.ndarray:
    """Names of the bands of each fingerprint: random samples of its coordinates."""
    draw = np.random.default_rng(20240603)
    picked = np.stack([draw.choice(COORDINATES, BAND, replace=False) for _ in range(BANDS)])
    sampled = prints[:, picked].astype(np.int64)  # rows x bands x BAND
    return (np.arange(BANDS) << 8 * BAND) + (sampled << 8 * np.arange(BAND)).sum(axis=2)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, fingerprint, bands)`` of every row; null texts are empty.

    The fingerprint is in hexadecimal; ``bands`` are the names under which near texts meet.  Rows
    are independent; other columns are not read; no shuffle.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string()),
                        ("bands", pa.list_(pa.int64()))])

    def work(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            prints = fingerprints(texts)
            yield batch_of(schema, b.column("id"), [len(t) for t in texts], [x.tobytes().hex() for x in prints],
                           list(band_names(prints)))

    out = rows.mapInArrow(work, "id long, n_chars long, fingerprint string, bands array<long>")
    return out.withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as many first characters of another."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def with_following(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(bucket, id, text, own)`` such that each bucket's rows, by id and text, are consecutive and
    the last is a copy (``own`` false) of the row that follows them.

    Buckets are ranges of ids of like row counts; only their bounds reach the driver.  Each text
    shuffles once.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = df.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    # A row's bucket is the number of cuts below its id; null ids come first.
    bucket = F.when(F.col("id").isNull(), 0).otherwise(
        F.expr(f"size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> c < id))") if cuts else F.lit(0))
    dealt = rows.select(bucket.cast("int").alias("bucket"), "id", "text")
    order = F.struct(F.coalesce("id", F.lit(-(1 << 63))), F.col("text"))
    ids = rows.select(bucket.cast("int").alias("bucket"), "id").groupBy("bucket").agg(
        F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("least")).orderBy("bucket").collect()
    # The first row of a bucket is copied to the bucket before it; the very first to the last.
    before = {r.bucket: ids[k - 1].bucket for k, r in enumerate(ids)}
    leasts = [r.least for r in ids]
    heads = dealt.where(F.coalesce("id", F.lit(-(1 << 63))).isin(leasts)).groupBy("bucket").agg(
        F.min(order).alias("o")) if leasts else None
    own = dealt.select("bucket", "id", "text", F.lit(True).alias("own"))
    if heads is None:
        return own
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    copies = heads.select(to[F.col("bucket")].alias("bucket"), F.col("o.col1").alias("id"), F.col("o.text").alias("text"),
                          F.lit(False).alias("own"))
    return own.union(copies)


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next,
    bands_edited, bands_next)`` of every row.

    ``edited`` is the row's text with its last quarter replaced by the start of the next row's, by
    ascending id (rows of one id by text; null ids first; the first follows the last).  ``near_*``
    is the likeness of fingerprints, ``bands_*`` the number of common bands.  Null texts are empty.
    A table of one row is its own next row.  Other columns are not read.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_following(df, id_col, text_col)
    schema = pa.schema([
        ("id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.large_string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("bands_edited", pa.int64()), ("bands_next", pa.int64())])

    def rows_of(run):
        """Results of all rows of a run but the last, which only follows."""
        texts = [t for _, t in run]
        changed = [edited(t, u) for t, u in zip(texts, texts[1:])]
        prints, other = fingerprints(texts), fingerprints(changed)
        own = prints[:-1]
        names, near, far = band_names(own), band_names(other), band_names(prints[1:])
        return batch_of(
            schema, [i for i, _ in run[:-1]], [len(t) for t in texts[:-1]], changed,
            [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in other],
            likeness(own, other), likeness(own, prints[1:]), (names == near).sum(axis=1), (names == far).sum(axis=1))

    def work(batches):
        bucket, run, size = None, [], 0
        for b in batches:
            for k, i, t in zip(*(b.column(c).to_pylist() for c in ("bucket", "id", "text"))):
                if k != bucket:
                    if len(run) > 1:
                        yield rows_of(run)
                    bucket, run, size = k, [], 0
                run.append((i, t))
                size += len(t)
                if size > HELD:
                    if len(run) > 1:
                        yield rows_of(run)
                        run = run[-1:]
                    size = len(t)
        if len(run) > 1:
            yield rows_of(run)

    sorted_ = dealt.repartition(n, "bucket").sortWithinPartitions(
        "bucket", F.desc("own"), F.asc_nulls_first("id"), "text").select("bucket", "id", "text")
    out = sorted_.mapInArrow(
        work, "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, bands_edited long, bands_next long")
    return out.withColumnRenamed("id", id_col)


def near_duplicates(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, class_id)``: the least id that links of near fingerprints reach.

    Rows that share a band are candidates; fingerprints with at least ``threshold`` of their
    coordinates equal link.  At 0.8 a pair has a common band but for one in ten million pairs.
    Equal fingerprints are one item, so copies cost nothing; every row is in a class, null ids in
    one whose least id may be null.  Null texts are empty.
    """
    printed = settled(fingerprint(df, id_col, text_col).select(
        F.col(id_col).alias("id"), "fingerprint", F.xxhash64("fingerprint").alias("node"), "bands"), "fingerprints")
    items = settled(printed.groupBy("node").agg(
        F.min("id").alias("own"), F.first("fingerprint").alias("print"), F.first("bands").alias("bands")), "prints")
    cells = settled(meetings(items.select(F.explode("bands").alias("cell"), "node")), "bands")
    at = settled(items.select("node", F.transform(
        F.sequence(F.lit(0), F.lit(COORDINATES - 1)),
        lambda k: F.conv(F.substring("print", 2 * k + 1, F.lit(2)), 16, 10).cast("int")).alias("at")), "print-points")
    need = -(-int(round(threshold * COORDINATES * 1000)) // 1000)

    def holds(pairs):
        left = at.select(F.col("node").alias("a"), F.col("at").alias("x"))
        right = at.select(F.col("node").alias("b"), F.col("at").alias("y"))
        same = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda z: z))
        return pairs.join(left, "a").join(right, "b").where(same >= need).select("a", "b")

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(members):
        def work(batches):
            for _, known, part in grouped(batches, ["node", "label"], "at", COORDINATES):
                for node, label, own in zip(*part):
                    near = ((known[2] == own).sum(axis=1) >= need) & (known[1] != label)
                    other = known[0][near]
                    yield batch_of(schema, np.minimum(other, node), np.maximum(other, node))

        dealt = members.repartition(n, "cell", "page").sortWithinPartitions("cell", "page", "probe")
        return dealt.mapInArrow(work, "a long, b long").distinct()

    label = linked(cells, lambda pairs: (holds, at, []), search)
    joined = items.select("node", "own").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = joined.groupBy("component").agg(F.min("own").alias("class_id"))
    named = joined.join(lowest, "component").select("node", "class_id")
    return printed.join(named, "node").select(F.col("id").alias(id_col), "fingerprint", "class_id")
