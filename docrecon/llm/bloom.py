"""Two Bloom filters over hashes of keys: seen once, and seen twice or more.

Each task sets the bits of its own keys; a bit that two keys hit goes to the second filter.  Partial
filters meet segment by segment.  A key that occurs twice always passes the second filter; one that
occurs once passes with a small chance, so whoever uses it confirms exactly what passes.  The size
of a filter is fixed (``BITS``): with many more keys than bits it lets more pass, never fewer.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import batch_of, forget, settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 27  # 2**27 bits, 16 MB, for each filter
PROBES = 3
SEGMENT = 16  # 2**16 bits make a segment
HELD = 1 << 22  # bit positions a task holds before it writes them out
PARTIAL = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
PARTIAL_DDL = "segment int, once binary, twice binary"


def positions(hashes: np.ndarray, bits: int = BITS, probes: int = PROBES) -> np.ndarray:
    """Bit positions of 64-bit hashes, one row for each."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    step = np.arange(probes, dtype=np.uint64)
    mixed = (low[:, None] + step * high[:, None]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def partial_filters(hashes_of_batches, bits: int = BITS, probes: int = PROBES):
    """Arrow batches with the filters of one task, from arrays of hashes."""
    held, size = [], 0
    for hashes in hashes_of_batches:
        held.append(positions(hashes, bits, probes).ravel())
        size += held[-1].size
        if size >= HELD:
            yield packed(held)
            held, size = [], 0
    if size:
        yield packed(held)


def packed(held) -> pa.RecordBatch:
    """The filters of arrays of bit positions."""
    at, n = np.unique(np.concatenate(held), return_counts=True)
    segment = at >> SEGMENT
    names, starts = np.unique(segment, return_index=True)
    once, twice = [], []
    for a, b in zip(starts, np.append(starts[1:], len(at))):
        for out, where in ((once, at[a:b]), (twice, at[a:b][n[a:b] > 1])):
            flags = np.zeros(1 << SEGMENT, bool)
            flags[where & ((1 << SEGMENT) - 1)] = True
            out.append(zlib.compress(np.packbits(flags).tobytes(), 1))
    return batch_of(PARTIAL, names, once, twice)


def merged(partials: DataFrame, bits: int = BITS, twice: bool = True) -> np.ndarray:
    """Merge the partial filters and return the second one (or the first, for ``twice=False``) as a
    bit array of 2**bits / 8 bytes.

    Segments are merged in a stream over sorted rows, so a task holds one segment; the driver gets
    at most the filter's fixed size.
    """
    spark = partials.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def merge(batches):
        now = once = more = None
        done: list[tuple[int, bytes]] = []
        for b in batches:
            for s, o, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
                if s == now:
                    more = more | t | (once & o)
                    once = once | o
                else:
                    if now is not None:
                        done.append((now, more if twice else once))
                    now, once, more = s, o, t
        if now is not None:
            done.append((now, more if twice else once))
        done = [(s, x) for s, x in done if x.any()]
        yield batch_of(pa.schema([("segment", pa.int32()), ("bits", pa.binary())]),
                       [s for s, _ in done], [zlib.compress(x.tobytes(), 1) for _, x in done])

    # Written first: the partial filters need not stay on disk.
    written = settled(
        partials.repartition(n, F.col("segment")).sortWithinPartitions("segment")
        .mapInArrow(merge, "segment int, bits binary"), "filter")
    whole = written.toArrow()
    forget(written)
    out = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << SEGMENT) // 8
    for s, t in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist()):
        out[s * width:(s + 1) * width] = np.frombuffer(zlib.decompress(t), np.uint8)
    return out


def passes(filter_bits: np.ndarray, hashes: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Which hashes have all their bits set."""
    at = positions(hashes, len(filter_bits).bit_length() + 2, probes)
    return ((filter_bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
