"""Line deduplication: two Bloom filters pick the suspects, only those shuffle for confirmation."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm import bloom
from docrecon.llm.common import batch_of, forget, raw_texts, settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """Line without white space at its ends, A-Z lower-cased."""
    return line.strip(WHITE).lower()


def text_keys(text: bytes, min_chars: int) -> set[bytes]:
    """Distinct keys of a text with at least ``min_chars`` code points."""
    keys = {line_key(x) for x in text.split(b"\n") if len(x) >= min_chars}
    return {k for k in keys
            if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)}


def hashed(keys) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = 20, min_docs: int = 3, bits: int = bloom.BITS, keep: bool = False,
) -> DataFrame:
    """``(id, text, n_lines, n_dropped)``: texts without repeated lines.

    With ``keep``, ``row`` holds all columns of the input row in place of the id.

    A key of at least ``min_chars`` code points in at least ``min_docs`` rows loses all its lines
    except those of the largest id that holds it.  Null and empty texts are one empty line.  Every
    row is one document: rows that share the largest id all keep the line; a null id counts as
    smaller than any other.  Other columns are not read.

    First pass: two Bloom filters of fixed size (16 MB each by default), so what is broadcast does
    not grow with the data.  Second pass: only keys that the second filter passes shuffle, summed
    in each task first; exact counts decide.  Beyond the filters' capacity more keys are suspects
    and shuffle, with the same result.  Texts meet their dropped keys in one join on the id.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def collect_bits(batches):
        yield from bloom.partial_filters(
            (hashed(text_keys(t, min_chars)) for b in batches
             for t in raw_texts(b.column(0)) if len(t) >= min_chars), bits)

    partials = docs.select("text").mapInArrow(collect_bits, bloom.PARTIAL_DDL)
    shared = spark.sparkContext.broadcast(bloom.merged(partials, bits))  # until the suspects are written
    schema = pa.schema([("id", pa.int64()), ("key", pa.string())])

    def suspects(batches):
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column("id").to_pylist(), raw_texts(b.column("text"))):
                mine = list(text_keys(t, min_chars)) if len(t) >= min_chars else []
                if mine:
                    for k in np.flatnonzero(bloom.passes(shared.value, hashed(mine))).tolist():
                        ids.append(i)
                        keys.append(mine[k].decode())
            yield batch_of(schema, ids, keys)

    suspected = settled(docs.mapInArrow(suspects, "id long, key string"), "line-suspects")
    shared.destroy()
    lowest = F.lit(-(1 << 63))
    # Written first, so that the join below can split a key that holds a large part of all rows.
    owner = settled(
        suspected.groupBy("key")
        .agg(F.count(F.lit(1)).alias("docs"), F.max(F.coalesce("id", lowest)).alias("owner"))
        .where(F.col("docs") >= min_docs).select("key", "owner"), "line-owners",
    )
    losing = settled(
        suspected.join(owner, "key").where(F.coalesce("id", lowest) < F.col("owner"))
        .groupBy("id").agg(F.collect_set("key").alias("keys"))
        .select(F.col("id").alias("of"), "keys"), "line-losers",
    )
    forget(suspected, owner)
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if keep else F.col(f"`{id_col}`").cast("long")
    # A row that is kept whole brings its text: no text shuffles twice.
    text = [] if keep else [F.col(f"`{text_col}`").alias("text")]
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), own.alias("row"), *text)
    met = rows.join(losing, F.col("id").eqNullSafe(F.col("of")), "left").select(
        "row", F.col("row").getField(text_col).alias("text") if keep else "text", "keys")
    out_schema = [("text", pa.large_string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]

    def drop(batches):
        for b in batches:
            texts, lines, dropped = [], [], []
            schema = pa.schema([b.schema.field("row"), *out_schema])
            for t, gone in zip(raw_texts(b.column("text")), b.column("keys").to_pylist()):
                parts = t.split(b"\n")
                left = parts
                if gone:
                    gone = {k.encode() for k in gone}
                    left = [x for x in parts if line_key(x) not in gone]
                texts.append(b"\n".join(left).decode())
                lines.append(len(parts))
                dropped.append(len(parts) - len(left))
            yield batch_of(schema, b.column("row"), texts, lines, dropped)

    kind = met.schema["row"].dataType.simpleString()
    out = met.mapInArrow(drop, f"row {kind}, text string, n_lines long, n_dropped long")
    return out if keep else out.withColumnsRenamed({"row": id_col, "text": text_col})
