"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import batch_of, text_map, unkept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 15  # n-grams fall into 2**BITS buckets
SLICE = 1 << 20  # characters scored at once
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    prior: np.ndarray


def buckets(codes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of the three characters from each position on (the last two have none)."""
    c = codes.astype(np.uint32)
    mixed = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)


def text_slices(text: str):
    """Code points of a lower-cased text with a space at either end, in overlapping slices."""
    for at in range(0, len(text), SLICE):
        piece = text[max(0, at - 2):at + SLICE].lower()
        piece = (" " if at == 0 else "") + piece + (" " if at + SLICE >= len(text) else "")
        yield np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text", bits: int = BITS,
          smoothing: float = 0.1) -> Model:
    """Counts of all rows with a language and a text; empty where there are none.

    What comes to the driver is one count per language and bucket: 2**bits numbers for each
    language code, whatever the number of rows.
    """
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if lang not in seen:
                    seen[lang] = np.zeros((1 << bits) + 1, np.int64)
                seen[lang][-1] += 1  # documents
                for codes in text_slices(text):
                    np.add.at(seen[lang], buckets(codes, bits), 1)
        for lang, n in seen.items():
            some = np.flatnonzero(n)
            yield batch_of(schema, [lang] * len(some), some, n[some])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long")
    total = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(total.column("lang").to_pylist()))
    table = np.zeros(((1 << bits) + 1, len(langs)))
    where = np.searchsorted(np.array(langs, object), np.array(total.column("lang").to_pylist(), object))
    table[total.column("bucket").to_numpy(), where] = total.column("n").to_numpy()
    grams, docs = table[:-1] + smoothing, table[-1]
    logp = np.log(grams / grams.sum(axis=0)) if langs else grams
    return Model(langs, logp.astype(np.float32), np.log(docs / docs.sum()) if langs else docs)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             keep: bool = False) -> DataFrame:
    """``(id, lang_pred, score)``: the likeliest language and its posterior probability.

    With ``keep``, ``row`` holds all columns of the input row in place of the id.

    A text that is null or has no letter, and any text under a model without languages, is ``und``
    with score 0.  Ties go to the first language in order.  Rows are scored one by one; repeated
    rows and null ids pass through; other columns are not read.  No shuffle; the broadcast matrix
    has 2**bits rows and one column per language.
    """
    shared = df.sparkSession.sparkContext.broadcast(tuple(model))  # plain values: no package needed
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])
    letter = regex.compile(r"\p{L}")

    def work(batches):
        unkept()
        langs, logp, prior = shared.value
        bits = len(logp).bit_length() - 1

        def flush(codes, owner, total):
            if codes:
                flat = np.concatenate(codes)
                ends = np.cumsum([len(c) for c in codes])
                got = buckets(flat, bits)
                starts = np.concatenate([[0], ends[:-1]])
                for k in range(len(langs)):
                    p = logp[:, k][got].astype(np.float64)
                    run = np.concatenate([[0.0], np.cumsum(p)])
                    # the n-grams that begin in the last two characters of a text would cross over
                    total[owner, k] += run[np.maximum(ends - 2, starts)] - run[starts]

        for texts in batches:
            total = np.tile(prior, (len(texts), 1)) if langs else np.zeros((len(texts), 1))
            known = np.array([bool(langs) and t is not None and letter.search(t) is not None for t in texts], bool)
            codes, owner, held = [], [], 0
            for at in np.flatnonzero(known).tolist():
                for c in text_slices(texts[at]):
                    if owner and (held > SLICE or owner[-1] == at):
                        flush(codes, owner, total)
                        codes, owner, held = [], [], 0
                    codes.append(c)
                    owner.append(at)
                    held += len(c)
            flush(codes, owner, total)
            best = total.argmax(axis=1)
            spread = np.exp(total - total.max(axis=1, keepdims=True))
            score = np.where(known, 1 / spread.sum(axis=1), 0.0)
            names = [langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist())]
            yield batch_of(schema, names, score)

    return text_map(df, work, "lang_pred string, score double", id_col, text_col, keep)
