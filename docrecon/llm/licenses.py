"""License scans: exact set-similarity join of text blocks with license templates.

A text is cut into overlapping blocks of words, so that every stretch as long as the longest
template lies whole in one.  Template tokens are ordered by how rare they are in the whole corpus.
A block can hold a template's share ``t`` only if it has one of the template's rarest
``size - ceil(t * size) + 1`` tokens (prefix), enough tokens at all (length), and enough of them
after the first common one (position).  What passes is counted exactly.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import batch_of, raw_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letters A-Z are lower-cased, other ASCII but a-z and digits ends a word.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


class Template(NamedTuple):
    """``words`` and the share of them that a block must hold; a phrase must stand word by word."""

    label: str
    words: str
    share: float = 0.8
    phrase: bool = False


# Phrases whose places are counted.
PHRASES = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
)
# Lines and clauses by which licenses are commonly stated.
CLAUSES = (
    Template("cc-by-nc", "licensed under cc by nc 4 0", 1.0),
    Template("cc-by-sa", "licensed under cc by sa 4 0", 1.0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
                    "and associated documentation files to deal in the software without restriction"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without "
                    "fee is hereby granted provided that the above copyright notice and this permission notice appear"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
                    "gnu general public license as published by the free software foundation"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the "
                       "license is distributed on an as is basis without warranties or conditions of any kind"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def token_counts(texts: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences of the templates' tokens in all texts; no more rows than there are tokens."""
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def count(batches):
        seen = Counter()
        for b in batches:
            for t in raw_texts(b.column(0)):
                seen.update(w for w in words_of(t) if w in vocabulary)
        yield batch_of(schema, list(seen), list(seen.values()))

    counted = texts.mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r.token): r.n for r in counted.collect()}


def scan(
    df: DataFrame, templates: Sequence[Template] = PHRASES + CLAUSES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(id, n_words, matches)``: ``matches`` holds ``(label, phrase, first, last, share)``.

    A phrase has one match for each of its places, ``first`` and ``last`` being its words' numbers
    from 0.  Any other template has one match for each block that holds its share, with the block's
    bounds.  Null and empty texts have no words and no matches.  Rows are scanned one by one:
    repeated rows and null ids pass through; other columns are not read.  The templates are the
    caller's list and travel with the tasks; no shuffle but that of their token counts.
    """
    texts = [t.words.encode().translate(FOLD).split() for t in templates]
    vocabulary = {w for t in texts for w in t}
    seen = token_counts(df.select(F.col(text_col).alias("text")), vocabulary)
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    sets = [sorted({order[w] for w in t}) for t in texts]
    needs = [math.ceil(t.share * len(s) - 1e-9) for t, s in zip(templates, sets)]
    prefix: dict[int, list[tuple[int, int]]] = {}
    for k, (s, need) in enumerate(zip(sets, needs)):
        for at, token in enumerate(s[:len(s) - need + 1]):
            prefix.setdefault(token, []).append((k, at))
    rare = {w for w, k in order.items() if k in prefix}
    stride = max((len(t) for t in texts), default=1)
    labels = [(t.label, t.phrase) for t in templates]

    def found_in(words: list[bytes]) -> list[tuple]:
        rank = order.get
        hits = [k for k, w in enumerate(words) if w in rare]
        blocks = sorted({b for k in hits for b in (k // stride - 1, k // stride) if b >= 0})
        out: dict[tuple, tuple] = {}
        for block in blocks:
            low = block * stride
            part = words[low:low + 2 * stride]
            held = sorted({k for w in part if (k := rank(w)) is not None})
            place = {token: j for j, token in enumerate(held)}
            tried = set()
            for j, token in enumerate(held):
                for k, i in prefix.get(token, ()):
                    if k in tried:
                        continue
                    tried.add(k)  # the first common token of the template's order
                    size, need = len(sets[k]), needs[k]
                    if len(held) < need or 1 + min(size - i - 1, len(held) - j - 1) < need:
                        continue
                    common = sum(t in place for t in sets[k])
                    if common < need:
                        continue
                    label, phrase = labels[k]
                    if not phrase:
                        out[k, low] = (label, False, low, low + len(part) - 1, common / size)
                        continue
                    n = len(texts[k])
                    for x in range(len(part) - n + 1):
                        if part[x] == texts[k][0] and part[x:x + n] == texts[k]:
                            out[k, low + x] = (label, True, low + x, low + x + n - 1, 1.0)
        return sorted(out.values(), key=lambda m: (m[2], m[3], m[0], m[1]))

    match = pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()),
                       ("share", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(match))])
    names = [f.name for f in match]

    def work(batches):
        for b in batches:
            counts, matches = [], []
            for t in raw_texts(b.column("text")):
                words = words_of(t)
                counts.append(len(words))
                found = [] if rare.isdisjoint(words) else found_in(words)
                matches.append([dict(zip(names, m)) for m in found])
            yield batch_of(schema, b.column("id"), counts, matches)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(work, "id long, n_words long, matches array<struct<label string, phrase boolean, "
                                "first long, last long, share double>>")
    return out.withColumnRenamed("id", id_col)
