import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docrecon.llm import packing

from texts import TEXTS

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SPEC = open(PATH, encoding="utf-8").read()


def test_every_id_lies_in_one_place(spark):
    library = Tokenizer.from_file(PATH)
    texts = [f"word{i} " * (i * 7 % 900) for i in range(200)] + TEXTS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = packing.pack(df, SPEC, capacity=512, width=16).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = (library.encode(text, add_special_tokens=False).ids if text else []) + [2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    used = sum(r.length for r in rows)
    assert used / (512 * len(sequences)) > 0.93


@pytest.mark.parametrize("histogram", [{1: 5}, {256: 3}, {100: 7, 150: 9, 40: 3}, {k: k % 7 + 1 for k in range(3, 257, 9)}, {}])
def test_patterns_hold_all_pieces(histogram):
    patterns = packing.plan(histogram, 256)
    slots = defaultdict(int)
    for pattern, times in patterns:
        assert sum(c * n for c, n in pattern.items()) <= 256 and times > 0
        for c, n in pattern.items():
            slots[c] += n * times
    assert all(slots[c] >= n for c, n in histogram.items())
    least = -(-sum(c * n for c, n in histogram.items()) // 256)
    assert sum(t for _, t in patterns) <= 1.15 * least + 2


def test_words_equal_the_library():
    library, encoder = Tokenizer.from_file(PATH), packing.WordEncoder(SPEC)
    texts = ["İ# lİ| ΑΣ ς., don't", "가 각 ᄀ? áb", "x<|endoftext|>y 1²ⅷ", "tab\tnew\nline\x1cfs", None, " ", *TEXTS]
    for text, packed in zip(texts, encoder.encode_all(texts)):
        want = library.encode(text, add_special_tokens=False).ids if text else []
        assert np.frombuffer(packed, "<u4").tolist() == want, repr(text)


def test_columns_are_encoded_as_they_are():
    """Arrow columns, also slices, of either string type; a batch's words are told apart by Arrow."""
    library, encoder = Tokenizer.from_file(PATH), packing.WordEncoder(SPEC)
    texts = ["skipped", *TEXTS, None, "", " \t", "a\x1cb\x0bc  d\r\n", "Straße, straße"]
    want = [library.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    for kind in (pa.string(), pa.large_string()):
        for column in (pa.array(texts, kind)[1:], pa.array(texts, kind)[2:4], pa.array([None], kind), pa.array([], kind)):
            at = {len(texts) - 1: 1, 2: 2}.get(len(column), 0)
            expected = want[at:at + len(column)] if at else [[]] * len(column)
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(column)] == expected


def test_word_cache_changes_generations(monkeypatch):
    """Tiny caches forget words at every batch; long words are never kept."""
    monkeypatch.setattr(packing, "CACHED", 4)
    monkeypatch.setattr(packing, "MISSES", 3)
    library, encoder = Tokenizer.from_file(PATH), packing.WordEncoder(SPEC)
    words = ["Straße", "straße,", "don't", "ς.", "É", "#", "12,", "x²", "long" * 30, "a\tb", "c\r\n", "the", "The|", ""]
    for k in range(40):
        texts = [" ".join(words[(k * 5 + i * 3 + j) % len(words)] for j in range(i + 1)) for i in range(6)]
        for text, packed in zip(texts, encoder.encode_all(texts)):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(packed, "<u4").tolist() == want, repr(text)
    assert max(map(len, [*encoder.words, *encoder.old])) <= packing.CACHED_CHARS


def test_awkward_rows(awkward, nothing):
    rows = packing.pack(awkward, SPEC).collect()
    assert sum(r.length for r in rows if r.doc_id is None) == sum(r.doc_tokens for r in rows if r.doc_id is None and r.start == 0)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(nothing, SPEC).count() == 0
