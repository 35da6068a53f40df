import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docrecon.llm import bpe

from texts import TEXTS

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_equals_the_library(encoder):
    library = Tokenizer.from_file(PATH)
    draw = random.Random(3)
    letters = "ab '\t\n\r\x1c\x85\xa0 é漢字🙂１²ⅷ́sdmlltre<|endoftext|>.,!0123\x00"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 500, "aaaa  aaa\n\n\n  b" * 10, "the" * 300, "x<|endoftext|> y<|endoftext|>"]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(encoder.encode(text)) == want, repr(text)


def test_replaying_merges_gives_the_same(encoder, vocabulary):
    rank = {(a, b): k for k, (a, b, _) in enumerate(vocabulary["merges"])}
    whole = {(a, b): w for a, b, w in vocabulary["merges"]}
    byte = {raw: t for t, raw in vocabulary["token"].items() if len(raw) == 1}
    draw = random.Random(5)
    for _ in range(300):
        raw = bytes(draw.choice(b"aeinrst ") for _ in range(draw.randint(1, 30)))
        parts = [byte[bytes([b])] for b in raw]
        while True:
            best = min(((rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            k = best[1]
            parts[k:k + 2] = [whole[parts[k], parts[k + 1]]]
        assert encoder.ids_of(raw) == parts


def test_awkward_rows(awkward, nothing, vocabulary):
    library = Tokenizer.from_file(PATH)
    rows = bpe.decode(bpe.encode(awkward, vocabulary), vocabulary).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r.doc_id is not None and r.doc_id not in (0, 3):
            text = TEXTS[r.doc_id] or ""
            want = library.encode(text, add_special_tokens=False).ids
            assert ids(r.ids) == want and r.n_tokens == len(want)
            assert r.decoded == library.decode(want, skip_special_tokens=False) == text
    assert bpe.decode(bpe.encode(nothing, vocabulary), vocabulary).count() == 0


def test_one_task_encodes_and_decodes(awkward, nothing, vocabulary):
    both = bpe.encode(awkward, vocabulary, decoded=True)
    apart = bpe.decode(bpe.encode(awkward, vocabulary), vocabulary)
    assert both.columns == apart.columns
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
    assert bpe.encode(nothing, vocabulary, decoded=True).count() == 0


def test_caches_change_generations(vocabulary, monkeypatch):
    """Tiny caches change generations within texts and blocks; ids stay those of the library."""
    monkeypatch.setattr(bpe, "CACHED", 6)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 5)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    small, library = bpe.Encoder(vocabulary), Tokenizer.from_file(PATH)
    draw = random.Random(11)
    words = ["Straße", "straße,", "l'été", "a", "it's", "x²", "don't.", "\n", "b\nc", "\t", "##", "don", "漢字", "Ärger!!",
             "été", "×", "a÷b", "", "ª", "'s", "s", ".", "1", "12,"]
    for _ in range(300):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(1, 30)))
        assert ids(small.encode(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)
    long = " ".join(draw.choice(words) for _ in range(20_000))
    assert ids(small.encode(long)) == library.encode(long, add_special_tokens=False).ids


def test_decodes_broken_bytes_and_unknown_ids(spark, vocabulary):
    packed = np.array([254, 70_000, 50256], "<u4").tobytes()
    df = spark.createDataFrame([(1, 3, packed), (2, 0, None)], "doc_id long, n_tokens long, ids binary")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, vocabulary).collect()}
    assert got[1].endswith("<|endoftext|>") and got[2] == ""
