"""Byte-level BPE: exact encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece the last token of its encoding is unique.  An automaton over the
vocabulary reports, at each position, the tokens that end there.  A token is the last one of the
prefix when it spans it, or when it is compatible with the last token of what stands before it.
Following these back-pointers gives exactly the ids that replaying all merges would give, in time
that grows with the length of a piece and not with the number of merges.
"""

from __future__ import annotations

import json
import re
import struct
import sys
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import batch_of, kept, raw_texts, sliced

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the tokenizer format: how it splits text, and its printable form of bytes.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# Letters in every Unicode version, and marks that stand after a word: such words are split without SPLIT.
LETTERS = "[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f]+"
MARKS = ".,;:!?#*$%&|"

CACHED = 800_000  # pieces and words of two generations, per worker process; none longer than CACHED_CHARS
CACHED_CHARS = 40
CACHED_PAIRS = 400_000
BLOCK = 65_536  # pieces of a text that are held at once
ROWS = 500  # of an output batch


def byte_alphabet() -> dict[str, int]:
    """Printable character to byte: printable bytes stand for themselves, the rest follow 255."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """Token bytes, merges and special strings of a ``tokenizers`` JSON file, as plain data.

    The size is that of the vocabulary file, whatever the data.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], spec["added_tokens"]
    plain = spec["pre_tokenizer"] or {}
    if (
        model["type"] != "BPE" or plain.get("type") != "ByteLevel" or not plain.get("use_regex")
        or plain.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges")
        or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    ):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    alphabet = byte_alphabet()
    raw = lambda token: bytes(alphabet[c] for c in token)
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {
        "token": {i: raw(t) for t, i in model["vocab"].items()},
        "merges": [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in merges],
        "special": {t["content"]: t["id"] for t in added},
    }


class Encoder:
    """Exact BPE ids of pieces of bytes."""

    def __init__(self, vocabulary: dict):
        self.token = dict(vocabulary["token"])
        self.special = vocabulary["special"]
        self.rank = {}  # of merged tokens; single bytes have none
        self.halves = {}
        self.merge = {}  # rank at which two neighbours merge
        for k, (a, b, whole) in enumerate(vocabulary["merges"]):
            self.merge[a, b] = k
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = k, (a, b)
        self.pairs: dict[int, dict[int, bool]] = {}  # right token, left token: whether they fit
        self.n_pairs = 0
        # Pieces (words with the space before them among them) met since the last change of generations,
        # and those of the generation before.
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = {t: len(raw) for t, raw in self.token.items()}
        sound = {t for t, raw in self.token.items() if len(raw) == 1}
        for whole, k in sorted(self.rank.items(), key=lambda x: x[1]):
            a, b = self.halves[whole]
            if a in sound and b in sound and self._apart(a, b, k):
                sound.add(whole)
        self.automaton = ahocorasick.Automaton()
        for t in sound:
            self.pairs[t] = {-1: True}  # any token may come first
            self.automaton.add_word(self.token[t].decode("latin-1"), (t, self.size[t], self.pairs[t]))
        self.automaton.make_automaton()
        self.whole = {self.token[t]: t for t in sound}
        self.split = regex.compile(SPLIT)
        self.letters = re.compile(LETTERS)
        self.across = re.compile(f"[{WHITE}] [{WHITE}]|  ")
        strings = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None

    def _apart(self, left: int, right: int, before: float = float("inf")) -> bool:
        """True unless a merge across the border of two tokens comes before ``before``.

        The parts at the border are unwound, the latest formed first.  ``before`` is when the
        present parts ceased to be there; of equal merges the leftmost comes first, so a merge
        across the border wins a tie against one inside the right token only.
        """
        rank = self.rank
        while True:
            across = self.merge.get((left, right))
            if across is not None and across < before:
                return False
            k, m = rank.get(left, -1), rank.get(right, -1)
            if k < 0 and m < 0:
                return True
            if k > m:
                before, left = k, self.halves[left][1]
            else:
                before, right = m + 1, self.halves[right][0]

    def compatible(self, left: int, right: int) -> bool:
        if self.n_pairs >= CACHED_PAIRS:
            for known in self.pairs.values():
                known.clear()
                known[-1] = True
            self.n_pairs = 0
        self.n_pairs += 1
        fits = self.pairs[right][left] = self._apart(left, right)
        return fits

    def ids_of(self, raw: bytes) -> list[int]:
        """Ids of one piece: last tokens of all prefixes, then back from the end."""
        last = [None] * len(raw) + [-1]  # -1 stands before the first byte, at index -1
        for at, (t, size, known) in self.automaton.iter(raw.decode("latin-1")):
            if last[at] is None:
                left = last[at - size]
                if left is not None:
                    fits = known.get(left)
                    if fits is None:
                        fits = self.compatible(left, t)
                    if fits:
                        last[at] = t
        ids, at, size_of = [], len(raw) - 1, self.size
        while at >= 0:
            ids.append(last[at])
            at -= size_of[last[at]]
        ids.reverse()
        return ids

    def _keep(self, piece: str, packed: bytes) -> bytes:
        if len(piece) <= CACHED_CHARS:
            if len(self.pieces) >= CACHED // 2:
                self.pieces, self.old = {}, self.pieces
            self.pieces[piece] = packed
        return packed

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the present generation has not met."""
        packed = self.old.get(piece)
        if packed is None:
            raw = piece.encode("utf-8")
            found = self.whole.get(raw)
            ids = self.ids_of(raw) if found is None else [found]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        return self._keep(piece, packed)

    def _pieces(self, text: str) -> bytes:
        make, found, out = self._piece, self.split.finditer(text), []
        while block := [m.group() for m in islice(found, BLOCK)]:
            get = self.pieces.get
            out.append(b"".join([get(p) or make(p) for p in block]))
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Ids of a word with the space before it: of letters, of letters and marks, or any."""
        if self.letters.fullmatch(word):
            return self._piece(" " + word)
        packed = self.old.get(" " + word)
        if packed is None:
            stem = word.rstrip(MARKS)
            if len(stem) < len(word) and self.letters.fullmatch(stem):
                get = self.pieces.get
                packed = get(" " + stem) or self._piece(" " + stem)
                tail = word[len(stem):]
                packed += get(tail) or self._piece(tail)
            else:
                packed = self._pieces(" " + word)
        return packed if "\n" in word else self._keep(" " + word, packed)

    def _plain(self, text: str) -> bytes:
        """A space is the start of a piece unless white space runs across it; so texts without
        such runs are the pieces of their words, and words repeat."""
        if self.across.search(text):
            return self._pieces(text)
        make, out = self._word, []
        first, *words = text.split(" ")
        for at in range(0, len(words), BLOCK):
            get = self.pieces.get
            out.append(b"".join([get(" " + w) or make(w) for w in words[at:at + BLOCK]]))
        return self._pieces(first) + b"".join(out)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(
            self.special[part].to_bytes(4, "little") if part in self.special else self._plain(part)
            for part in self.cut.split(text)
        )


class Decoder:
    """Texts of packed ids."""

    def __init__(self, vocabulary: dict):
        known = vocabulary["token"] | {i: s.encode("utf-8") for s, i in vocabulary["special"].items()}
        self.table = [known.get(i, b"") for i in range(max(known) + 1)]

    def decode(self, packed: bytes) -> str:
        """Bytes that are no valid UTF-8 become replacement characters; unknown ids give nothing."""
        ids = np.frombuffer(packed, "<u4")
        ids = ids[ids < len(self.table)].tolist()
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


def _name(vocabulary: dict) -> tuple:
    return len(vocabulary["token"]), vocabulary["merges"][-1]


def encode(df: DataFrame, vocabulary: dict, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """``(id, n_tokens, ids)`` of every row; ``ids`` are packed little-endian unsigned 32-bit.

    With ``decoded`` the text that ``decode`` gives for these ids follows, from the same Python task.
    A null text counts as empty and has no ids.  Rows are independent: ties, repeated rows and
    null ids pass through; other columns are not read.  No shuffle; a task holds one batch.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.large_binary())]
    schema = pa.schema(fields + [("decoded", pa.large_string())] * decoded)

    def work(batches):
        encoder = kept(("bpe", _name(shared.value)), lambda: Encoder(shared.value))
        decoder = kept(("bpe-decode", _name(shared.value)), lambda: Decoder(shared.value)) if decoded else None
        for b in sliced(batches, ROWS):
            ids = [encoder.encode(x) if x else b"" for x in b.column("text").to_pylist()]
            texts = [[decoder.decode(x) for x in ids]] if decoder else []
            yield batch_of(schema, b.column("id"), [len(x) // 4 for x in ids], ids, *texts)

    out = rows.withColumn("id", F.col("id").cast("long")).mapInArrow(
        work, "id long, n_tokens long, ids binary" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: dict, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of packed ids (null: empty); special ids give their strings.

    Bytes that are no valid UTF-8 become replacement characters.  An id outside the vocabulary
    gives nothing.  Input columns other than the id, ``n_tokens`` and the ids are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    rows = df.select(F.col(id_col).alias("id"), "n_tokens", F.col(ids_col).alias("ids"))
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.large_binary()),
                        ("decoded", pa.large_string())])

    def work(batches):
        decoder = kept(("bpe-decode", _name(shared.value)), lambda: Decoder(shared.value))
        for b in sliced(batches, ROWS):
            texts = [decoder.decode(packed) for packed in raw_texts(b.column("ids"))]
            yield batch_of(schema, b.column("id"), b.column("n_tokens"),
                           b.column("ids").cast(pa.large_binary()), texts)

    out = rows.mapInArrow(work, "id long, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
