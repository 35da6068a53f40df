import math
import random
import re

from docrecon.llm import licenses


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, templates):
    words = words_of(text)
    stride = max(len(words_of(t.words)) for t in templates)
    out = set()
    for t in templates:
        w = words_of(t.words)
        if t.phrase:
            out |= {(t.label, True, k, k + len(w) - 1, 1.0) for k in range(len(words) - len(w) + 1) if words[k:k + len(w)] == w}
            continue
        for low in range(0, len(words), stride):
            part = words[low:low + 2 * stride]
            share = len(set(w) & set(part)) / len(set(w))
            if len(set(w) & set(part)) >= math.ceil(t.share * len(set(w)) - 1e-9):
                out.add((t.label, False, low, low + len(part) - 1, share))
    return sorted(out, key=lambda m: (m[2], m[3], m[0], m[1]))


def test_equals_brute_force(spark):
    draw = random.Random(2)
    pool = sorted({w for t in licenses.PHRASES + licenses.CLAUSES for w in t.words.split()}) + ["und", "the", "é漢"]
    texts = [None, "", "MIT license", "mit\nLicense mit license", "GNU General-Public License v3"]
    for _ in range(120):
        w = [draw.choice(pool) for _ in range(draw.randint(0, 150))]
        for _ in range(draw.randint(0, 3)):
            t = draw.choice(licenses.PHRASES + licenses.CLAUSES).words.split()
            gone = draw.sample(range(len(t)), min(len(t) - 1, draw.randint(0, 3)))
            w[draw.randint(0, len(w)):0] = [x for k, x in enumerate(t) if k not in gone]
        texts.append(draw.choice([" ", "\n", ", "]).join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        want = brute(texts[r.doc_id], licenses.PHRASES + licenses.CLAUSES)
        assert r.n_words == len(words_of(texts[r.doc_id]))
        assert sorted({tuple(m) for m in r.matches}, key=lambda m: (m[2], m[3], m[0], m[1])) == want, texts[r.doc_id]


def test_awkward_rows(awkward, nothing):
    rows = licenses.scan(awkward).collect()
    assert len(rows) == awkward.count() and all(not r.matches for r in rows)
    assert licenses.scan(nothing).count() == 0
