import hashlib
import random

import numpy as np

from docrecon.llm import fingerprints as fp


def walk(text, stay):
    """The walk read one step at a time: output symbols."""
    out, j = [], 0
    for c in text:
        k = ((ord(c) * 0x9E3779B1) & 0xFFFFFFFF) >> 24
        n = int(stay[((j & (fp.PERIOD - 1)) << 8) | k])
        out += [ord(c)] * n
        j += n
    return out


def brute(text):
    out, stay = walk(text, fp.walk_table()), fp.walk_table()
    row = []
    for steps in fp.sample_records():
        at = int(steps[np.searchsorted(steps, max(len(out) - 1, 0), "right") - 1])
        mixed = 0
        for k in range(fp.GRAM):
            symbol = out[at + k] if at + k < len(out) else 0
            mixed = (mixed ^ (symbol + 1)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            mixed ^= mixed >> 29
        row.append(mixed >> 56)
    return row


def made(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij klmnop.é漢") for _ in range(draw.choice([0, 1, 3, 50, 700]))) for _ in range(n)]


def test_equals_reading_step_by_step():
    texts = made(40) + ["", "a", "aa", "x" * 3000]
    assert fp.fingerprints(texts).tolist() == [brute(t) for t in texts]


def test_small_edits_stay_near_and_others_do_not():
    draw = random.Random(3)
    texts = [t for t in made(80, 4) if len(t) == 700]
    edits = []
    for t in texts:
        s = list(t)
        for _ in range(3):
            k = draw.randrange(len(s))
            s[k:k + draw.randint(0, 1)] = draw.choice(["", "q", "zz"])
        edits.append("".join(s))
    a, b = fp.fingerprints(texts), fp.fingerprints(edits)
    assert fp.likeness(a, b).mean() > 0.75
    assert fp.likeness(a, np.roll(b, 1, axis=0)).mean() < 0.2


def test_compares_with_the_next_row(spark, monkeypatch):
    texts = made(300, 5)
    df = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    rows = {r.doc_id // 3: r for r in fp.compare_edited(df).collect()}
    prints = fp.fingerprints(texts)
    for i, t in enumerate(texts):
        changed = fp.edited(t, texts[(i + 1) % len(texts)])
        r = rows[i]
        assert r.edited == changed and r.n_chars == len(t)
        assert r.fingerprint == prints[i].tobytes().hex()
        assert r.edited_fingerprint == fp.fingerprints([changed])[0].tobytes().hex()
        assert r.near_next == (prints[i] == prints[(i + 1) % len(texts)]).mean()
    assert hashlib.sha256(rows[0].edited.encode()).hexdigest()


def test_near_duplicates_share_a_class(spark):
    base = [t for t in made(60, 6) if len(t) == 700][:8]
    rows = []
    for g, t in enumerate(base):
        rows += [(100 * g + k, t[:350 + k] + t[351 + k:]) for k in range(12)] + [(100 * g + 50, t), (100 * g + 51, t)]
    got = {r.doc_id: r.class_id for r in fp.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = fp.fingerprints([t for _, t in rows])
    near = (prints[:, None] == prints[None]).mean(axis=2) >= 0.8
    least = np.array([i for i, _ in rows])
    for _ in range(len(rows)):  # brute force: all pairs, until the least ids stand still
        least = np.where(near, least[None], 1 << 40).min(axis=1)
    assert got == dict(zip([i for i, _ in rows], least.tolist()))
    assert sum(got[i] == 100 * (i // 100) for i in got) > 0.9 * len(got)
    assert all(got[i] // 100 == i // 100 for i in got)


def test_awkward_rows(awkward, nothing):
    assert fp.compare_edited(awkward).count() == awkward.count()
    assert fp.compare_edited(nothing).count() == 0
    assert fp.compare_edited(awkward.where("doc_id = 4")).collect()[0].near_next == 1.0
    assert fp.fingerprint(awkward).count() == awkward.count()
