import math
from collections import Counter, defaultdict

import numpy as np

from docrecon.llm import lm

from texts import TEXTS


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()


def brute_ppm(train, text):
    """Counts in plain dictionaries, contexts from long to short, with escapes and exclusion."""
    counts = defaultdict(Counter)
    total = 0
    for t in train:
        b = lm.START + t + bytes([lm.END])
        for k in range(len(lm.START), len(b)):
            total += 1
            for d in range(lm.ORDER + 1):
                counts[d, b[k - d:k]][b[k]] += 1
    b, points = lm.START + text + bytes([lm.END]), 0.0
    for k in range(len(lm.START), len(b)):
        out, done = set(), False
        for d in range(lm.ORDER, -1, -1):
            seen = counts.get((d, b[k - d:k]), {})
            if d > 1 and sum(seen.values()) * lm.NODES < total:
                continue
            here = {s: n for s, n in seen.items() if s not in out}
            if not here:
                continue
            whole = sum(here.values()) + len(here)
            if b[k] in here:
                points += math.log10(here[b[k]] / whole)
                done = True
                break
            points += math.log10(len(here) / whole)
            out |= set(here)
        if not done:
            points -= math.log10(256 - len(out))
    return points


def brute_base(train, text):
    n = Counter()
    for t in train:
        n.update(t.split())
        n["end"] += 1
    total, kinds = sum(n.values()), len(n)
    words = [*text.split(), "end"]
    return (len(words), sum(n[w] > 0 for w in words), total,
            sum(math.log10((n[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words))


def made(n):
    draw = np.random.default_rng(1)
    pool = ["".join(draw.choice(list("aeioubcdfé"), draw.integers(1, 7))) for _ in range(60)]
    return [" ".join(draw.choice(pool, draw.integers(0, 60))) for _ in range(n)]


def test_equals_brute_force(spark):
    texts = made(60) + ["Ab aB\nAB", "", "\x00\x01 zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [low(t) for i, t in enumerate(texts) if i % 3]
    for share in (lm.SHARE, 20):  # with few frequent tokens the rest meet their counts in the join
        for r in lm.score(df, df.where("doc_id % 3 <> 0"), share=share).collect():
            t = low(texts[r.doc_id])
            base = brute_base(train, t)
            assert (r.n_tokens, r.n_known, r.train_tokens) == base[:3]
            assert math.isclose(r.base_score, base[3], rel_tol=1e-9)
            assert math.isclose(r.score, brute_ppm(train, t), rel_tol=1e-4, abs_tol=1e-4)


def test_probabilities_sum_to_one(spark):
    grams, n = lm.gram_counts([low(t) for t in made(30)])
    levels = []
    for d in range(lm.ORDER + 1):
        names, at = np.unique(grams & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels.append((names, np.bincount(at, n)))
    model = lm.build(levels)
    used = np.ones(len(model.rows), bool)
    used[model.first] = False
    assert np.allclose((10.0 ** model.rows[used].astype(float)).sum(axis=1), 1, atol=1e-4)


def test_adaptive_learns_a_repeating_text():
    assert lm.adaptive_score(b"abcabcabc" * 40) > 4 * lm.adaptive_score(bytes(range(97, 117)) * 18)
    assert lm.adaptive_score(b"") == -math.log10(256)


def test_awkward_rows(awkward, nothing):
    rows = lm.score(awkward, awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r.doc_id in (1, 2, 3) and r.n_tokens == 1:
            assert r.n_known == 1 and r.score < 0
        assert r.score <= 0 and r.n_tokens >= 1
    assert {r.n_tokens for r in rows if r.doc_id == 6} == {2} and TEXTS[6]
    untaught = lm.score(awkward, nothing).collect()
    assert {(r.n_known, r.train_tokens) for r in untaught} == {(0, 0)} and all(math.isfinite(r.score) for r in untaught)
    assert lm.score(nothing, awkward).count() == 0
    assert lm.score(awkward.limit(3), awkward, adaptive=True).count() == 3


def whole_ppm(train, texts):
    """PPM in plain dictionaries with every context that was ever seen."""
    counts = defaultdict(Counter)
    for t in train:
        b = lm.START + t + bytes([lm.END])
        for k in range(len(lm.START), len(b)):
            for d in range(lm.ORDER + 1):
                counts[b[k - d:k]][b[k]] += 1
    for text in texts:
        b, points = lm.START + text + bytes([lm.END]), 0.0
        for k in range(len(lm.START), len(b)):
            out, done = set(), False
            for d in range(lm.ORDER, -1, -1):
                here = {s: n for s, n in counts.get(b[k - d:k], {}).items() if s not in out}
                if not here:
                    continue
                whole = sum(here.values()) + len(here)
                done = b[k] in here
                points += math.log10((here[b[k]] if done else len(here)) / whole)
                if done:
                    break
                out |= set(here)
            if not done:
                points -= math.log10(256 - len(out))
        yield points


def test_rare_contexts_count_too(spark):
    draw = np.random.default_rng(3)
    rare = ["".join(draw.choice(list("qwxzjkvß漢 "), 40)) for _ in range(30)]
    texts = rare + rare[:10] + made(4000)  # most contexts of the first ones are seen once or twice
    train = [low(t) for i, t in enumerate(texts) if i % 3]
    assert sum(len(t) + 1 for t in train) > 2 * lm.NODES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = list(whole_ppm(train, [low(t) for t in texts[:60]]))
    for more in ({}, {"warm": 1 << 12}, {"nodes": 50, "warm": 50}):  # ever more of them meet in the join
        got = {r.doc_id: r.score for r in lm.score(df.where("doc_id < 60"), df.where("doc_id % 3 <> 0"), **more).collect()}
        assert np.allclose([got[i] for i in range(60)], want, rtol=1e-4, atol=1e-4)


def test_gram_points_sum_to_one():
    grams, n = lm.gram_counts([low(t) for t in made(30)])
    levels = []
    for d in range(2):
        names, at = np.unique(grams & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels.append((names, np.bincount(at, n).astype(np.int64)))
    for context in (int(grams[0]) >> 8, int(grams[5]) >> 8 | 0xFE << 24, int(grams[9]) >> 8 & 0xFF | 0xFEFE00, 0xFEFEFEFE):
        asked = np.arange(256) + (context << 8)
        assert math.isclose((10 ** lm.gram_points(asked, grams, n, levels)).sum(), 1, rel_tol=1e-9)
    none = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
    assert np.allclose(lm.gram_points(asked, grams[:0], n[:0], none), -math.log10(256))
