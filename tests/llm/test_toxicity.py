import itertools
import math
import random

import numpy as np
import pytest

from docrecon.llm import toxicity as tox

INSULTS = ["idiot", "moron", "scum", "pathetic", "worthless", "clown"]


def sentences(draw, n):
    pool = ["".join(draw.choice(["the", "re", "on", "an", "ti", "ha", "wh", "bleu", "sh"]) for _ in range(draw.randint(1, 4)))
            for _ in range(300)]
    out = []
    for k in range(n):
        words = draw.choices(pool, k=draw.randint(20, 80))
        if k % 4 == 0:
            for _ in range(draw.randint(3, 6)):
                words[draw.randrange(len(words))] = draw.choice(INSULTS)
        out.append((k, " ".join(words), int(k % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = sentences(random.Random(1), 400)
    return tox.fit([t for _, t, _ in rows], np.array([x == 1 for *_, x in rows]))


def brute_features(s):
    """Weights of all subsequences of three characters, by plain loops."""
    of = tox.classes()
    c = [tox.START, *[int(of[ord(x) & 0xFFFF]) for x in s], tox.END]
    out, norm = {}, 0.0
    for i, j, k in itertools.combinations(range(len(c)), 3):
        if k - i < tox.REACH:
            w = tox.DECAY ** (k - i + 1)
            out[c[i], c[j], c[k]] = out.get((c[i], c[j], c[k]), 0.0) + w
            norm += w * w
    return {u: w / math.sqrt(norm) for u, w in out.items()}


def test_kernel_equals_brute_force():
    marks, words = ["idiot", "moron", "achlich", "a", "é漢x"], ["idiot", "idxiot", "maroon", "", "achlichkeit", "漢é"]
    got = tox.Landmarks(marks).kernel(words)
    for x, row in zip(words, got):
        for y, k in zip(marks, row):
            a, b = brute_features(x), brute_features(y)
            assert abs(k - sum(w * b.get(u, 0.0) for u, w in a.items())) < 1e-5


def test_the_table_gives_the_value_of_the_map():
    space = tox.Landmarks(["idiot", "moron", "scum", "there"])
    w = np.array([1.0, -2.0, 0.5, 0.25])
    words = ["idiot", "morons", "sccum", "other", "zzz"]
    assert np.allclose(space.mapped(words) @ np.append(w, 0.0), tox.values(words, space.table(w), 0.0), atol=1e-4)


def test_strings():
    strings = tox.Strings()
    strings.of("An I.D.I.O.T, and an i d i o t ### " + "x" * 60)
    assert {"an", "idiot", "and", "i", "d", "o", "t", "", "x" * 24} <= set(strings.number)
    assert all(len(s) <= tox.WIDTH for s in strings.number)


def test_held_out_and_changed_insults(spark, model):
    def scores(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        return {r.doc_id: r.score for r in tox.score(df, model).collect()}

    rows = sentences(random.Random(2), 200)
    got = scores(rows)
    assert all((got[k] >= 0.3) == (x == 1) for k, _, x in rows)
    for change in (lambda w: ".".join(w), lambda w: " ".join(w), lambda w: w[:2] + "x" + w[2:], lambda w: w[:3] + w[2:],
                   lambda w: w.upper() + "!!!"):
        changed = [(k, " ".join(change(w) if w in INSULTS else w for w in t.split()), x) for k, t, x in rows]
        got = scores(changed)
        assert sum(got[k] >= 0.3 for k, _, x in changed if x) >= 0.9 * 50
        assert not any(got[k] >= 0.3 for k, _, x in changed if not x)


def test_learns_from_labelled_rows(spark, monkeypatch):
    rows = sentences(random.Random(3), 300)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(None, "idiot")] + [rows[0][:2]] * 3, "doc_id long, text string")
    labels = [(k, x) for k, _, x in rows if k % 3] + [(1, None), (None, 1), (4, 1), (4, 0), (999, 1)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(tox, "HELD", 5000)
    model = tox.learn(docs, known)
    got = {r.doc_id: r.score for r in tox.score(docs, model).collect() if r.doc_id is not None}
    assert all((got[k] >= 0.3) == (x == 1) for k, _, x in rows if k % 3 == 0)
    few = tox.learn(docs, known, sample=100)
    assert few is not None and few.table.shape == model.table.shape
    assert tox.learn(docs, known.where("toxic = 0")) is None
    assert tox.learn(docs.where("false"), known) is None


def test_awkward_rows(awkward, nothing, model):
    rows = tox.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id is None} <= {r.score for r in rows}
    assert tox.score(nothing, model).count() == 0
    assert all(r.score == 0 for r in tox.score(awkward, None).collect())
