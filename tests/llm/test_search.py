import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docrecon.llm import search


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                        * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return out


def by_rank(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def texts(draw, n):
    pool = ["".join(draw.choice("abcdé漢") for _ in range(draw.randint(1, 3))) for _ in range(150)]
    weights = [1 / (k + 1) for k in range(150)]
    return [" ".join(draw.choices(pool, weights, k=draw.choice([1, 5, 40, 400]))) for _ in range(n)]


@pytest.mark.parametrize("rows,terms", [(64, 1 << 17), (1 << 14, 60)])
def test_equals_brute_force(spark, monkeypatch, rows, terms):
    monkeypatch.setattr(search, "ROWS", rows)
    monkeypatch.setattr(search, "TERMS", terms)
    draw = random.Random(4)
    docs = list(enumerate(texts(draw, 500)))
    docs += [docs[3]] * 30 + [(None, docs[5][1]), (None, None), (600, ""), (601, ".,;"), (602, "ABC\x00Éa b-c_d")]
    items = list(enumerate(texts(draw, 12))) + [(0, "more terms"), (None, docs[7][1]), (90, None), (91, "nowhere"), (92, " ".join(texts(draw, 40)))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in search.search(d, spark.createDataFrame(items, "item_id long, text string"), k=20).collect()]
    assert by_rank(got) == by_rank(brute(docs, items, 20))
    assert len(terms_of(items[-1][1])) > 64  # masks of several words


def test_few_groups_are_scored(monkeypatch):
    """Groups below the k-th score are left alone."""
    draw = np.random.default_rng(1)
    rows_of = {t: (np.flatnonzero(draw.random(5000) < 0.02 * (t + 1)), None) for t in range(10)}
    rows_of = {t: (r, draw.integers(1, 4, len(r))) for t, (r, _) in rows_of.items()}
    item = search.Item(0, np.arange(10), np.array([5000 - 400 * t for t in range(10)]))
    calls = []
    plain = search.contribution
    monkeypatch.setattr(search, "contribution", lambda tf, m: calls.append(np.size(tf)) or plain(tf, m))
    none = np.zeros(0, np.int64)
    scores, ids = search.best(item, rows_of, np.full(5000, 100), np.arange(5000), 10, (none, none))
    whole = np.zeros(5000, np.int64)
    for t, (r, tf) in rows_of.items():
        whole[r] += item.weights[t] * plain(tf, 100)
    want = np.lexsort((np.arange(5000), -whole))[:10]
    assert ids.tolist() == want.tolist() and scores.tolist() == whole[want].tolist()
    assert sum(calls) < sum(len(r) for r, _ in rows_of.values()) / 5


def test_awkward_rows(spark, awkward, nothing):
    items = awkward.withColumnRenamed("doc_id", "item_id").withColumnRenamed("row", "score")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = [tuple(r) for r in search.search(awkward, items).collect()]
    assert by_rank(got) == by_rank(brute(rows, rows, 50))
    assert search.search(nothing, items).count() == 0
    assert search.search(awkward, items.where("false")).count() == 0
