from collections import defaultdict

import numpy as np

from docrecon.llm import bloom, lines


def brute(rows, min_chars=20, min_docs=3):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    low = lambda i: -(1 << 63) if i is None else i
    docs, owner = defaultdict(int), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            docs[k] += 1
            owner[k] = max(owner.get(k, -(1 << 63)), low(i))
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        left = [x for x in all_ if not (len(k := key(x)) >= min_chars and docs[k] >= min_docs and low(i) < owner[k])]
        out.append((i, "\n".join(left), len(all_), len(all_) - len(left)))
    return sorted(out, key=str)


def test_equals_brute_force(spark, awkward):
    hot = "This line stands in every document of all"
    rows = [(i, f"{hot.upper() if i % 2 else hot}  \nown line number {i % 7} of the text, long enough\n\nshort {i}")
            for i in range(300)]
    rows += [(299, f"{hot}\n{hot}"), (1, None), (2, ""), (None, hot), (400, "äöüß" * 5), (401, "äöüß" * 5), (402, "äöüß" * 5)]
    rows += [(r.doc_id, r.text) for r in awkward.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (bloom.BITS, 16):  # a filter that is far too small gives the same
        got = sorted((tuple(r) for r in lines.dedup_lines(df, bits=bits).collect()), key=str)
        assert got == brute(rows)


def test_awkward_rows_keep_their_columns(awkward, nothing):
    kept = lines.dedup_lines(awkward, keep=True)
    assert kept.count() == awkward.count()
    assert set(kept.schema["row"].dataType.names) == set(awkward.columns)
    assert lines.dedup_lines(nothing).count() == 0


def test_filters_never_lose_a_key(spark):
    df = spark.createDataFrame([(int(k),) for k in np.random.default_rng(1).integers(0, 1 << 62, 3000).tolist() * 2],
                               "h long").repartition(7)

    def bits(batches):
        yield from bloom.partial_filters(
            (b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches), 20)

    twice = bloom.merged(df.mapInArrow(bits, bloom.PARTIAL_DDL), 20)
    seen = np.unique(np.array([r.h for r in df.collect()]).view(np.uint64))
    assert bloom.passes(twice, seen).all()
    assert bloom.passes(twice, np.random.default_rng(2).integers(0, 1 << 62, 5000).view(np.uint64)).mean() < 0.05
