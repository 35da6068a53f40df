import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docrecon.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def brute_tree(nodes):
    """Top and, for each leaf, its siblings level by level (null: none; else side and digest)."""
    proofs, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            proofs[k].append((j < i, level[j]) if j < len(level) else None)
        level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0] if level else None, proofs


def brute(rows):
    """(id, leaf, subroot, root, siblings) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: brute_tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, upper = brute_tree([made[g][0] for g in names])
    return [
        (x[3], x[2], made[g][0], root, made[g][1][k] + upper[m])
        for m, g in enumerate(names) for k, x in enumerate(sorted(groups[g]))
    ]


def found(df):
    return [
        (r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(),
         [None if s.sibling is None else (s.left, s.sibling.hex()) for s in r.proof])
        for r in df.collect()
    ]


@pytest.mark.parametrize("stride", [2, 8])
def test_equals_brute_force(spark, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    draw = random.Random(stride)
    rows = [(i, f"src{i % 3}", draw.choice(["en", "en", "en", "de", None, "", "é", "zz"]), draw.choice([None, i]),
             draw.choice([None, "", "text", "Größe 漢字 " * 5])) for i in draw.sample(range(10_000), 300)]
    rows += [(5, "s", "lone", 1, "x")] + [(77, "s", "en", 2, "same")] * 5 + [(None, None, "en", None, None), (77, "t", "en", 2, "other")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = found(merkle.manifest(df))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], str(x[4]))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("n", [1, 4, 17])
def test_sizes_about_a_power_of_two(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "STRIDE", 2)
    rows = [(i, None, "en", i, f"text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(found(merkle.manifest(df)), key=lambda x: x[0]) == brute(rows)


def test_tampering_shows(spark):
    rows = [(i, "s", "en" if i % 3 else None, i, "t" * i) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    changed = merkle.leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    made = merkle.manifest(df, carry={"changed": changed})
    got = made.select("doc_id", (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("good"),
                      (merkle.folded(F.col("changed"), F.col("proof")) == F.col("root")).alias("bad")).collect()
    assert len(got) == 150 and all(r.good and not r.bad for r in got)


def test_query_equals_brute_force(spark, tmp_path):
    from docrecon.llm.queries import QUERIES

    rows = [(i, "s", ["en", "de", None][i % 3], None if i % 5 == 0 else i, f"text {i}") for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_merkle"](spark, str(tmp_path)).collect()}
    for i, mine, subroot, root, proof in brute(rows):
        node = leaf(*[x + 1 if k == 3 and x is not None else x for k, x in enumerate(rows[i])]) \
            if zlib.crc32(str(i).encode()) % 7 == 0 else mine
        for step in proof:
            node = h(node) if step is None else h(step[1], node) if step[0] else h(node, step[1])
        want = (mine, subroot, root, h(*[s[1] for s in proof if s]), node, node == root)
        r = got[i]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == want


def test_awkward_rows(awkward, nothing):
    fields = ["doc_id", "text", "lang", "row"]
    made = merkle.manifest(awkward, fields=fields)
    assert made.count() == awkward.count()
    assert made.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert merkle.manifest(nothing, fields=fields).count() == 0
