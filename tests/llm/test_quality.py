import random
import re
from collections import Counter

from docrecon.llm import quality

WHITE = r"\x20\x09-\x0D"


def brute(text):
    t = text or ""
    w = re.findall(rf"[^{WHITE}]+", t)
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if n[x] > 1 for j in range(3)}
    seen, same = set(), 0
    for x in t.split("\n"):
        if re.search(rf"[^{WHITE}]", x):
            same += x in seen
            seen.add(x)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), same, len(covered), failed


def test_statistics_equal_brute_force(spark, awkward):
    draw = random.Random(1)
    parts = ["a", "b", "the", "#x#", "é漢🙂", "<p>", "\n", "\t", "\x0b", "\x1c", "\xa0", "  ", "\r\n"]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", "", "\n"]) for _ in range(draw.randint(0, 200))) for _ in range(150)]
    texts += [r.text for r in awkward.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality.judge(df, labels).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(texts[r.doc_id]), repr(texts[r.doc_id])
        assert r.kept == (not r.base_failed) and r.rule is None


def corpus(spark, n=1500):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [draw.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(draw.randint(0, 999))
                 for _ in range(draw.randint(60, 120))]
        if bad:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), "en"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string"),
            spark.createDataFrame(labels + [(0, 0, 0), (None, 1, 0), (2, None, 0), (10**9, 0, 0)], "doc_id long, quality int, toxic int"))


def test_learns_what_the_labels_tell(spark):
    df, labels = corpus(spark)
    rows = quality.judge(df, labels).collect()
    assert all(r.kept == (r.doc_id % 6 != 0) for r in rows)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id % 6 for r in kept.collect()} == {1, 2, 3, 4, 5}


def test_plan_has_no_python(spark):
    df, labels = corpus(spark, 60)
    for out in (quality.judge(df, labels), quality.keep_good(df, labels)):
        plan = out._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def test_awkward_rows(awkward, nothing, spark):
    _, labels = corpus(spark, 60)
    assert quality.judge(awkward, labels).count() == awkward.count()
    assert quality.judge(nothing, labels).count() == 0
    assert quality.keep_good(awkward, labels).columns == awkward.columns


def test_rejects_toxic_texts_of_good_shape(spark):
    draw = random.Random(4)
    pool, insults = [f"word{chr(97 + k % 26)}{k}" for k in range(400)], ["grub", "Knave", "oaf"]
    rows, labels = [], []
    for i in range(1500):
        words = [draw.choice(pool) for _ in range(draw.randint(60, 120))]
        if i % 10 == 0:
            words[draw.randrange(len(words))] = draw.choice(insults).upper() + draw.choice(["", ",", "!!"])
        rows.append((i, " ".join(words)))
        if i % 2 == 0 and i < 1000:
            labels.append((i, None if i % 4 else 1, int(i % 10 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality.toxic_words(df, labels) == ["grub", "knave", "oaf"]
    assert {r.doc_id for r in quality.judge(df, labels).collect() if not r.kept} == set(range(0, 1500, 10))
    assert {r.doc_id for r in quality.keep_good(df, labels).collect()} == {i for i in range(1500) if i % 10}
    assert quality.toxic_words(df, labels.where("toxic = 0")) == [] == quality.toxic_words(df, labels.limit(0))


def test_statistics_are_worked_out_once(spark):
    """The filter of the pipeline's stage reads written statistics; it splits no text again."""
    rows = [(i, "some words of a text that is long enough to be kept " * 8 + ("bad ! ! ! " * 9 if i % 3 == 0 else f"{i} x")) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(df, labels)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "Filter" in plan
    judged = quality.judge(df, labels).where("kept").select("doc_id").collect()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged}
