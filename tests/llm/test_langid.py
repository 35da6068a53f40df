import numpy as np

from docrecon.llm import langid

EN = "the and of that with this from have which their would there about could"
FR = "les des une dans pour que est par avec sur pas plus nous vous leur"


def corpus(spark):
    draw = np.random.default_rng(1)
    rows = [(i, " ".join(draw.choice((EN if i % 3 else FR).split(), 40)), "en" if i % 3 else "fr", None) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def brute(texts, langs, text):
    """Posteriors by plain counting of the same buckets."""
    def grams(t):
        t = " " + t.lower() + " "
        return langid.buckets(np.array([ord(c) for c in t], np.uint32), langid.BITS)

    names, logs = sorted(set(langs)), []
    for name in names:
        n = np.zeros(1 << langid.BITS)
        mine = [t for t, x in zip(texts, langs) if x == name]
        for t in mine:
            np.add.at(n, grams(t), 1)
        p = np.log((n + 0.1) / (n + 0.1).sum())
        logs.append(np.log(len(mine) / len(texts)) + p[grams(text)].sum())
    logs = np.array(logs)
    return names[int(logs.argmax())], float(1 / np.exp(logs - logs.max()).sum())


def test_equals_brute_force_and_is_right(spark):
    df = corpus(spark)
    rows = df.collect()
    model = langid.learn(df.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    train = [r for r in rows if r.doc_id % 5]
    for r in rows[:20]:
        name, score = brute([t.text for t in train], [t.lang for t in train], r.text)
        assert got[r.doc_id].lang_pred == name and abs(got[r.doc_id].score - score) < 1e-3
    held = [r for r in rows if r.doc_id % 5 == 0]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98


def test_long_texts_are_sliced_without_loss(monkeypatch):
    text = "Größe und Maß " * 50
    whole = np.sort(np.concatenate([langid.buckets(c, 12) for c in langid.text_slices(text)]))
    monkeypatch.setattr(langid, "SLICE", 37)
    parts = np.sort(np.concatenate([langid.buckets(c, 12) for c in langid.text_slices(text)]))
    assert (whole == parts).all()


def test_awkward_rows(spark, awkward, nothing):
    model = langid.learn(corpus(spark))
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (1, 2, 3) and r.lang_pred != "und":
            assert r.doc_id == 3  # the second row of that id has letters
    assert langid.identify(nothing, model).count() == 0
    empty = langid.learn(nothing)
    assert {r.lang_pred for r in langid.identify(awkward, empty).collect()} == {"und"}
    kept = langid.identify(awkward, model, keep=True)
    assert set(kept.schema["row"].dataType.names) == set(awkward.columns)
