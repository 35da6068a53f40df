import pathlib
import time

import pytest

import corpus_pipeline
from docrecon.llm import common, lines
from docrecon.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output on the small table, with rows that planted cases add."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    top = docs.agg({"doc_id": "max"}).first()[0]
    text = docs.where("lang = 'en' and n_chars between 3000 and 6000").orderBy("doc_id").first().text
    words = text.split(" ")
    near = [(top + 1 + k, " ".join(words[:k] + ["changed"] + words[k + 1:]), "en", "s", len(text)) for k in (40, 90)]
    extra = [(top + 200, None, None, None, None), (top + 201, "", "en", "s", 0), (top + 202, "123 456 " * 40, "en", "s", 320)]
    docs = docs.union(spark.createDataFrame(near + extra, docs.schema))
    folder, out = tmp_path_factory.mktemp("stages"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out, top


def test_stages_keep_columns_and_only_lose_rows(stages):
    tables, _ = stages
    for before, after in zip(tables[:-2], tables[1:-1]):
        assert after.schema.names == before.schema.names
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        assert after.count() > 0.5 * before.count()


def test_language_and_quality_reject_what_is_no_text(stages):
    tables, top = stages
    left = {r.doc_id for r in tables[1].collect()}
    assert not left & {top + 200, top + 201, top + 202}
    assert tables[1].count() == tables[0].count() - 3
    assert {r.doc_id for r in tables[2].collect()} <= left


def test_one_of_each_group_stays(stages):
    tables, _ = stages
    rows = [(r.doc_id, r.text) for r in tables[3].collect()]
    from test_ngram import brute

    want = {i for i, _, least in brute(rows, 5, 80, 100) if i == least}
    assert {r.doc_id for r in tables[4].collect()} == want


def test_packing_holds_what_is_left(stages):
    tables, _ = stages
    assert {r.doc_id for r in tables[5].select("doc_id").distinct().collect()} == {r.doc_id for r in tables[4].collect()}


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_lines_stage_keeps_every_row(spark):
    a, b = "a line that three documents share", "and another one that they share"
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\nown words"), (3, a), (4, b), (5, b), (6, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.distinct_lines(spark, docs, SF).collect()}
    assert got == {1: ("", 0), 2: ("own words", 9), 3: (a, len(a)), 4: ("", 0), 5: (b, len(b)), 6: ("", 0), None: (None, 0)}


def test_near_copies_are_removed_by_row(spark):
    copied, own = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    null = " ".join(f"u{k}" for k in range(60))
    rows = [(1, copied), (2, copied + " end"), (2, own), (3, own), (3, own), (None, copied), (None, null),
            (None, null), (4, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.one_of_each(spark, docs, SF)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert out.columns == docs.columns
    assert got == sorted([(1, copied), (2, own), (None, null), (4, ""), (4, None)], key=repr)


def test_stages_take_an_empty_table_and_clashing_columns(spark):
    """Each stage on no rows, and on rows with columns named like the operators' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    more = docs.selectExpr("*", "1 AS _row", "'x' AS row", "2 AS n_words", "'k' AS keys", "3 AS node", "4 AS score", "5 AS id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns, name
        assert out.where("_row <> 1 or row <> 'x' or n_words <> 2 or score <> 4").count() == 0, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert corpus_pipeline.packed(spark, docs.where("false"), SF).count() == 0


def test_repeated_rows_pass_language_and_quality_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.union(docs.where("doc_id < 50"))
    for stage in (corpus_pipeline.language, corpus_pipeline.good):
        kept = stage(spark, twice, SF).groupBy("doc_id").count().collect()
        assert all(r["count"] == (2 if r.doc_id < 50 else 1) for r in kept)


def test_written_tables_leave_no_shuffle_files(spark):
    """Tables that are written need no shuffle any more."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {p.name for d in disk.localDirsString() for p in pathlib.Path(d).glob("*/shuffle_*.data")}

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = files()
    left = common.settled(docs.repartition(3, "doc_id").groupBy("text").count(), "test")
    for _ in range(40):
        new = files() - before
        if not new:
            break
        time.sleep(0.25)
    assert not new
    assert left.count() > 0
    common.forget(left)


def test_lines_shuffle_each_text_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = lines.dedup_lines(docs, keep=True)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    side = next(x for x in plan[plan.index("Join"):].split("\n") if "struct(doc_id" in x)
    assert side.rstrip("]").split(" AS ")[-1].startswith("row#") and ", text#" not in side.split(" AS row#")[1]


def test_workers_drop_what_others_keep():
    made = common.kept(("test-words", 1), lambda: [1])
    assert common.kept(("test-words", 1), lambda: [2]) is made
    common.unkept()
    assert common.kept(("test-words", 1), lambda: [2]) == [2]
