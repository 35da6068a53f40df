"""Spans, responses, contract, checks, scoring sources and the whole path."""

import json

from pyspark.sql import functions as F

from docrecon.operators import scoring, spans
from docrecon.operators.checks import apply_payee_types, check_identities, distrust
from docrecon.operators.contract import nest, validate_contract
from docrecon.operators.ledger import new_ledger
from docrecon.operators.ordered import consecutive_runs, running_count, running_last
from docrecon.plans.reconcile import reconcile
from docrecon.profile import EVIDENCE_ROLES, Profile
from docrecon.sources import readers, writers

from fixtures import A, bill, bills_df, cell, pages_df
from docrecon.schema import MODEL_CANDIDATE

P = Profile()


def test_blocks_equal_plain_windows(spark):
    """A hot chunk over many blocks gives what one plain window gives."""
    df = spark.range(3000).select(
        F.when(F.col("id") < 2500, F.lit("hot")).otherwise(F.lit("cold")).alias("k"),
        F.col("id").alias("pos"), F.when(F.col("id") % 37 == 5, F.col("id")).alias("v"),
    )
    block = F.floor(F.col("pos") / 64)
    for strict in (False, True):
        got = running_last(df, ["k"], ["pos"], F.col("v"), "x", strict=strict, block=block)
        upto = f"rows between unbounded preceding and {'1 preceding' if strict else 'current row'}"
        want = df.select("*", F.expr(f"last_value(v) ignore nulls over (partition by k order by pos {upto})").alias("x"))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    n = running_count(df, ["k"], ["pos"], "n", block=block)
    want = df.select("*", (F.expr("row_number() over (partition by k order by pos)") - 1).cast("long").alias("n"))
    assert n.exceptAll(want).isEmpty()
    some = df.where("v is null").select("k", "pos")
    runs = consecutive_runs(some, ["k"], "pos").groupBy("k", "run_start").count()
    assert {r["count"] for r in runs.where("k = 'hot'").collect()} <= {5, 36, 37, 20, 15, 14, 24, 18}


def test_spans(spark):
    pages = pages_df(spark, [("c", i, "") for i in range(6)] + [("d", 0, "")])
    bills = bills_df(spark, [bill("c", 0, 1, originalTotal=1), bill("c", 1, 3, originalTotal=2)])
    own = new_ledger(bills).spans
    extra = spans.attach_orphans(pages, own, bills)
    owned = spans.widen(own, extra)
    got = {(r.chunk_id, r.cand_pos): r.pages for r in spans.page_span(owned).collect()}
    assert got == {("c", 0): [0, 1, 2], ("c", 1): [3, 4, 5]}
    assert spans.span_invariants(owned, bills, pages.where("chunk_id = 'c'")).isEmpty()
    assert spans.widen(owned, extra).count() == owned.count()
    broken = spans.span_invariants(own, bills, pages.where("chunk_id = 'c'")).collect()
    assert [(r.rule, r.n) for r in broken] == [("page not owned", 4)]


def test_checks(spark):
    rows = [
        bill("c", 0, 0, originalTotal=107, amountBeforeVat=100, vat=7, withholdingTax=3),
        bill("c", 1, 1, originalTotal=30, amountBeforeVat=30, vat=0), bill("c", 2, 2, originalTotal=30),
        bill("c", 3, 3, originalTotal=117, amountBeforeVat=100, vat=7),
        bill("c", 4, 4, originalTotal=109, amountBeforeVat=100, vat=9),
        bill("c", 5, 5, amountBeforeVat=24826.80, withholdingTax=726.80, sellerTaxId=A, payeeType="individual"),
    ]
    checked = check_identities(bills_df(spark, rows), P)
    got = {r.cand_pos: (r.findings, r.originalTotal.confidence, r.vat.confidence)
           for r in distrust(checked).collect()}
    assert [got[i][0] for i in range(6)] == [[], [], [], ["VAT_SUM"], ["VAT_RATE"], ["WHT_RATE"]]
    assert got[3][1] == 0.3 and got[4][2] == 0.3 and got[0][1] == 0.8 and got[2][2] == 0.0
    fixed, report = apply_payee_types(bills_df(spark, rows), P)
    assert [(r.cand_pos, r.was, r.now) for r in report.collect()] == [(5, "individual", "company")]
    assert {r.cand_pos: r.payeeType.value for r in fixed.collect()}[5] == "company"


def model_candidate(**values):
    return tuple(
        [] if f.name == "lineItems" else cell(f.name, values.get(f.name)) for f in MODEL_CANDIDATE.fields
    )


def documents(folder):
    """Responses by chunk, from the files in order of name."""
    text, out = "".join(f.read_text(encoding="utf-8") for f in sorted(folder.glob("part-*"))), {}
    while text := text.strip():
        doc, end = json.JSONDecoder().raw_decode(text)
        assert set(doc) == {"chunk_id", "response"} and doc["chunk_id"] not in out
        out[doc["chunk_id"]] = doc["response"]
        text = text[end:]
    return out


def test_one_response_at_every_size(spark, tmp_path):
    """One bill that owns nearly all pages, and bills on either side of position 500, in a document each."""
    from docrecon.operators.contract import ledger_errors

    hot = [bill("hot", 0, 0, originalTotal=5), bill("hot", 1, 19_999, originalTotal=6)]
    many = [bill('m"any', i, i, originalTotal=i) for i in range(700)]
    ledger = new_ledger(bills_df(spark, hot + many))
    more = spark.range(20_000).selectExpr("'hot' AS chunk_id", "cast(0 as bigint) AS cand_pos", "cast(id as int) AS page_index")
    tag = lambda role, n, rank: more.where(f"page_index % {n} = 0").selectExpr(
        "chunk_id", "cand_pos", f"'{role}' AS role", "page_index", f"{rank} AS rank")
    # Headings of a page keep their order; a role found twice counts once.
    tags = tag("receipt", 2, 1).unionByName(tag("cash_bill", 10, 3)).unionByName(tag("receipt", 4, 2)).unionByName(
        tag("transfer_slip", 5, 0))
    tolls = spark.createDataFrame([("hot", 0, i, f"r{i}", i + 0.5, None) for i in range(1200)], ledger.tickets.schema)
    ledger = ledger.but(spans=ledger.spans.unionByName(more.where("page_index < 19999")), evidence=tags, tickets=tolls)
    chunks = spark.createDataFrame([("hot",), ('m"any',), ("none",)], "chunk_id string")
    lines = writers.ledger_responses(ledger, chunks)
    assert "collect_" not in lines._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    writers.write_response(lines, str(tmp_path / "out"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    docs = documents(tmp_path / "out")
    assert docs["none"] == {"billCandidates": []}
    assert [b["originalTotal"]["value"] for b in docs['m"any']["billCandidates"]] == list(range(700))
    first, second = docs["hot"]["billCandidates"]
    assert [r["chunkPageIndex"] for r in first["regions"]] == list(range(19_999))
    assert [e["role"] for e in first["evidence"]] == ["transfer_slip"] * 4000 + (["receipt", "cash_bill"] + ["receipt"] * 4) * 2000
    assert [i["amount"]["value"] for i in first["lineItems"]] == [i + 0.5 for i in range(1200)]
    assert len(second["regions"]) == 1 and second["evidence"] == [] and second["lineItems"] == []
    got = {(r.chunk_id, r.cand_pos): r for r in ledger_errors(ledger, EVIDENCE_ROLES).collect()}
    assert (got["hot", 0].pages, got["hot", 0].tags, got["hot", 0].items, got["hot", 0].ok) == (19_999, 16_000, 1200, True)
    wrong = ledger.but(evidence=tags.selectExpr("chunk_id", "cand_pos", "'else' AS role", "page_index", "rank"), spans=more.limit(1))
    got = {(r.chunk_id, r.cand_pos): r.error for r in ledger_errors(wrong, EVIDENCE_ROLES).collect()}
    assert got["hot", 0] == "evidence/role" and got["hot", 1] == "regions"


def test_whole_path_and_sinks(spark, tmp_path):
    filler = "a page long enough to have said something, with words that differ from line to line here. "
    texts = {
        0: "ใบเสร็จรับเงิน page 1 of 2", 1: "page 2 of 2", 2: "signed sheet",
        3: "หนังสือรับรองการหักภาษี ผู้ถูกหักภาษี " + A + " 1,000.00 30.00",
        4: "เลขที่รายการ: AB12345678 สแกนตรวจสอบสลิป จำนวน: 1,070.00 บาท",
    }
    pages = pages_df(spark, [("up", i, filler + t) for i, t in texts.items()] + [("up", 5, "blank")])
    cands = [
        ("up", 0, 0) + model_candidate(sellerTaxId=A, originalDocumentNumber="R1", sellerName="นาย ก"),
        ("up", 1, 0) + model_candidate(originalTotal=1070, amountBeforeVat=1000, vat=70, clearingAmount=1070),
        ("up", 4, 0) + model_candidate(originalTotal=1070),
        ("up", 5, 0) + model_candidate(originalTotal=9),
    ]
    from pyspark.sql import types as T
    schema = T.StructType(
        [T.StructField("chunk_id", T.StringType()), T.StructField("page_index", T.IntegerType()),
         T.StructField("page_pos", T.IntegerType()), *MODEL_CANDIDATE.fields])
    # The first page states a total only through its second page, so give it one.
    cands[0] = ("up", 0, 0) + model_candidate(
        sellerTaxId=A, originalDocumentNumber="R1", sellerName="นาย ก", clearingAmount=1070)
    ledger = reconcile(pages, spark.createDataFrame(cands, schema), P)
    rows = ledger.bills.collect()
    assert len(rows) == 1
    row = rows[0]
    assert row.originalTotal.value == 1070 and row.withholdingTax.value == 30
    assert row.payeeType.value == "individual" and row.candidateIndex == 0
    nested = nest(ledger)
    assert nested.count() == 1
    checked = validate_contract(nested, EVIDENCE_ROLES).collect()[0]
    assert checked.ok and [r.chunkPageIndex for r in checked.regions] == [0, 1, 2, 3, 4, 5]
    assert {e.role for e in checked.evidence} == {"receipt", "transfer_slip"}
    chunks = spark.createDataFrame([("up",), ("none",)], "chunk_id string")
    responses = writers.ledger_responses(ledger, chunks)
    writers.write_response(responses, str(tmp_path / "out"))
    docs = documents(tmp_path / "out")
    assert docs["none"] == {"billCandidates": []}
    assert docs["up"]["billCandidates"][0]["sellerTaxId"]["value"] == A
    audit = ledger.audit.collect()
    refused = [r for r in audit if r.step == "reading"]
    assert [(r.page_index, r.attached, json.loads(r.detail)["page_pos"]) for r in refused] == [(5, False, 0)]
    reasons = {(r.step, r.reason) for r in audit}
    assert ("slip", "folded") in reasons and ("certificate", "certificate attached") in reasons


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("line\nline", encoding="utf-8")
    got = readers.read_transcripts(spark, str(tmp_path / "t")).collect()
    assert [(r.label, r.text) for r in got] == [("one", "line\nline")]
    (tmp_path / "c.json").write_text(json.dumps(
        {"_note": "x", "1": " be kind ", "2": {"group": "g", "name": "n", "rule": "", "sumTollTickets": True}}))
    cats = {r.code: r for r in readers.load_categories(spark, str(tmp_path / "c.json")).collect()}
    assert set(cats) == {"1", "2"} and cats["1"].rule == " be kind " and cats["2"].sumTollTickets
    (tmp_path / "g.json").write_text(json.dumps({"cases": [
        {"caseId": "k1", "language": "th", "fields": {"vat": "7.00", "currency": "TODO", "discount": None}},
        {"caseId": "k2", "fields": {"vat": "TODO"}}]}))
    gold = readers.read_golden(spark, str(tmp_path / "g.json"))
    assert gold.count() == 4
    todo = {r.case_id: (r.filled, r.todo) for r in scoring.todo_report(gold).collect()}
    assert todo == {"k1": (2, 1), "k2": (0, 1), None: (2, 2)}
    ready = scoring.scorable(gold)
    assert {r.case_id for r in ready.collect()} == {"k1"}
    pred = spark.createDataFrame(
        [("k1", 1, "vat", "7.00", 0.9), ("k2", 1, "vat", "1", 0.9)],
        "case_id string, n_candidates int, field string, value string, confidence double")
    scored = {r.field: (r.predicted, r.correct) for r in scoring.join_predictions(ready, pred).collect()}
    assert scored == {"vat": (True, True), "discount": (False, False)}
    writers.write_scoring_inputs(ready, pred, str(tmp_path / "score"))
    written = spark.read.json(str(tmp_path / "score" / "golden.scorable")).collect()
    assert [r.caseId for r in written] == ["k1"]
    run = {"machine": {"gpu": "g", "host": "h"}, "when": "2026", "settings": {"a": 1}, "pages": [
        {"file": "f", "page": 1, "rasterise_s": 0.1, "stage1_s": 2.0, "stage2_s": 3.0, "stage1_failed": False},
        {"file": "f", "page": 2, "rasterise_s": 0.1, "stage1_s": 4.0, "stage2_s": None, "stage1_failed": True}]}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps(run))
    run["machine"]["host"], run["settings"] = "i", {"a": 2}
    run["pages"][0]["stage2_s"] = 8.0
    (tmp_path / "s" / "b.json").write_text(json.dumps(run))
    runs = readers.read_speed_runs(spark, str(tmp_path / "s"))
    assert readers.settings_differ(runs).collect()[0].differ
    table = {r.run: r for r in scoring.speed_comparison(runs, "run").collect()}
    assert table["g (i)"].times_faster == 1.0 and table["g (h)"].failed == 1
