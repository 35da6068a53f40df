"""Certificates, cards, slips and tickets on hand-made chunks; one chunk per case."""

import json
from dataclasses import replace

from docrecon.operators.cards import attach_cards
from docrecon.operators.certificates import apply_certificates, link_certificates
from docrecon.operators.ledger import new_ledger
from docrecon.operators.pages import page_facts
from docrecon.operators.slips import match_slips
from docrecon.operators.tickets import parse_tickets, sum_tickets
from docrecon.profile import OwnParty, Profile

from fixtures import A, B, P as PERSON, Q, bill, bills_df, pages_df

PROFILE = Profile(own=OwnParty(tax_id="0200000000013"))
CERT = "หนังสือรับรองการหักภาษี ณ ที่จ่าย ผู้ถูกหักภาษี "
CARD = "Thai National ID Card Date of Issue "
SLIP = "เลขที่รายการ: AB12345678 สแกนตรวจสอบสลิป จำนวน: {:.2f} บาท ค่าธรรมเนียม: 0.00 "


def build(spark, rows, pages):
    return new_ledger(bills_df(spark, rows)), page_facts(pages_df(spark, pages), PROFILE)


def by_key(df):
    return {(r.chunk_id, r.cand_pos): r for r in df.collect()}


def test_certificates(spark):
    d = "2026-03-01"
    rows = [
        # id and base agree -> attached
        bill("both", 0, 0, sellerTaxId=A, amountBeforeVat=2000), bill("both", 1, 1, originalTotal=1),
        # base differs -> stands
        bill("base", 0, 0, sellerTaxId=A, amountBeforeVat=2500), bill("base", 1, 1, originalTotal=1),
        # two purchases fit -> stands
        bill("two", 0, 0, sellerTaxId=A, amountBeforeVat=2000, documentDate=d),
        bill("two", 1, 1, sellerTaxId=A, amountBeforeVat=2000, documentDate="2026-03-02"),
        # copies of one purchase -> first
        bill("copy", 0, 0, sellerTaxId=A, amountBeforeVat=2000, documentDate=d),
        bill("copy", 1, 1, sellerTaxId=A, amountBeforeVat=2000, documentDate=d),
        # id only printed on the bill's page; own tax is kept
        bill("page", 0, 0, amountBeforeVat=2000, withholdingTax=11, withholdingTaxRate=5),
        # date and similar name agree, base silent, no id on the certificate
        bill("name", 0, 0, sellerName="northern lights trading co", documentDate=d),
        bill("name", 1, 1, sellerName="northern lights tradinq co", documentDate=d),
        # one signal only
        bill("one", 0, 0, documentDate=d), bill("one", 1, 1, documentDate=d),
    ]
    pages = [
        ("both", 0, "x"), ("both", 1, CERT + f"{A} 2,000.00 60.00"), ("both", 2, "y"),
        ("base", 0, "x"), ("base", 1, CERT + f"{A} 2,000.00 60.00"),
        ("two", 0, "x"), ("two", 1, "x"), ("two", 2, CERT + f"{A} 2,000.00 60.00"),
        ("copy", 0, "x"), ("copy", 1, "x"), ("copy", 2, CERT + f"{A} 2,000.00 60.00"),
        ("page", 0, f"id {A} here"), ("page", 1, CERT + f"{A} 2,000.00 60.00"),
        ("name", 0, "x"), ("name", 1, CERT + "2,000.00 60.00"),
        ("one", 0, "x"), ("one", 1, CERT + "2,000.00 60.00"),
    ]
    ledger, facts = build(spark, rows, pages)
    out = apply_certificates(ledger, facts, PROFILE)
    bills = by_key(out.bills)
    assert bills[("both", 0)].withholdingTax.value == 60.0
    assert bills[("both", 0)].withholdingTaxRate.value == 3.0
    assert ("both", 1) not in bills and ("base", 1) in bills
    assert bills[("base", 0)].withholdingTax.value is None
    assert bills[("two", 0)].withholdingTax.value is None
    assert bills[("copy", 0)].withholdingTax.value == 60.0
    assert bills[("copy", 1)].withholdingTax.value is None
    assert bills[("page", 0)].withholdingTax.value == 11.0
    assert ("name", 1) not in bills and ("one", 1) in bills
    spans = {tuple(r) for r in out.spans.collect()}
    assert ("both", 0, 1) in spans and ("page", 0, 1) in spans
    attached = {(r.chunk_id, r.page_index): r.attached for r in out.audit.collect()}
    assert attached[("both", 1)] and not attached[("two", 2)]


def test_earlier_certificate_page_brings_its_id(spark):
    d = "2026-03-01"
    rows = [
        bill("s", 0, 0, amountBeforeVat=2000, documentDate=d),
        bill("s", 1, 1, documentDate=d, originalTotal=1), bill("s", 2, 2, documentDate=d, originalTotal=1),
        bill("s", 3, 3, documentDate=d, originalTotal=1),
    ]
    pages = [
        ("s", 0, "x"), ("s", 1, CERT + f"{A} 2,000.00 60.00"), ("s", 2, CERT + f"{B} 2,000.00 60.00"),
        ("s", 3, CERT + f"{A} 2,000.00 60.00"),
    ]
    ledger, facts = build(spark, rows, pages)
    _, targets = link_certificates(ledger, facts, PROFILE)
    # Page 1 gives the bill id A; page 2 states another id and is now refused; page 3 still fits.
    assert sorted(r.page_index for r in targets.collect()) == [1, 3]


def test_cards(spark):
    name = "ชื่อ-นามสกุล: somchai trading person\n"
    rows = [
        bill("agree", 0, 0, sellerName="somchai trading person", originalTotal=5),
        bill("agree", 1, 1, payeeType="individual"),
        bill("open", 0, 0, originalTotal=5),
        bill("clash", 0, 0, sellerName="zzz qqq xxx www", sellerTaxId=B, originalTotal=5),
        bill("first", 0, 1, originalTotal=5),
        bill("pair", 0, 0, originalTotal=5), bill("pair", 1, 2, originalTotal=6),
        bill("valid", 0, 0, sellerTaxId=A, originalTotal=5),
        bill("bad", 0, 0, sellerTaxId="0100000000019", originalTotal=5),
    ]
    spaced = "3 1000 00000 03 9"
    pages = [
        ("agree", 0, "x"), ("agree", 1, CARD + name + spaced),
        ("open", 0, "x"), ("open", 1, CARD + spaced),
        ("clash", 0, "x"), ("clash", 1, CARD + name + spaced),
        ("first", 0, CARD + spaced), ("first", 1, "x"),
        ("pair", 0, "x"), ("pair", 1, CARD + spaced), ("pair", 2, "x"), ("pair", 3, CARD + Q),
        ("valid", 0, "x"), ("valid", 1, CARD + spaced),
        ("bad", 0, "x"), ("bad", 1, CARD + spaced),
    ]
    ledger, facts = build(spark, rows, pages)
    out = attach_cards(ledger, facts, PROFILE)
    b = by_key(out.bills)
    assert tuple(b[("agree", 0)].sellerTaxId) == (PERSON, 0.9) and ("agree", 1) not in b
    assert tuple(b[("open", 0)].sellerTaxId) == (PERSON, 0.45)
    assert tuple(b[("clash", 0)].sellerTaxId) == (B, 0.3)
    assert b[("clash", 0)].sellerName.confidence == 0.3
    assert b[("first", 0)].sellerTaxId.value is None
    assert b[("pair", 0)].sellerTaxId.value == PERSON and b[("pair", 1)].sellerTaxId.value == Q
    assert b[("valid", 0)].sellerTaxId.value == A and b[("bad", 0)].sellerTaxId.value == PERSON
    tags = {(r.chunk_id, r.cand_pos, r.page_index) for r in out.evidence.collect()}
    assert ("pair", 1, 3) in tags and not any(t[0] == "first" for t in tags)


def test_slips(spark):
    rows = [
        bill("one", 0, 0, originalTotal=90), bill("one", 1, 1, originalTotal=90),
        bill("none", 0, 0, originalTotal=91), bill("none", 1, 1, originalTotal=90),
        bill("bills", 0, 0, originalTotal=90), bill("bills", 1, 1, originalTotal=90.04),
        bill("slips", 0, 0, originalTotal=30),
        bill("net", 0, 0, originalTotal=100, clearingAmount=97), bill("net", 1, 1, originalTotal=97),
        bill("both", 0, 0, originalTotal=50, clearingAmount=50),
    ]
    pages = [
        ("one", 0, "x"), ("one", 1, SLIP.format(90)),
        ("none", 0, "x"), ("none", 1, SLIP.format(90)),
        ("bills", 0, "x"), ("bills", 1, "x"), ("bills", 2, SLIP.format(90)),
        ("slips", 0, "x"), ("slips", 1, SLIP.format(30)), ("slips", 2, SLIP.format(30)),
        ("net", 0, "x"), ("net", 1, SLIP.format(97)),
        ("both", 0, "x"), ("both", 1, SLIP.format(50)),
    ]
    ledger, facts = build(spark, rows, pages)
    out = match_slips(ledger, facts, PROFILE)
    b = by_key(out.bills)
    why = {(r.chunk_id, r.page_index): (r.attached, r.reason) for r in out.audit.collect()}
    assert why[("one", 1)][0] and ("one", 1) not in b
    assert why[("none", 1)] == (False, "no-bill") and ("none", 1) in b
    assert why[("bills", 2)] == (False, "many-bills")
    assert why[("slips", 1)] == (False, "many-slips")
    assert why[("net", 1)][0] and why[("both", 1)][0]
    tags = {(r.chunk_id, r.cand_pos, r.page_index) for r in out.evidence.collect()}
    assert ("one", 0, 1) in tags and ("none", 1, 1) in tags


FLAT = "EXAT Receipt Running No : {ref} Date Time 03/04/2026 Baht(Vat Included) {amt}\n"
TABLE = "<td>No.</td><td>{ref}</td><td>Date Time</td><td>02/04/2026</td><td>Baht(Non Vat)</td><td>{amt} บาท</td>"


def test_tickets(spark):
    text = (
        FLAT.format(ref="111111", amt="25.00") + FLAT.format(ref="111111", amt="25.00")
        + TABLE.format(ref="222222", amt="20.00") + "Receipt Running No 333333 nothing"
    )
    df = pages_df(spark, [("c", 0, text)])
    got = {r.ref: r for r in parse_tickets(df, "transcript", PROFILE).collect()}
    assert sorted(got) == ["111111", "222222"]
    assert got["222222"].amount == 20.0 and got["222222"].ticket_date == "2026-04-02"
    assert got["111111"].vat_included and not got["222222"].vat_included


def test_ticket_sum(spark):
    rows = [
        bill("run", 0, 0, originalTotal=25, vat=1, originalDocumentNumber="9"),
        bill("run", 1, 1, originalTotal=60), bill("run", 2, 2, originalTotal=7),
        bill("gap", 0, 0, originalTotal=25), bill("gap", 1, 2, originalTotal=25),
        bill("off", 0, 0, originalTotal=25), bill("off", 1, 1, originalTotal=25),
    ]
    one, two = FLAT.format(ref="111111", amt="100.00"), FLAT.format(ref="222222", amt="60.00")
    pages = [
        ("run", 0, one + one), ("run", 1, two), ("run", 2, "x"),
        ("gap", 0, one), ("gap", 1, "x"), ("gap", 2, two),
        ("off", 0, one), ("off", 1, two),
    ]
    ledger, facts = build(spark, rows, pages)
    flagged = spark.createDataFrame([("run",), ("gap",)], "chunk_id string")
    out = sum_tickets(ledger, facts, flagged, PROFILE)
    b = by_key(out.bills)
    row = b[("run", 0)]
    assert row.originalTotal.value == 160.0 and row.clearingAmount.value == 160.0
    assert row.vat.value is None and row.originalDocumentNumber.value is None
    assert row.documentDate.value == "2026-04-03" and ("run", 1) not in b
    assert b[("run", 2)].originalTotal.value == 7.0
    assert b[("gap", 0)].originalTotal.value == 100.0 and b[("gap", 1)].originalTotal.value == 60.0
    assert b[("off", 0)].originalTotal.value == 25.0
    items = sorted((r.chunk_id, r.cand_pos, r.item_no, r.ref) for r in out.tickets.collect())
    assert [i for i in items if i[0] == "run"] == [("run", 0, 0, "111111"), ("run", 0, 1, "222222")]
    detail = {r.chunk_id: json.loads(r.detail) for r in out.audit.where("chunk_id = 'run'").collect()}
    assert detail["run"]["copies_dropped"] == 1 and detail["run"]["replaced"] == 2


def test_profile_is_an_argument():
    assert replace(PROFILE, vat_rate=0.2).vat_rate == 0.2


# --- certificates against a page-by-page rule ---------------------------------------------------

def one_by_one(certs, bills, own, printed):
    """Targets of one chunk's certificates, judged in page order with the ids gained so far."""
    ids, out = {b["pos"]: set(own[b["pos"]]) for b in bills}, {}
    for c in sorted(certs, key=lambda c: c["page"]):
        fits = []
        for b in bills:
            signals = [
                None if b["base"] is None else abs(b["base"] - c["base"]) < PROFILE.limits.certificate_money,
                None if c["id"] is None or not ids[b["pos"]] else c["id"] in ids[b["pos"]],
                None if c["day"] is None or b["day"] is None else c["day"] == b["day"],
                None if c["name"] is None or b["name"] is None else c["name"] == b["name"],
            ]
            if False not in signals and signals.count(True) >= 2 and True in signals[:3]:
                fits.append(b)
        if fits and len({(b["field_id"], b["base"], b["day"]) for b in fits}) == 1:
            out[c["page"]] = min(b["pos"] for b in fits)
            ids[out[c["page"]]] |= printed.get(c["page"], set())
    return out


def test_rounds_equal_judging_page_by_page(spark, monkeypatch):
    import random

    from docrecon.operators import certificates

    rng = random.Random(9)
    names, days = ["alpha trading house", "zzz qqq wwww", None], ["2026-03-01", "2026-03-02", None]
    rows, facts, certs_rows, want = [], [], [], {}
    for n in range(40):
        chunk = f"k{n}"
        bills = [{"pos": i, "base": rng.choice([100.0, 200.0, None]), "day": rng.choice(days), "name": rng.choice(names),
                  "field_id": None} for i in range(rng.randint(1, 4))]
        certs = [{"page": 10 + i, "base": rng.choice([100.0, 200.0]), "id": rng.choice([A, B, None]), "day": rng.choice(days),
                  "name": rng.choice(names)} for i in range(rng.randint(1, 7))]
        own = {b["pos"]: {rng.choice([A, B])} if rng.random() < 0.3 else set() for b in bills}
        printed = {c["page"]: {x for x in (c["id"], rng.choice([A, B, None])) if x} for c in certs}
        for b in bills:
            rows.append(bill(chunk, b["pos"], b["pos"], amountBeforeVat=b["base"], documentDate=b["day"], sellerName=b["name"]))
            facts.append((chunk, b["pos"], False, sorted(own[b["pos"]])))
        for c in certs:
            facts.append((chunk, c["page"], True, sorted(printed[c["page"]])))
            certs_rows.append((chunk, c["page"], c["id"], c["base"], 1.0, 1.0, c["day"], c["name"] and c["name"].replace(" ", "")))
        want |= {(chunk, page): pos for page, pos in one_by_one(certs, bills, own, printed).items()}
    table = spark.createDataFrame(certs_rows, "chunk_id string, page_index int, tax_id string, base double, tax double, rate double, day string, name string")
    monkeypatch.setattr(certificates, "read_certificates", lambda *_: table)
    ledger = new_ledger(bills_df(spark, rows))
    known = spark.createDataFrame(facts, "chunk_id string, page_index int, is_certificate boolean, ids array<string>")
    _, targets = link_certificates(ledger, known, PROFILE)
    assert {(r.chunk_id, r.page_index): r.cand_pos for r in targets.collect()} == want


def test_copies_under_one_key_stay_linear(spark):
    """50,000 certificates and 50,000 bills that all state the same: one question, one answer."""
    from docrecon.operators.certificates import targets_among

    n = 50_000
    certs = spark.range(n).selectExpr(
        "'hot' AS chunk_id", f"cast(id + {n} as int) AS page_index", f"'{A}' AS tax_id", "100.0D AS base", "'2026-03-01' AS day", "'alpha' AS name")
    side = spark.range(n).selectExpr(
        "'hot' AS chunk_id", "id AS cand_pos", "100.0D AS base", "'2026-03-01' AS day", "'alpha' AS name",
        f"named_struct('i', '{A}', 'b', 100.0D, 'd', '2026-03-01') AS who")
    ids = side.selectExpr("chunk_id", "cand_pos", f"'{A}' AS tax_id", "-1 AS since")
    got = targets_among(certs, side, ids, PROFILE)
    assert got.groupBy("cand_pos").count().collect() == [(0, n)]
