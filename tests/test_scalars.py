from pyspark.sql import functions as F

from docrecon.functions import fields, ids, money, names, text
from docrecon.operators.readings import best_reading, with_verdict
from docrecon.profile import LUHN_16, Profile

from fixtures import A, B, P as PERSON

P = Profile()


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).collect()[0]


def lit(s):
    return F.lit(s).cast("string") if s is None else F.lit(s)


def test_check_digits_and_ids(spark):
    r = one(
        spark,
        good=ids.check_digit_valid(lit(A), P.id_scheme),
        bad=ids.check_digit_valid(lit(A[:-1] + "9"), P.id_scheme),
        short=ids.check_digit_valid(lit(A[1:]), P.id_scheme),
        words=ids.check_digit_valid(lit("abcdefghijklm"), P.id_scheme),
        missing=ids.check_digit_valid(lit(None), P.id_scheme),
        luhn=ids.check_digit_valid(lit("4111111111111111"), LUHN_16),
        bounded=ids.extract_ids(lit(f"x {A} _{B} {B}5 {B}"), 13),
        spaced=ids.extract_spaced_ids(lit("no 3 1000 00000 03 9 end"), 13),
        crossing=ids.extract_spaced_ids(lit("3 1000 00\n000 03 9"), 13),
        two=ids.single_valid_id(ids.extract_ids(lit(f"{A} {B}")), P.id_scheme),
        ours=ids.single_valid_id(ids.extract_ids(lit(f"{A} {B}")), P.id_scheme, A),
        clean=ids.clean_tax_id(lit("0-1000-00000-01-8"), 13),
    )
    assert (r.good, r.bad, r.short, r.words, r.missing, r.luhn) == (True, False, False, False, False, True)
    assert r.bounded == [A, B] and r.spaced == [PERSON] and r.crossing == []
    assert r.two is None and r.ours == B and r.clean == A


def test_base_and_tax(spark):
    def read(s):
        return money.base_and_tax(money.extract_amounts(lit(s), P.amount), P.legal_rate_percents)

    r = one(spark, a=read("2,000.00 30.00"), b=read("100.00 7.00"), c=read("2,000.00 30.00 1,000.00"),
            d=read(None), e=read("30.00 2,000.00 60.00"))
    assert tuple(r.a) == (2000.0, 30.0, 1.5, 1) and r.b is None and r.d is None
    assert r.c is None                      # 1,000.00 with 30.00 is a second base
    assert tuple(r.e) == (2000.0, 30.0, 1.5, 2)  # the first tax in printed order


def test_verdicts_and_readings(spark):
    loop = "the same footer line again\n" * 60
    tags = "<td>unit price here</td>" * 80
    varied = "\n".join(f"line {i} tells something else {i * 7919 % 1000}" for i in range(60))
    rows = [("short", "x" * 79), ("burst", "@" * 11 + "y" * 90), ("ten", "@" * 10 + "y" * 90),
            ("loop", loop), ("tags", tags), ("varied", varied), ("null", None)]
    got = {r.k: r.verdict for r in with_verdict(
        spark.createDataFrame(rows, "k string, t string"), "t", P).collect()}
    assert got["short"] == "empty" and got["null"] == "empty" and got["burst"] == "at_burst"
    assert got["ten"] is None and got["varied"] is None
    assert got["loop"].startswith("loop(unique=0.02") and got["tags"].startswith("loop(")
    tries = spark.createDataFrame(
        [("a", 1, "ok", None), ("a", 2, "other", None), ("b", 1, "l", "loop(x)"), ("b", 2, "l", "loop(x)"),
         ("b", 3, "fine", None), ("c", 1, "l", "loop(x)"), ("c", 2, "m", "loop(y)"),
         ("d", 1, "", "empty"), ("d", 2, "fine", None)],
        "k string, attempt int, text string, verdict string",
    )
    best = {r.k: (r.attempt, r.verdict) for r in best_reading(tries, ["k"]).collect()}
    assert best == {"a": (1, None), "b": (3, None), "c": (1, "loop(x)"), "d": (1, "empty")}


def test_text(spark):
    r = one(
        spark,
        m1=text.page_marker(lit("Page 1 of 2"), P.page_marker),
        m2=text.page_marker(lit("2/2 pieces"), P.page_marker),
        m3=text.page_marker(lit("page 5/2, page 2 / 3"), P.page_marker),
        rows=text.collapse_empty_rows(lit(
            "<table><tr><td>-</td><td>&nbsp;</td></tr><tr><td>a</td><td>-</td></tr></table>"
            "<table><tbody><tr><td> </td></tr></tbody></table>")),
        both=text.roles_for_page(lit("ใบกำกับภาษี / ใบเสร็จรับเงิน CASH SALE"), P),
        cited=text.roles_for_page(lit("เลขที่ใบกำกับภาษี 55"), P),
        cash=text.roles_for_page(lit("CASH SALE"), P),
        num1=text.clean_document_number(lit("BOOK NO."), lit("x"), P),
        num2=text.clean_document_number(lit("10230"), lit("Bangkok 10230"), P),
        num3=text.clean_document_number(lit("009"), lit("เล่มที่ BOOK NO. 08 เลขที่ BILL NO. 009"), P),
        num4=text.clean_document_number(lit("08"), lit("เล่มที่ BOOK NO. 08 เลขที่ BILL NO. 009"), P),
        num5=text.clean_document_number(lit("77"), lit("nothing"), P),
        num6=text.clean_document_number(lit("A.1"), lit("A.1 then No. A.1"), P),
        key=F.concat_ws("|", text.category_key(lit("5-122-100 oil 95")), text.category_key(lit(" other "))),
        pay=text.clean_payment_method(lit("CARD XXXX12"), r"[0-9Xx*•]{4,}"),
    )
    assert tuple(r.m1) == (1, 2) and r.m2 is None and tuple(r.m3) == (2, 3)
    assert r.rows == "<table><tr><td>a</td><td>-</td></tr></table>"
    assert r.both == ["receipt", "tax_invoice"] and r.cited == [] and r.cash == ["cash_bill"]
    assert (r.num1, r.num2, r.num3, r.num4, r.num5, r.num6) == (None, None, "009", None, "77", "A.1")
    assert r.key == "5122100|other" and r.pay is None


def test_names_and_payee(spark):
    n = lambda s: names.norm_name(lit(s), P.branch_suffix)
    r = one(
        spark,
        norm=n("Alpha  Co (สำนักงานใหญ่) สาขาที่ 12 "),
        same=names.names_agree(n("international trading"), n("international tradinq"), P),
        prefix=names.names_agree(n("alphacompany"), n("alphacompany ltd thailand"), P),
        other=names.names_agree(n("alpha"), n("zzzzzz"), P),
        open=names.names_agree(n("abcdefghij"), n("abcdefgxyz"), P),
        none=names.names_agree(n(None), n("x"), P),
        person=names.payee_from_name(lit("นาย ก จำกัด"), P),
        firm=names.payee_from_name(lit("ร้าน ข จำกัด"), P),
        state=names.payee_from_name(lit("กรมทางหลวง"), P),
        shop=names.payee_from_name(lit("ร้านค้าสวัสดิการกรมทางหลวง"), P),
        firm_id=names.payee_from_id(lit(A), P),
        person_id=names.payee_from_id(lit(PERSON), P),
        buddhist=fields.buddhist_to_iso(lit("13/07/2569")),
        short=fields.buddhist_to_iso(lit("1/2/69")),
        impossible=fields.buddhist_to_iso(lit("31/02/2569")),
    )
    assert r.norm == "alphaco" and r.same is True and r.prefix is True
    assert r.other is False and r.open is None and r.none is None
    assert (r.person, r.firm, r.state, r.shop) == ("individual", "company", "company", None)
    assert (r.firm_id, r.person_id) == ("company", "individual")
    assert (r.buddhist, r.short, r.impossible) == ("2026-07-13", "2026-02-01", None)


def test_matching(spark):
    m = fields.match_field
    r = one(
        spark,
        nulls=m("vat", lit(None), lit(None)), half=m("vat", lit(None), lit("1")),
        num=m("vat", lit("1750"), lit("1750.00")), txt=m("currency", lit(" thb"), lit("THB")),
        words=m("vat", lit("n/a"), lit("N/A ")),
    )
    assert tuple(r) == (True, False, True, True, True)


def test_many_amounts_equal_all_pairs_and_stay_fast(spark):
    import random
    import time

    from pyspark.sql import functions as F

    rng = random.Random(6)
    rates = P.legal_rate_percents

    def pairs(amounts):
        fits = {b: [t for t in amounts if t < b and any(abs(t / b * 100 - r) < 0.01 for r in rates)] for b in amounts}
        fits = {b: t for b, t in fits.items() if t}
        return [(b, t[0], len(t)) for b, t in fits.items()] if len(fits) == 1 else []

    rows = []
    for k in range(150):
        base = float(rng.randint(100, 5000))
        amounts = [base, base * rng.choice([1.0, 2.0, 3.0, 5.0]) / 100, base * rng.choice([1.01, 2.99, 3.01]) / 100]
        amounts += [base * 3 / 100 + 0.01] if k % 3 == 0 else []
        # Neighbours of one size fit nothing, but every page has more than a few of them.
        amounts += [round(7000 + 40 * rng.random(), 2) for _ in range(rng.choice([3, 25, 60]))]
        rng.shuffle(amounts)
        rows.append((k, list(dict.fromkeys(amounts))))
    df = spark.createDataFrame(rows, "k int, a array<double>")
    got = {r.k: r.x for r in df.select("k", money.base_and_tax(F.col("a"), rates).alias("x")).collect()}
    seen = 0
    for k, amounts in rows:
        want = pairs(amounts)
        assert [(x.base, x.tax, x.fits) for x in [got[k]] if x] == want, amounts
        seen += bool(want)
    assert 30 < seen < 150
    page = spark.createDataFrame([([1000.0 + k / 7 for k in range(5000)] + [100.0],)], "a array<double>")
    start = time.time()
    assert page.select(money.base_and_tax(F.col("a"), [10.0]).alias("x")).first().x is None
    assert time.time() - start < 30


def test_page_tests_read_the_text_once(spark):
    page = spark.createDataFrame(
        [("09 94000 1654\n21",), ("x0994000165421",), ("099400016542 2",), ("EXAT",), (None,)], "t string")
    tolls = page.select(text.is_toll_page(F.col("t"), P).alias("toll"))
    assert [r.toll for r in tolls.collect()] == [True, True, False, True, False]
    shown = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" not in shown(tolls)
    assert shown(page.select(text.roles_for_page(F.col("t"), P).alias("roles"))).count("regexp_replace") == 1
