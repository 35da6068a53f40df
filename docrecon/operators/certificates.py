"""Withholding certificates: find the one bill each belongs to and carry the tax across.

A certificate fits a bill when at least two of tax id, base amount, date and seller name agree and
none conflicts.  Comparing every certificate of a chunk with every bill would be quadratic, so the
three exact signals become equality keys: per signal a pair either states the same value or one
side is silent.  Both sides emit one key per combination, and bills that look the same under a key
are folded to one row before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.functions import ids, text
from docrecon.functions.fields import typed_cell, val
from docrecon.functions.names import names_agree, norm_name
from docrecon.operators.assemble import renumber
from docrecon.operators.ledger import BILL_KEY, Ledger, audit_rows
from docrecon.operators.rounds import settle
from docrecon.profile import Profile

ALWAYS = -1  # known before the first page


def read_certificates(facts: DataFrame, bills: DataFrame, p: Profile) -> DataFrame:
    """One row per certificate page: what the page states, date and seller from its first bill row."""
    pages = facts.where("is_certificate").select(
        "chunk_id", "page_index", ids.only_one(F.col("ids")).alias("tax_id"),
        F.col("cert")["base"].alias("base"), F.col("cert")["tax"].alias("tax"),
        F.col("cert")["rate"].alias("rate"),
    )
    first = candidate_on_page(bills, pages.select("chunk_id", "page_index"))
    seller = F.col("on_page")["seller"]
    named = F.when(~text.contains_any(seller, p.certificate_form_labels), seller)
    return pages.join(first, ["chunk_id", "page_index"], "left").select(
        "chunk_id", "page_index", "tax_id", "base", "tax", "rate",
        text.blank_to_null(F.col("on_page")["day"]).alias("day"),
        norm_name(named, p.branch_suffix).alias("name"),
    )


def candidate_on_page(bills: DataFrame, pages: DataFrame) -> DataFrame:
    """First candidate, in ledger order, whose own page is the given page."""
    rows = bills.select(
        "chunk_id", F.col("chunkPageIndex").alias("page_index"), "cand_pos",
        val("documentDate").alias("day"), val("sellerName").alias("seller"),
    ).join(pages, ["chunk_id", "page_index"], "left_semi")
    return rows.groupBy("chunk_id", "page_index").agg(
        F.min_by(F.struct("cand_pos", "day", "seller"), "cand_pos").alias("on_page")
    )


def tax_ids_for(bills: DataFrame, spans: DataFrame, facts: DataFrame, p: Profile) -> DataFrame:
    """(chunk_id, cand_pos, tax_id): the bill's own valid id and every valid id on its pages."""
    field = val("sellerTaxId")
    ok = ids.check_digit_valid(field, p.id_scheme)
    if p.own.tax_id:
        ok = ok & (field != p.own.tax_id)
    stated = bills.where(ok).select(*BILL_KEY, field.alias("tax_id"))
    printed = facts.where(F.size("ids") > 0).select(
        "chunk_id", "page_index", F.explode("ids").alias("tax_id")
    )
    on_pages = (
        spans.join(bills.select(*BILL_KEY), BILL_KEY, "left_semi")
        .join(printed, ["chunk_id", "page_index"])
        .select(*BILL_KEY, "tax_id")
    )
    return stated.unionByName(on_pages).distinct()


def _key(base, tax_id, day):
    return F.concat_ws("|", base, tax_id, day)


def _bucket(v):
    return F.floor(v * 100).cast("long")


ASK = ["chunk_id", "base", "tax_id", "day", "name"]


def bill_side(bills: DataFrame, p: Profile) -> DataFrame:
    """What certificates are compared with: keys, base, day, normal name, and who the purchase is."""
    base, day = val("amountBeforeVat"), val("documentDate")
    return bills.select(
        *BILL_KEY,
        base.alias("base"),
        text.blank_to_null(day).alias("day"),
        norm_name(val("sellerName"), p.branch_suffix).alias("name"),
        F.struct(val("sellerTaxId").alias("i"), base.alias("b"), day.alias("d")).alias("who"),
    )


def find_targets(certs: DataFrame, bills: DataFrame, bill_ids: DataFrame, p: Profile) -> DataFrame:
    """(chunk_id, page_index, cand_pos) for every certificate with exactly one fitting purchase.

    ``bill_ids``: (chunk_id, cand_pos, tax_id, since); an id counts for certificates on pages after
    ``since``.
    """
    return targets_among(certs, bill_side(bills, p), bill_ids, p)


def targets_among(certs: DataFrame, side: DataFrame, bill_ids: DataFrame, p: Profile) -> DataFrame:
    """``find_targets`` on ``bill_side``.

    Certificates that state the same are one question, and bills that look the same under a key one
    answer, so a join meets distinct questions and answers however often either is repeated.  Only
    answers that hold for some pages and not for others meet single certificates.
    """
    known = bill_ids.groupBy(*BILL_KEY).agg(F.min("since").alias("first_since"))
    side = side.join(known, BILL_KEY, "left")
    # Id part of the key: c = the certificate is silent, b = the bill is silent, else the id.
    with_id = side.join(bill_ids, BILL_KEY).select(
        *side.columns, F.concat(F.lit("="), "tax_id").alias("k_id"), F.col("since").alias("after"),
        F.lit(None).cast("int").alias("upto"), F.lit(1).alias("eq_id"),
    )
    silent_cert = side.select(
        *side.columns, F.lit("c").alias("k_id"), F.lit(ALWAYS).alias("after"),
        F.lit(None).cast("int").alias("upto"), F.lit(0).alias("eq_id"),
    )
    silent_bill = side.where(F.col("first_since").isNull() | (F.col("first_since") > ALWAYS)).select(
        *side.columns, F.lit("b").alias("k_id"), F.lit(ALWAYS).alias("after"),
        F.col("first_since").alias("upto"), F.lit(0).alias("eq_id"),
    )
    emitted = with_id.unionByName(silent_cert).unionByName(silent_bill)
    k_base = F.when(F.col("base").isNull(), F.lit("b")).otherwise(
        F.concat(F.lit("="), _bucket(F.col("base")).cast("string"))
    )
    days = F.when(
        F.col("day").isNull(),
        F.array(F.struct(F.lit("c").alias("k"), F.lit(0).alias("eq")),
                F.struct(F.lit("b").alias("k"), F.lit(0).alias("eq"))),
    ).otherwise(
        F.array(F.struct(F.lit("c").alias("k"), F.lit(0).alias("eq")),
                F.struct(F.concat(F.lit("="), "day").alias("k"), F.lit(1).alias("eq")))
    )
    eq_base = F.col("base").isNotNull().cast("int")
    c_base = F.concat(
        F.array(F.lit("b")),
        F.transform(
            F.sequence(_bucket(F.col("base")) - 1, _bucket(F.col("base")) + 1),
            lambda b: F.concat(F.lit("="), b.cast("string")),
        ),
    )
    c_id = F.when(F.col("tax_id").isNull(), F.array(F.lit("c"))).otherwise(
        F.array(F.lit("b"), F.concat(F.lit("="), "tax_id"))
    )
    c_day = F.when(F.col("day").isNull(), F.array(F.lit("c"))).otherwise(
        F.array(F.lit("b"), F.concat(F.lit("="), "day"))
    )
    # A question's text names it, nulls included.
    named = certs.where(F.col("base").isNotNull()).withColumn(
        "ask", F.to_json(F.struct("base", "tax_id", "day", "name"), {"ignoreNullFields": "false"}))
    asks = (
        named.select("ask", *ASK).distinct()
        .select("chunk_id", "ask", F.col("base").alias("c_base"), F.col("name").alias("c_name"), F.explode(c_base).alias("kb"),
                "base", "tax_id", "day")
        .select("chunk_id", "ask", "c_base", "c_name", "kb", "day", F.explode(c_id).alias("ki"))
        .select("chunk_id", "ask", "c_base", "c_name", "kb", "ki", F.explode(c_day).alias("kd"))
        .select("chunk_id", "ask", "c_base", "c_name", _key(F.col("kb"), F.col("ki"), F.col("kd")).alias("key"))
    )
    looks = (
        emitted.withColumn("d", F.explode(days))
        .select(
            "chunk_id", "cand_pos", "who", "name", "base", "after", "upto",
            _key(k_base, F.col("k_id"), F.col("d.k")).alias("key"),
            (eq_base + F.col("eq_id") + F.col("d.eq")).alias("exact"),
        )
        .where("exact > 0")
        .join(asks.select("chunk_id", "key").distinct(), ["chunk_id", "key"], "left_semi")
        .groupBy("chunk_id", "key", "exact", "name", "base", "after", "upto")
        .agg(
            F.min("cand_pos").alias("cand_pos"),
            F.min("who").alias("who_min"),
            F.max("who").alias("who_max"),
        )
    )
    near = asks.join(looks, ["chunk_id", "key"]).where(
        F.col("base").isNull() | (F.abs(F.col("base") - F.col("c_base")) < p.limits.certificate_money)
    ).withColumn("same", names_agree(F.col("c_name"), F.col("name"), p))
    hits = near.where(
        F.coalesce(F.col("same"), F.lit(True))
        & (F.col("exact") + F.coalesce(F.col("same").cast("int"), F.lit(0)) >= 2)
    ).groupBy("chunk_id", "ask", "after", "upto").agg(
        F.min("cand_pos").alias("cand_pos"), F.min("who_min").alias("a"), F.max("who_max").alias("z"))
    pages = named.select("chunk_id", "ask", "page_index")
    return (
        pages.join(hits, ["chunk_id", "ask"]).where(
            (F.col("page_index") > F.col("after")) & (F.col("upto").isNull() | (F.col("page_index") <= F.col("upto"))))
        .groupBy("chunk_id", "page_index")
        .agg(F.min("cand_pos").alias("cand_pos"), F.min("a").alias("a"), F.max("z").alias("z"))
        .where(F.col("a").eqNullSafe(F.col("z")))
        .select("chunk_id", "page_index", "cand_pos")
    )


def touched_by(certs: DataFrame, changed: DataFrame, side: DataFrame) -> DataFrame:
    """Certificates that a change of ids may concern: they state an id, stand after the page that
    brought it, and their base fits a bill concerned.

    ``changed``: (chunk_id, cand_pos, since).  Of the bills with one base the earliest change counts,
    so a certificate meets four rows at most.
    """
    bucket = F.coalesce(_bucket(F.col("base")).cast("string"), F.lit("b"))
    since = side.select(*BILL_KEY, bucket.alias("k")).join(changed.select(*BILL_KEY, "since"), BILL_KEY).groupBy(
        "chunk_id", "k").agg(F.min("since").alias("since"))
    here = _bucket(F.col("base"))
    asked = certs.where(F.col("base").isNotNull() & F.col("tax_id").isNotNull()).select(
        "chunk_id", "page_index",
        F.explode(F.array(F.lit("b"), *[(here + k).cast("string") for k in (-1, 0, 1)])).alias("k"))
    hit = asked.join(since, ["chunk_id", "k"]).where(F.col("page_index") > F.col("since"))
    return certs.join(hit.select("chunk_id", "page_index").distinct(), ["chunk_id", "page_index"], "left_semi")


def link_certificates(ledger: Ledger, facts: DataFrame, p: Profile) -> tuple[DataFrame, DataFrame]:
    """(certificates, targets).

    A page that is attached joins its bill's pages, so its ids count for that bill when *later*
    certificates are judged.  All certificates are judged once.  After that only those are judged
    again that an id gained or lost in the round before may concern, until none is left; each round
    settles at least the first of these pages, so rounds end.
    """
    certs = settle(read_certificates(facts, ledger.bills, p))
    cert_pages = certs.select("chunk_id", F.col("page_index").alias("chunkPageIndex"))
    bills = ledger.bills.join(cert_pages, ["chunk_id", "chunkPageIndex"], "left_anti")
    side = settle(bill_side(bills, p))
    own = settle(tax_ids_for(bills, ledger.spans, facts, p))
    base_ids = own.withColumn("since", F.lit(ALWAYS))
    targets = settle(targets_among(certs, side, base_ids, p))

    printed = settle(facts.where(F.col("is_certificate") & (F.size("ids") > 0)).select(
        "chunk_id", "page_index", F.explode("ids").alias("tax_id")
    ))
    gains = [*BILL_KEY, "tax_id", "since"]

    def gained(found: DataFrame) -> DataFrame:
        new = found.join(printed, ["chunk_id", "page_index"]).join(
            own, [*BILL_KEY, "tax_id"], "left_anti"
        )
        return settle(new.groupBy(*BILL_KEY, "tax_id").agg(F.min("page_index").alias("since")))

    before, now = None, gained(targets)
    while True:
        changed = now if before is None else now.join(before, gains, "left_anti").unionByName(
            before.join(now, gains, "left_anti"))
        touched = settle(touched_by(certs, changed, side))
        if touched.isEmpty():
            return certs, targets
        again = targets_among(touched, side, base_ids.unionByName(now), p)
        rest = targets.join(touched.select("chunk_id", "page_index"), ["chunk_id", "page_index"], "left_anti")
        targets = settle(rest.unionByName(again))
        before, now = now, gained(targets)


def apply_certificates(ledger: Ledger, facts: DataFrame, p: Profile) -> Ledger:
    """Carry tax and rate to the bill, give it the page, drop the certificate's own rows."""
    certs, targets = link_certificates(ledger, facts, p)
    attached = targets.join(certs, ["chunk_id", "page_index"]).select(
        *BILL_KEY, "page_index", "tax", "rate"
    )
    firsts = attached.groupBy(*BILL_KEY).agg(
        F.min_by(F.struct("tax", "rate"), "page_index").alias("cert")
    )
    gone = attached.select("chunk_id", F.col("page_index").alias("chunkPageIndex"))
    kept = ledger.bills.join(gone, ["chunk_id", "chunkPageIndex"], "left_anti")
    joined = kept.join(firsts, BILL_KEY, "left")
    blank = F.coalesce(val("withholdingTax"), F.lit(0.0)) == 0
    takes = F.col("cert").isNotNull() & blank
    cells = {
        "withholdingTax": F.when(
            takes, typed_cell("withholdingTax", F.col("cert")["tax"], 0.95)
        ).otherwise(F.col("withholdingTax")),
        "withholdingTaxRate": F.when(
            takes, typed_cell("withholdingTaxRate", F.col("cert")["rate"], 0.95)
        ).otherwise(F.col("withholdingTaxRate")),
    }
    bills = joined.select(
        *[cells[c].alias(c) if c in cells else F.col(c) for c in ledger.bills.columns]
    )
    audit = certs.join(targets, ["chunk_id", "page_index"], "left").select(
        "chunk_id", "page_index", "cand_pos",
        F.col("cand_pos").isNotNull().alias("attached"),
        F.when(F.col("cand_pos").isNotNull(), F.lit("certificate attached"))
        .when(F.col("base").isNull(), F.lit("no single base amount"))
        .otherwise(F.lit("no single purchase fits")).alias("reason"),
        F.to_json(F.struct("tax_id", "base", "tax", "rate")).alias("detail"),
    )
    return ledger.but(
        bills=renumber(bills),
        spans=ledger.spans.unionByName(attached.select(*ledger.spans.columns)),
    ).log(audit_rows(audit, "certificate"))
