"""The whole main path on receipts written out of the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrecon.catalog.registry import query, table
from docrecon.catalog.shapes import event_pages
from docrecon.functions.fields import typed_cell, val
from docrecon.operators.contract import ledger_errors
from docrecon.operators.rounds import settle
from docrecon.plans.reconcile import reconcile
from docrecon.profile import OwnParty, Profile
from docrecon.schema import CELL_FIELDS, LINE_ITEM
from docrecon.sources.writers import ledger_responses

OWN = OwnParty(
    name="Example Holdings", address="1 Sample Street", tax_id="0200000000013", branch="Main",
    name_markers=("example holdings",), address_markers=("Sample Street",),
    evidence=("example holdings",),
)
PROFILE = Profile(own=OWN)
LONG_ENOUGH = "printed below is everything this page says about the purchase, line by line as it stands. "


def receipts(spark, d):
    """Pages and candidates per user, one event a page.

    Purchases are receipts, clicks bank slips, errors identity cards, views ticket pages and sign-ups
    withholding certificates.
    """
    # Numbered once: pages, candidates and requests all read it.
    e = settle(event_pages(spark, d, "event_type", "value")).withColumn(
        "chunk_id", F.col("chunk_id").cast("string")
    )
    kind, v = F.col("event_type"), F.col("value")
    amount = F.floor(v) + F.lit(10.0)
    day = F.date_format("ts", "dd/MM/yyyy")
    tax = F.round(amount * 0.03, 2)
    body = (
        F.when(kind == "purchase", F.format_string(
            "ใบเสร็จรับเงิน Example Holdings เลขที่ R%d id 0100000000018 total %.2f",
            F.col("event_id"), amount))
        .when(kind == "click", F.format_string(
            "เลขที่รายการ: AB%08d สแกนตรวจสอบสลิป จำนวน: %.2f บาท ค่าธรรมเนียม: 0.00",
            F.col("event_id"), amount))
        .when(kind == "error", F.lit("Thai National ID Card Date of Issue 3 1000 00000 03 9"))
        .when(kind == "view", F.format_string(
            "EXAT Receipt Running No : %d Date Time %s Baht(Vat Included) %.2f",
            F.lit(500000) + F.floor(v), day, amount))
        .otherwise(F.format_string(
            "หนังสือรับรองการหักภาษี ผู้ถูกหักภาษี 0100000000018 %.2f %.2f", amount, tax))
    )
    pages = e.select(
        "chunk_id", "page_index", F.concat(F.lit(LONG_ENOUGH), body).alias("transcript")
    )
    paid = kind.isin("purchase", "click", "view", "signup")
    given = {
        "originalTotal": F.when(paid, amount),
        "amountBeforeVat": F.when(kind == "purchase", amount),
        "vat": F.when(kind == "purchase", F.when(v > 20, F.lit(0.0)).otherwise(F.round(amount * 0.07, 2))),
        "originalDocumentNumber": F.when(kind == "purchase", F.format_string("R%d", F.col("event_id"))),
        "sellerName": F.when(kind == "purchase", F.lit("alpha trading co.,ltd")),
        "documentDate": F.date_format("ts", "yyyy-MM-dd"),
        "payeeType": F.when(kind == "purchase", F.lit("individual")),
        "currency": F.lit("THB"),
    }
    none = F.slice(
        F.array(F.struct(*[F.lit(None).alias(f.name) for f in LINE_ITEM.fields]).cast(LINE_ITEM)), 1, 0
    )
    candidates = e.select(
        "chunk_id", "page_index", F.lit(0).alias("page_pos"),
        *[typed_cell(f, given.get(f), 0.8 if f in given else 0.0).alias(f) for f in CELL_FIELDS],
        none.alias("lineItems"),
    )
    categories = table(spark, d, "region").select(
        F.col("r_regionkey").cast("string").alias("code"), F.lit(None).cast("string").alias("rule"),
        (F.col("r_name") == "ASIA").alias("sumTollTickets"),
    )
    requests = pages.select("chunk_id").distinct().withColumn("category", F.lit("2 - travel"))
    return pages, candidates, categories, requests


def _ledger(spark, d):
    pages, candidates, categories, requests = receipts(spark, d)
    return pages, reconcile(pages, candidates, PROFILE, categories, requests)


@query("reconcile_bills")
def reconcile_bills(spark, d):
    """Reconciled bills with their page counts and contract check."""
    _, ledger = _ledger(spark, d)
    roles = (*PROFILE.declared_roles, "withholding_certificate")
    return ledger_errors(ledger, roles).select(
        "chunk_id", "cand_pos", "candidateIndex", "chunkPageIndex",
        val("originalTotal").alias("total"), val("withholdingTax").alias("withholding"),
        val("sellerTaxId").alias("seller_id"), val("payeeType").alias("payee"),
        "pages", "tags", "items", "ok", "error",
    )


@query("reconcile_audit")
def reconcile_audit(spark, d):
    """Decisions of every step, counted."""
    _, ledger = _ledger(spark, d)
    return ledger.audit.groupBy("step", "attached", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("reconcile_responses")
def reconcile_responses(spark, d):
    """The contract JSON per chunk, line by line."""
    pages, ledger = _ledger(spark, d)
    return ledger_responses(ledger, pages)
