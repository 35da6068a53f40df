"""The main path: pages and model candidates in, reconciled bills and an audit out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.functions.text import category_key, collapse_empty_rows
from docrecon.operators import spans as sp
from docrecon.operators.assemble import assemble, renumber
from docrecon.operators.cards import attach_cards
from docrecon.operators.categories import category_effect
from docrecon.operators.certificates import apply_certificates
from docrecon.operators.checks import apply_payee_types, check_identities, distrust
from docrecon.operators.ledger import Ledger, audit_rows
from docrecon.operators.merge import merge_spanning
from docrecon.operators.pages import page_facts
from docrecon.operators.readings import with_verdict
from docrecon.operators.rounds import settle
from docrecon.operators.slips import match_slips
from docrecon.operators.tickets import sum_tickets
from docrecon.profile import Profile


def judge_pages(pages: DataFrame, p: Profile) -> DataFrame:
    """Pages with a verdict and usable pages cleaned of blank rows."""
    judged = with_verdict(pages, "transcript", p)
    clean = F.when(F.col("verdict").isNull(), collapse_empty_rows(F.col("transcript")))
    return judged.withColumn("transcript", F.coalesce(clean, F.col("transcript"), F.lit("")))


def reconcile(
    pages: DataFrame,
    candidates: DataFrame,
    p: Profile,
    categories: DataFrame | None = None,
    requests: DataFrame | None = None,
    *,
    reference_gaps: bool = False,
) -> Ledger:
    """Run every step in the order the results depend on.

    ``pages``: (chunk_id, page_index, transcript), every page; ``candidates``: (chunk_id,
    page_index, page_pos, cells, lineItems); ``categories``: code, rule, sumTollTickets;
    ``requests``: (chunk_id, category).  Candidates of an unusable page are dropped, each with
    an audit row; its text is still read.  ``reference_gaps`` keeps the index gaps that dropped rows
    leave behind.
    """
    # Page text is judged and matched once; later steps work on these small rows.
    facts = settle(page_facts(judge_pages(pages, p), p))
    page = ["chunk_id", "page_index"]
    usable = facts.where(F.col("verdict").isNull()).select(*page)
    texts = pages.select(*page, collapse_empty_rows(F.col("transcript")).alias("transcript"))
    read = candidates.join(usable, page, "left_semi").join(texts, page)
    bills = settle(assemble(read, p, number_on_page=False))

    # A step reads the bills several times, so what a step rewrote is settled before the next one.
    ledger = _settled(merge_spanning(bills, facts.select("chunk_id", "page_index", "marker"), p))
    unusable = facts.where(F.col("verdict").isNotNull()).select(*page, "verdict")
    refused = candidates.where(F.col("page_pos").isNotNull()).select(*page, "page_pos").join(unusable, page)
    ledger = ledger.log(
        audit_rows(
            refused, "reading", attached=F.lit(False), reason=F.lit("page not usable"),
            detail=F.to_json(F.struct("page_pos", "verdict")),
        )
    )
    ledger = _settled(apply_certificates(ledger, facts, p))
    ledger = _settled(attach_cards(ledger, facts, p))
    ledger = match_slips(ledger, facts, p)
    if categories is not None and requests is not None:
        ledger = _settled(sum_tickets(ledger, facts, flagged_chunks(requests, categories), p))

    owned = settle(sp.live(ledger.spans, ledger.bills))
    owned = sp.widen(owned, sp.attach_orphans(facts, owned, ledger.bills))
    evidence = sp.tag_document_roles(
        sp.live(ledger.evidence, ledger.bills), owned, sp.page_roles(facts, p)
    )
    ledger = ledger.but(spans=owned, evidence=evidence)

    typed, report = apply_payee_types(ledger.bills, p)
    ledger = ledger.but(bills=typed).log(
        audit_rows(
            report, "payee", attached=F.lit(True), reason=F.lit("payee type decided"),
            detail=F.to_json(F.struct("was", "now")),
        )
    )
    checked = check_identities(ledger.bills, p)
    doubts = checked.where(F.size("findings") > 0).select(
        "chunk_id", "cand_pos", F.col("chunkPageIndex").alias("page_index"),
        F.explode("findings").alias("code"),
    )
    ledger = ledger.but(bills=distrust(checked).drop("findings")).log(
        audit_rows(doubts, "arithmetic", attached=F.lit(False), reason=F.col("code"))
    )
    return ledger if reference_gaps else ledger.but(bills=renumber(ledger.bills))


def _settled(ledger: Ledger) -> Ledger:
    return ledger.but(bills=settle(ledger.bills))


def flagged_chunks(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """Chunks whose category sums toll tickets."""
    fx = category_effect(requests.withColumn("key", category_key(F.col("category"))), categories)
    return fx.where("sums_tickets").select("chunk_id")
