"""Identity cards: hand each card page to the bill that starts last before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.functions import ids
from docrecon.functions.fields import typed_cell, val
from docrecon.functions.names import names_agree, norm_name
from docrecon.operators.assemble import is_phantom
from docrecon.operators.ledger import BILL_KEY, Ledger, audit_rows
from docrecon.operators.ordered import running_last
from docrecon.operators.rounds import settle
from docrecon.profile import Profile

CAP = 0.3


def asof_owner(cards: DataFrame, bills: DataFrame) -> DataFrame:
    """Backward, strict as-of join: add ``cand_pos`` of the bill with the greatest earlier page.

    ``cards``: (chunk_id, page_index), unique, never on a bill's page.  Several bills on one page:
    the first.  One running value over bill and card pages together replaces the join.
    """
    starts = bills.groupBy("chunk_id", F.col("chunkPageIndex").alias("page_index")).agg(
        F.min("cand_pos").alias("starts")
    ).where(F.col("page_index").isNotNull())
    marks = starts.withColumn("is_card", F.lit(False)).unionByName(
        cards.select(
            "chunk_id", "page_index", F.lit(None).cast("long").alias("starts"),
            F.lit(True).alias("is_card"),
        )
    )
    filled = running_last(marks, ["chunk_id"], ["page_index"], F.col("starts"), "cand_pos")
    return filled.where("is_card").select("chunk_id", "page_index", "cand_pos")


def attach_cards(ledger: Ledger, facts: DataFrame, p: Profile) -> Ledger:
    """Give card pages to their bills, drop phantom rows, fill or distrust the payee's id.

    Cards of one bill act in page order: the first usable number fills an id that is not valid yet;
    a name conflict caps confidence, also of an id an earlier card filled.
    """
    cards = facts.where("is_card").select("chunk_id", "page_index", "card_id", "card_name")
    on_card = cards.select(
        "chunk_id", F.col("page_index").alias("chunkPageIndex"), F.lit(True).alias("on_card")
    )
    flagged = ledger.bills.join(on_card, ["chunk_id", "chunkPageIndex"], "left")
    kept = flagged.where(F.col("on_card").isNull() | ~is_phantom())
    bills = kept.where(F.col("on_card").isNull())
    kept = kept.select(*ledger.bills.columns)

    owned = cards.join(
        asof_owner(cards.select("chunk_id", "page_index"), bills), ["chunk_id", "page_index"], "left"
    )
    who = bills.select(
        *BILL_KEY,
        norm_name(val("sellerName"), p.branch_suffix).alias("seller"),
        ids.check_digit_valid(ids.digits_only(val("sellerTaxId")), p.id_scheme).alias("has_id"),
    )
    judged = settle(
        owned.join(who, BILL_KEY, "left").withColumn(
            "same", names_agree(norm_name(F.col("card_name"), p.branch_suffix), F.col("seller"), p)
        )
    )
    conflict = F.coalesce(~F.col("same"), F.lit(False))
    fills = ~conflict & F.col("card_id").isNotNull() & ~F.col("has_id")
    attached = judged.where(F.col("cand_pos").isNotNull())
    per_bill = attached.groupBy(*BILL_KEY).agg(
        F.min_by(
            F.struct("card_id", F.coalesce("same", F.lit(False)).alias("agreed")),
            F.when(fills, F.col("page_index")),
        ).alias("fill"),
        F.min(F.when(fills, F.col("page_index"))).alias("fill_page"),
        F.max(F.when(conflict, F.col("page_index"))).alias("conflict_page"),
    )
    joined = kept.join(per_bill, BILL_KEY, "left")
    had_conflict = F.col("conflict_page").isNotNull()

    def capped(name):
        return F.when(
            had_conflict,
            typed_cell(name, val(name), F.least(F.col(name)["confidence"], F.lit(CAP))),
        ).otherwise(F.col(name))

    given = F.when(F.col("fill")["agreed"], F.lit(0.9)).otherwise(F.lit(0.45))
    given = F.when(F.col("conflict_page") > F.col("fill_page"), F.least(given, F.lit(CAP))).otherwise(
        given
    )
    cells = {
        "sellerName": capped("sellerName"),
        "sellerTaxId": F.when(
            F.col("fill_page").isNotNull(),
            typed_cell("sellerTaxId", F.col("fill")["card_id"], given),
        ).otherwise(capped("sellerTaxId")),
    }
    out = joined.select(
        *[cells[c].alias(c) if c in cells else F.col(c) for c in ledger.bills.columns]
    )
    audit = judged.join(per_bill.select(*BILL_KEY, "fill_page"), BILL_KEY, "left").select(
        "chunk_id", "page_index", "cand_pos",
        F.col("cand_pos").isNotNull().alias("attached"),
        F.when(F.col("cand_pos").isNull(), F.lit("no bill before the card"))
        .when(conflict, F.lit("names differ, nothing filled"))
        .when(F.col("page_index") == F.col("fill_page"), F.lit("id filled from the card"))
        .otherwise(F.lit("page attached")).alias("reason"),
    )
    pages = attached.select(*BILL_KEY, "page_index")
    return ledger.but(
        bills=out,
        spans=ledger.spans.unionByName(pages.select(*ledger.spans.columns)),
        evidence=ledger.evidence.unionByName(
            pages.withColumns({"role": F.lit("id_document"), "rank": F.lit(0)}).select(*ledger.evidence.columns)
        ),
    ).log(audit_rows(audit, "card"))
