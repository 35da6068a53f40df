"""Bank transfer slips: fold a slip into a bill only when each is the other's single match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.functions.fields import val
from docrecon.operators.ledger import BILL_KEY, Ledger, audit_rows
from docrecon.operators.rounds import settle
from docrecon.profile import Profile


def _bucket(v, tol: float):
    return F.floor(v / (2 * tol)).cast("long")


def match_amounts(slips: DataFrame, bills: DataFrame, tol: float) -> DataFrame:
    """Range join with uniqueness on both sides.

    ``slips``: (chunk_id, slip_id, amount); ``bills``: (chunk_id, bill_id, paid, gross).
    Adds to every slip ``hits`` (bills stating the amount), ``bill_id`` (when that is one),
    ``rivals`` (slips whose one bill that is) and ``matched``.

    No slip meets a bill directly: equal amounts are counted first, so what is joined is distinct
    amounts within the tolerance, however often each is repeated.
    """
    near = F.abs(F.col("paid") - F.col("gross")) <= 2 * tol * 1.1
    # Two values too far apart to meet the same slip count separately, else they stay together.
    options = (
        F.when(F.col("paid").isNull(), F.array(F.struct(F.col("gross").alias("v1"),
                                                        F.lit(None).cast("double").alias("v2"))))
        .when(F.col("gross").isNull(), F.array(F.struct(F.col("paid").alias("v1"),
                                                        F.lit(None).cast("double").alias("v2"))))
        .when(near, F.array(F.struct(F.col("paid").alias("v1"), F.col("gross").alias("v2"))))
        .otherwise(F.array(
            F.struct(F.col("paid").alias("v1"), F.lit(None).cast("double").alias("v2")),
            F.struct(F.col("gross").alias("v1"), F.lit(None).cast("double").alias("v2")),
        ))
    )
    stated = (
        bills.select("chunk_id", "bill_id", F.explode(options).alias("o"))
        .select("chunk_id", "bill_id", "o.v1", "o.v2")
        .where(F.col("v1").isNotNull())
        .groupBy("chunk_id", "v1", "v2")
        .agg(F.count(F.lit(1)).alias("n_bills"), F.min("bill_id").alias("bill_id"))
        .withColumn("bucket", _bucket(F.col("v1"), tol))
    )
    asked = (
        slips.where(F.col("amount").isNotNull())
        .groupBy("chunk_id", "amount").agg(F.count(F.lit(1)).alias("n_slips"))
    )
    around = F.sequence(_bucket(F.col("amount"), tol) - 2, _bucket(F.col("amount"), tol) + 2)
    found = (
        asked.withColumn("bucket", F.explode(around))
        .join(stated, ["chunk_id", "bucket"])
        .where(
            (F.abs(F.col("v1") - F.col("amount")) <= tol)
            | F.coalesce(F.abs(F.col("v2") - F.col("amount")) <= tol, F.lit(False))
        )
        .groupBy("chunk_id", "amount")
        .agg(F.sum("n_bills").alias("hits"), F.min("bill_id").alias("bill_id"),
             F.first("n_slips").alias("n_slips"))
    )
    claims = found.where("hits = 1").groupBy("chunk_id", "bill_id").agg(
        F.sum("n_slips").alias("rivals")
    )
    outcome = (
        found.withColumn("bill_id", F.when(F.col("hits") == 1, F.col("bill_id")))
        .join(claims, ["chunk_id", "bill_id"], "left")
        .select("chunk_id", "amount", "hits", "bill_id", "rivals")
    )
    return slips.join(outcome, ["chunk_id", "amount"], "left").select(
        *slips.columns,
        F.coalesce("hits", F.lit(0)).alias("hits"), "bill_id", "rivals",
        F.coalesce(F.col("rivals") == 1, F.lit(False)).alias("matched"),
    )


def slip_reason(amount, hits, rivals):
    """Code of why a slip stands by itself, else null; the number of rivals goes to the detail."""
    return (
        F.when(amount.isNull(), F.lit("amount-unread"))
        .when(hits == 0, F.lit("no-bill"))
        .when(hits > 1, F.lit("many-bills"))
        .when(rivals > 1, F.lit("many-slips"))
    )


def match_slips(ledger: Ledger, facts: DataFrame, p: Profile) -> Ledger:
    """Fold matched slips; the others keep their rows and are tagged either way.

    A refused slip's reason is a code; its detail has how many bills and slips compete.  The rival
    slips are the audit rows of the same bill.
    """
    slips = facts.where("is_slip").select(
        "chunk_id", F.col("page_index").alias("slip_id"), F.col("slip_amount").alias("amount"),
        "slip_reference",
    )
    on_slip = slips.select("chunk_id", F.col("slip_id").alias("chunkPageIndex"))
    bills = ledger.bills.join(on_slip, ["chunk_id", "chunkPageIndex"], "left_anti").select(
        "chunk_id", F.col("cand_pos").alias("bill_id"),
        val("clearingAmount").alias("paid"), val("originalTotal").alias("gross"),
    )
    judged = settle(match_amounts(slips, bills, p.limits.slip_money))
    folded = judged.where("matched").select(
        "chunk_id", F.col("bill_id").alias("cand_pos"), F.col("slip_id").alias("page_index")
    )
    gone = folded.select("chunk_id", F.col("page_index").alias("chunkPageIndex"))
    kept = ledger.bills.join(gone, ["chunk_id", "chunkPageIndex"], "left_anti")
    standing = kept.join(on_slip, ["chunk_id", "chunkPageIndex"], "left_semi").select(
        *BILL_KEY, F.col("chunkPageIndex").alias("page_index")
    )
    tags = folded.select(*BILL_KEY, "page_index").unionByName(standing).withColumns(
        {"role": F.lit("transfer_slip"), "rank": F.lit(0)}
    )
    audit = judged.select(
        "chunk_id", F.col("slip_id").alias("page_index"), F.col("bill_id").alias("cand_pos"),
        F.col("matched").alias("attached"),
        F.coalesce(
            slip_reason(F.col("amount"), F.col("hits"), F.col("rivals")), F.lit("folded")
        ).alias("reason"),
        F.to_json(F.struct("amount", "slip_reference", "hits", "rivals")).alias("detail"),
    )
    return ledger.but(
        bills=kept,
        spans=ledger.spans.unionByName(folded.select(*ledger.spans.columns)),
        evidence=ledger.evidence.unionByName(tags.select(*ledger.evidence.columns)),
    ).log(audit_rows(audit, "slip"))
