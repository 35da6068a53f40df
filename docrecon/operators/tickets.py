"""Toll tickets: read them off pages and sum each run of pages into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.fields import typed_cell
from docrecon.functions.money import to_number
from docrecon.functions.text import blank_to_null
from docrecon.operators.ledger import BILL_KEY, Ledger, audit_rows
from docrecon.operators.ordered import block_of, consecutive_runs, running_count
from docrecon.operators.rounds import settle
from docrecon.profile import Profile

DECIDED = 0.9
# Cells a summed row cannot state honestly.
BLANKED = ["amountBeforeVat", "vat", "vatRate", "originalDocumentNumber", "documentBookNumber"]


def _either(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{x})" for x in patterns)


def _first_of(piece: Column, patterns, group: int, groups: int) -> Column:
    """Group ``group`` of whichever alternative matches first in the text."""
    hits = [
        blank_to_null(F.regexp_extract(piece, _either(patterns), i * groups + group))
        for i in range(len(patterns))
    ]
    return F.coalesce(*hits)


def ticket_rows(pages: DataFrame, text: str, p: Profile) -> DataFrame:
    """One row per printed reference that has an amount, copies included.

    The text is cut before every reference, so a piece holds exactly what is printed after one
    reference and before the next.  Adds ``pos, ref, amount, vat_included, ticket_date``.
    """
    keys = [c for c in pages.columns if c != text]
    refs = _either(p.ticket_refs)
    pieces = pages.select(
        *keys, F.posexplode(F.split(F.col(text), f"(?={refs})")).alias("pos", "piece")
    ).where(F.col("piece").rlike(f"^(?:{refs})"))
    piece = F.col("piece")
    day, month, year = [_first_of(piece, p.ticket_dates, i, 3) for i in (1, 2, 3)]
    return pieces.select(
        *keys, "pos",
        _first_of(piece, p.ticket_refs, 1, 1).alias("ref"),
        to_number(_first_of(piece, p.ticket_amounts, 2, 2)).alias("amount"),
        (F.lower(_first_of(piece, p.ticket_amounts, 1, 2)) == p.vat_included).alias("vat_included"),
        F.when(year.isNotNull(), F.concat_ws("-", year, month, day)).alias("ticket_date"),
    ).where(F.col("amount").isNotNull())


def parse_tickets(pages: DataFrame, text: str, p: Profile) -> DataFrame:
    """Distinct tickets per page; of several copies the first with an amount stays."""
    keys = [c for c in pages.columns if c != text]
    return _first_copies(ticket_rows(pages, text, p), keys, ["pos"])


def _first_copies(rows: DataFrame, keys, order) -> DataFrame:
    detail = ["amount", "vat_included", "ticket_date", *order]
    kept = rows.groupBy(*keys, "ref").agg(
        F.min_by(F.struct(*detail), F.struct(*order)).alias("t")
    )
    return kept.select(*keys, "ref", *[F.col("t")[c].alias(c) for c in detail])


def ticket_images(text: Column, p: Profile) -> Column:
    """How many references are printed, copies included."""
    total = F.lit(0)
    for pattern in p.ticket_refs:
        total = total + F.regexp_count(text, F.lit(f"(?i){pattern}"))
    return F.coalesce(total, F.lit(0))


def sum_runs(tickets: DataFrame, keys) -> DataFrame:
    """Distinct tickets per run, summed: ``tickets, total, first_date``."""
    return tickets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tickets"),
        F.round(F.sum("amount"), 2).alias("total"),
        F.min("ticket_date").alias("first_date"),
    )


def sum_tickets(ledger: Ledger, facts: DataFrame, flagged: DataFrame, p: Profile) -> Ledger:
    """One row per run of consecutive ticket pages, for the chunks in ``flagged`` (chunk_id).

    A run without a readable ticket or without a bill on its pages is left as it is.
    """
    tolls = facts.where("is_toll").join(flagged.distinct(), "chunk_id", "left_semi").select(
        "chunk_id", "page_index", "toll_text"
    )
    run = ["chunk_id", "run_start"]
    members = settle(
        consecutive_runs(
            tolls.select("chunk_id", "page_index", ticket_images(F.col("toll_text"), p).alias("images")),
            ["chunk_id"], "page_index",
        )
    )
    placed = ticket_rows(tolls, "toll_text", p).join(members, ["chunk_id", "page_index"])
    tickets = settle(_first_copies(placed, run, ["page_index", "pos"]))
    sums = sum_runs(tickets, run)
    shape = members.groupBy(*run).agg(
        F.max("page_index").alias("run_end"), F.sum("images").alias("images")
    )
    owners = ledger.bills.select(*BILL_KEY, F.col("chunkPageIndex").alias("page_index")).join(
        members.drop("images"), ["chunk_id", "page_index"]
    )
    bases = owners.groupBy(*run).agg(
        F.min("cand_pos").alias("base_pos"), F.count(F.lit(1)).alias("replaced")
    )
    active = settle(sums.join(bases, run).join(shape, run))
    consumed = settle(
        owners.join(active.select(*run, "base_pos"), run).select("chunk_id", "cand_pos", "base_pos")
    )
    others = consumed.where("cand_pos <> base_pos").select(*BILL_KEY)
    change = active.select(
        "chunk_id", F.col("base_pos").alias("cand_pos"), F.col("run_start").alias("__page"),
        F.col("total").alias("__total"), F.col("first_date").alias("__date"),
    )
    joined = ledger.bills.join(others, BILL_KEY, "left_anti").join(change, BILL_KEY, "left")
    summed = F.col("__total").isNotNull()
    cells = {
        "chunkPageIndex": F.coalesce("__page", "chunkPageIndex"),
        "documentDate": F.when(
            summed,
            F.when(
                F.col("__date").isNotNull(), typed_cell("documentDate", F.col("__date"), DECIDED)
            ).otherwise(typed_cell("documentDate", None, 0.0)),
        ).otherwise(F.col("documentDate")),
        "lineItems": F.when(summed, F.slice("lineItems", 1, 0)).otherwise(F.col("lineItems")),
    }
    for f in ("originalTotal", "clearingAmount"):
        cells[f] = F.when(summed, typed_cell(f, F.col("__total"), DECIDED)).otherwise(F.col(f))
    for f in BLANKED:
        cells[f] = F.when(summed, typed_cell(f, None, 0.0)).otherwise(F.col(f))
    bills = joined.select(
        *[cells[c].alias(c) if c in cells else F.col(c) for c in ledger.bills.columns]
    )

    def repoint(side: DataFrame) -> DataFrame:
        return side.join(consumed, BILL_KEY, "left").withColumn(
            "cand_pos", F.coalesce("base_pos", "cand_pos")
        ).select(*side.columns)

    run_pages = members.join(active.select(*run, "base_pos"), run).select(
        "chunk_id", F.col("base_pos").alias("cand_pos"), "page_index"
    )
    listed = tickets.join(active.select(*run, "base_pos"), run).select(
        "chunk_id", F.col("base_pos").alias("cand_pos"), "page_index", "pos", "ref", "amount",
        "ticket_date",
    )
    listed = running_count(
        listed, BILL_KEY, ["page_index", "pos"], "item_no", block=block_of(F.col("page_index"))
    )
    audit = active.select(
        "chunk_id", F.col("run_start").alias("page_index"), F.col("base_pos").alias("cand_pos"),
        F.lit(True).alias("attached"), F.lit("tickets summed").alias("reason"),
        F.to_json(F.struct(
            "run_start", "run_end", "tickets", "total", "replaced",
            (F.col("images") - F.col("tickets")).alias("copies_dropped"),
        )).alias("detail"),
    )
    return ledger.but(
        bills=bills,
        spans=repoint(ledger.spans).unionByName(run_pages.select(*ledger.spans.columns)),
        evidence=repoint(ledger.evidence),
        tickets=ledger.tickets.unionByName(listed.select(*ledger.tickets.columns)),
    ).log(audit_rows(audit, "ticket"))
