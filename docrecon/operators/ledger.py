"""The working state of a reconciliation: bills plus long side tables keyed by bill.

Spans, evidence and toll line items stay as rows until a sink nests them, so that no bill has to
hold a large array while it is being worked on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BILL_KEY = ["chunk_id", "cand_pos"]

AUDIT_COLUMNS = (
    "step string, chunk_id string, page_index int, cand_pos long, attached boolean, "
    "reason string, detail string"
)


@dataclass(frozen=True)
class Ledger:
    """``bills``: cells and nested line items, one row per bill, ordered by ``cand_pos``.
    ``spans``: (chunk_id, cand_pos, page_index), pages owned besides or including the own page.
    ``evidence``: (chunk_id, cand_pos, role, page_index, rank); ``rank`` orders the roles of a page.
    ``tickets``: (chunk_id, cand_pos, item_no, ref, amount, ticket_date), items of summed toll rows.
    ``audit``: one row per decision.
    """

    bills: DataFrame
    spans: DataFrame
    evidence: DataFrame
    tickets: DataFrame
    audit: DataFrame

    def but(self, **changes) -> "Ledger":
        return replace(self, **changes)

    def log(self, rows: DataFrame) -> "Ledger":
        return self.but(audit=self.audit.unionByName(rows))


def _empty(df: DataFrame, ddl: str) -> DataFrame:
    """No rows of the given columns, in a form the optimizer drops from unions."""
    nulls = [f"cast(null as {c.split(' ')[1]}) as {c.split(' ')[0]}" for c in ddl.split(", ")]
    return df.sparkSession.sql(f"select {', '.join(nulls)} where false")


def new_ledger(bills: DataFrame) -> Ledger:
    spans = bills.where(F.col("chunkPageIndex").isNotNull()).select(
        *BILL_KEY, F.col("chunkPageIndex").alias("page_index")
    )
    return Ledger(
        bills=bills,
        spans=spans,
        evidence=_empty(bills, "chunk_id string, cand_pos long, role string, page_index int, rank int"),
        tickets=_empty(
            bills,
            "chunk_id string, cand_pos long, item_no long, ref string, amount double, "
            "ticket_date string",
        ),
        audit=_empty(bills, AUDIT_COLUMNS),
    )


def audit_rows(df: DataFrame, step: str, **cols) -> DataFrame:
    """Shape decision rows for the audit table; columns not given are null."""
    out = []
    for part in AUDIT_COLUMNS.split(", "):
        name, kind = part.split(" ")
        source = F.lit(step) if name == "step" else cols.get(name)
        if source is None:
            source = F.col(name) if name in df.columns else F.lit(None)
        out.append(source.cast(kind).alias(name))
    return df.select(*out)

