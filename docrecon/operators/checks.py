"""Payee type and arithmetic: row-level corrections of a finished ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.functions import money
from docrecon.functions.fields import typed_cell, val
from docrecon.functions.names import payee_from_id, payee_from_name
from docrecon.profile import Profile

DECIDED = 0.9
SUSPECT = 0.3
# Fields each failing equation casts doubt on.
DOUBTED_BY = {
    "originalTotal": ["VAT_SUM"],
    "amountBeforeVat": ["VAT_SUM", "VAT_RATE", "WHT_RATE"],
    "vat": ["VAT_SUM", "VAT_RATE"],
    "withholdingTax": ["WHT_RATE"],
}


def classify_payee(name, tax_id, p: Profile):
    return F.coalesce(payee_from_name(name, p), payee_from_id(tax_id, p))


def apply_payee_types(bills: DataFrame, p: Profile) -> tuple[DataFrame, DataFrame]:
    """(bills, report): the decided type replaces a different one; undecided rows keep theirs."""
    judged = bills.withColumn(
        "__now", classify_payee(val("sellerName"), val("sellerTaxId"), p)
    ).withColumn(
        "__changed", F.col("__now").isNotNull() & ~F.col("__now").eqNullSafe(val("payeeType"))
    )
    report = judged.where("__changed").select(
        "chunk_id", "cand_pos", F.col("chunkPageIndex").alias("page_index"),
        val("payeeType").alias("was"), F.col("__now").alias("now"),
    )
    fixed = judged.withColumn(
        "payeeType",
        F.when(F.col("__changed"), typed_cell("payeeType", F.col("__now"), DECIDED)).otherwise(
            F.col("payeeType")
        ),
    )
    return fixed.drop("__now", "__changed"), report


def check_identities(bills: DataFrame, p: Profile) -> DataFrame:
    """Add ``findings``: codes of the equations the bill breaks."""
    return bills.withColumn(
        "findings",
        money.findings(
            val("originalTotal"), val("amountBeforeVat"), val("vat"), val("withholdingTax"),
            p.vat_rate, p.withholding_rates,
        ),
    )


def distrust(checked: DataFrame, cap: float = SUSPECT) -> DataFrame:
    """Cap the confidence of every field in a failing equation; never raise it, never edit a value."""
    out = {}
    for field, codes in DOUBTED_BY.items():
        hit = F.arrays_overlap("findings", F.array(*[F.lit(c) for c in codes]))
        out[field] = F.when(
            hit & F.col(field)["confidence"].isNotNull(),
            typed_cell(field, val(field), F.least(F.col(field)["confidence"], F.lit(cap))),
        ).otherwise(F.col(field))
    return checked.withColumns(out)

