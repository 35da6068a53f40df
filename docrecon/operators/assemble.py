"""Model candidates to ledger bills: money filter, per-field guards, parties, own identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions import ids, names, text
from docrecon.functions.fields import cell, typed_cell, val
from docrecon.operators.ordered import running_count
from docrecon.profile import ACCOUNT_LIKE, OwnParty, Profile
from docrecon.schema import (
    BILL_MONEY, CELL_FIELDS, ITEM_FIELDS, PARTY_PARTS, PHANTOM_MONEY, cell_sql_type,
)


def any_value(fields) -> Column:
    return F.coalesce(*[val(f) for f in fields]).isNotNull()


def has_money(fields=BILL_MONEY, keep: Column | None = None) -> Column:
    """A bill states an amount; ``keep`` overrides (certificate pages)."""
    test = any_value(fields)
    return test | keep if keep is not None else test


def is_phantom(fields=PHANTOM_MONEY) -> Column:
    return ~any_value(fields)


def guard_cells(df: DataFrame, transcript: Column, p: Profile) -> DataFrame:
    """Fill missing cells and apply the per-field guards; a rejected value loses its confidence."""
    guards = {
        "sellerTaxId": lambda v: ids.clean_tax_id(v, p.id_scheme.length),
        "buyerTaxId": lambda v: ids.clean_tax_id(v, p.id_scheme.length),
        "originalDocumentNumber": lambda v: text.clean_document_number(v, transcript, p),
        "paymentMethod": lambda v: text.clean_payment_method(v, ACCOUNT_LIKE),
    }
    out = {}
    for f in CELL_FIELDS:
        if f not in guards:
            out[f] = F.expr(
                f"cast(named_struct('value', {f}.value, 'confidence', coalesce({f}.confidence, 0.0D))"
                f" as {cell_sql_type(f)})"
            )
            continue
        raw, kept = val(f), guards[f](val(f))
        lost = kept.isNull() & raw.isNotNull()
        confidence = F.when(lost, F.lit(0.0)).otherwise(
            F.coalesce(F.col(f)["confidence"], F.lit(0.0))
        )
        out[f] = cell(kept, confidence).cast(cell_sql_type(f))
    return df.withColumns(out)


def default_items(items: Column) -> Column:
    """Line items with every missing cell as (null, 0.0); a missing list becomes an empty one."""

    def one(item):
        return F.struct(
            *[
                F.struct(
                    item[f]["value"].alias("value"),
                    F.coalesce(item[f]["confidence"], F.lit(0.0)).alias("confidence"),
                ).alias(f)
                for f in ITEM_FIELDS
            ]
        )

    return F.coalesce(F.transform(items, one), F.array())


def resolve_parties(df: DataFrame, own: OwnParty) -> DataFrame:
    """Put the seller's details in the seller fields.  All tests read the original columns.

    Both sides ours: blank the seller parts that are ours or repeat the buyer.  Only the seller
    ours: swap.  No seller name but a foreign buyer name: move the foreign buyer parts over.
    """
    seller = {p: f"seller{p}" for p in PARTY_PARTS}
    buyer = {p: f"buyer{p}" for p in PARTY_PARTS}
    ours_s = {p: names.is_our_value(p, val(seller[p]), own) for p in PARTY_PARTS}
    ours_b = {p: names.is_our_value(p, val(buyer[p]), own) for p in PARTY_PARTS}
    seller_us, buyer_us = F.lit(False), F.lit(False)
    for part in PARTY_PARTS:
        seller_us, buyer_us = seller_us | ours_s[part], buyer_us | ours_b[part]
    both = seller_us & buyer_us
    swap = seller_us & ~buyer_us
    shift = (
        ~seller_us & val("sellerName").isNull() & val("buyerName").isNotNull() & ~ours_b["Name"]
    )
    blank = F.struct(
        F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence")
    )
    out = {}
    for part in PARTY_PARTS:
        s, b = seller[part], buyer[part]
        repeats = F.coalesce(val(s) == val(b), F.lit(False))
        moved = shift & ~ours_b[part] & val(s).isNull()
        out[s] = (
            F.when(both & (ours_s[part] | repeats), blank)
            .when(swap | moved, F.col(b))
            .otherwise(F.col(s))
        )
        out[b] = F.when(swap, F.col(s)).when(moved, blank).otherwise(F.col(b))
    return df.withColumns(out)


def apply_party_constant(df: DataFrame, transcript: Column, own: OwnParty) -> DataFrame:
    """The page decides the buyer: names us -> our four values, else four blanks."""
    named = text.names_party(transcript, own.evidence)
    given = {"Name": own.name, "Address": own.address, "TaxId": own.tax_id, "Branch": own.branch}
    return df.withColumns(
        {
            f"buyer{part}": F.when(named, typed_cell(f"buyer{part}", given[part], 1.0)).otherwise(
                typed_cell(f"buyer{part}", None, 0.0)
            )
            for part in PARTY_PARTS
        }
    )


def gated_null_column(df: DataFrame, name: str, declared) -> DataFrame:
    """An always-null cell, only where the receiving contract declares the key."""
    return df.withColumn(name, typed_cell(name, None, 0.0)) if name in declared else df


def assemble(
    candidates: DataFrame,
    p: Profile,
    *,
    use_party_constant: bool = True,
    number_on_page: bool = True,
    declared=("relatedDocumentNumber",),
) -> DataFrame:
    """Model candidates to bills.

    ``candidates``: (chunk_id, page_index, page_pos, transcript, model cells, lineItems), where
    ``page_pos`` orders the candidates of one page.  Adds ``cand_pos``, the position in the chunk,
    and ``candidateIndex``, the position on the page (0 throughout unless ``number_on_page``, for
    callers that number the merged bills).
    """
    keep = text.is_certificate(F.col("transcript"), p)
    df = candidates.where(has_money(BILL_MONEY, keep))
    df = guard_cells(df, F.col("transcript"), p)
    df = df.withColumn("lineItems", default_items(F.col("lineItems")))
    df = gated_null_column(df, "relatedDocumentNumber", declared)
    df = resolve_parties(df, p.own)
    if use_party_constant and p.own.evidence:
        df = apply_party_constant(df, F.col("transcript"), p.own)
    df = df.drop("transcript").withColumn("chunkPageIndex", F.col("page_index").cast("int"))
    df = running_count(df, ["chunk_id"], ["page_index", "page_pos"], "cand_pos")
    if number_on_page:
        df = running_count(df, ["chunk_id", "page_index"], ["page_pos"], "candidateIndex")
    else:
        df = df.withColumn("candidateIndex", F.lit(0))
    return df.withColumn("candidateIndex", F.col("candidateIndex").cast("int")).drop(
        "page_index", "page_pos"
    )


def renumber(bills: DataFrame) -> DataFrame:
    """``candidateIndex`` 0, 1, 2 ... per chunk in ledger order."""
    cols = bills.columns
    out = running_count(
        bills.drop("candidateIndex"), ["chunk_id"], ["cand_pos"], "candidateIndex"
    ).withColumn("candidateIndex", F.col("candidateIndex").cast("int"))
    return out.select(*cols) if "candidateIndex" in cols else out
