"""Facts read once from every page and joined wherever they are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.functions import ids, money, text
from docrecon.profile import Profile


def page_facts(pages: DataFrame, p: Profile) -> DataFrame:
    """One row per page with classifier flags and the values printed on it.

    Every regular expression runs once per page; extraction for a class of page is skipped on the
    other pages.  ``pages``: (chunk_id, page_index, transcript), and ``verdict`` where judged.
    """
    t = F.col("transcript")
    own = p.own.tax_id
    verdict = F.col("verdict") if "verdict" in pages.columns else F.lit(None).cast("string")
    flags = pages.select(
        "chunk_id",
        F.col("page_index").cast("int").alias("page_index"),
        "transcript",
        verdict.alias("verdict"),
        text.is_certificate(t, p).alias("is_certificate"),
        text.is_id_card(t, p).alias("is_card"),
        text.is_transfer_slip(t, p).alias("is_slip"),
        text.is_toll_page(t, p).alias("is_toll"),
    )
    cert_text = F.when(F.col("is_certificate"), t)
    card_text = F.when(F.col("is_card"), t)
    slip_text = F.when(F.col("is_slip"), t)
    page_ids = ids.valid_ids(ids.extract_ids(t, p.id_scheme.length), p.id_scheme, own)
    return flags.select(
        "chunk_id", "page_index", "verdict", "is_certificate", "is_card", "is_slip", "is_toll",
        text.page_marker(t, p.page_marker, p.limits.max_marker_pages).alias("marker"),
        page_ids.alias("ids"),
        text.roles_for_page(t, p).alias("roles"),
        money.base_and_tax(
            money.extract_amounts(cert_text, p.amount), p.legal_rate_percents
        ).alias("cert"),
        ids.single_valid_id(
            ids.extract_spaced_ids(card_text, p.id_scheme.length), p.id_scheme, own
        ).alias("card_id"),
        text.labelled_value(card_text, p.card_name_label).alias("card_name"),
        money.single_amount_excluding(slip_text, p.slip_amount, p.slip_fee).alias("slip_amount"),
        text.labelled_value(slip_text, p.slip_reference, False).alias("slip_reference"),
        F.when(F.col("is_toll"), t).alias("toll_text"),
    )
