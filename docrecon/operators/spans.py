"""Page ownership: orphans, spans, whole-page regions, evidence tags, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.operators.ledger import BILL_KEY
from docrecon.operators.ordered import running_last
from docrecon.profile import CERTIFICATE_ROLE, Profile

# The one box that can be drawn honestly: the whole page.
FULL_PAGE = {"xMin": 0, "yMin": 0, "xMax": 1000, "yMax": 1000}


def whole_page(page: Column) -> Column:
    return F.struct(
        page.cast("int").alias("chunkPageIndex"),
        *[F.lit(v).cast("int").alias(k) for k, v in FULL_PAGE.items()],
    )


def live(side: DataFrame, bills: DataFrame) -> DataFrame:
    """Rows of a side table whose bill still exists, without repeats."""
    return side.join(bills.select(*BILL_KEY), BILL_KEY, "left_semi").distinct()


def widen(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Add owned pages; owning a page twice is owning it once."""
    return spans.unionByName(pages.select(*spans.columns)).distinct()


def attach_orphans(pages: DataFrame, spans: DataFrame, bills: DataFrame) -> DataFrame:
    """(chunk_id, cand_pos, page_index) for every page nobody owns yet.

    It goes to the owner of the last owned page before it; pages before the first owned one go to
    the first bill of the chunk.  Of several owners of a page the first in ledger order counts.
    """
    owner = spans.groupBy("chunk_id", "page_index").agg(F.min("cand_pos").alias("owner"))
    first = bills.groupBy("chunk_id").agg(F.min("cand_pos").alias("first_bill"))
    held = pages.select("chunk_id", "page_index").join(owner, ["chunk_id", "page_index"], "left")
    filled = running_last(held, ["chunk_id"], ["page_index"], F.col("owner"), "held_by")
    return (
        filled.where(F.col("owner").isNull())
        .join(first, "chunk_id")
        .select("chunk_id", F.coalesce("held_by", "first_bill").alias("cand_pos"), "page_index")
    )


def page_span(spans: DataFrame) -> DataFrame:
    """Sorted unique pages per bill, one row for each bill wherever its pages lie.

    For reports on bills of few pages: a row holds all pages of its bill.  The whole path keeps
    spans as rows.
    """
    return (
        spans.distinct()
        .groupBy(*BILL_KEY)
        .agg(F.array_sort(F.collect_list("page_index")).alias("pages"))
    )


def page_roles(pages: DataFrame, p: Profile) -> DataFrame:
    """(chunk_id, page_index, role, rank): heading roles, plus the certificate role if declared."""
    roles = F.col("roles")
    if CERTIFICATE_ROLE in p.declared_roles:
        roles = F.when(
            F.col("is_certificate"), F.array_append(roles, F.lit(CERTIFICATE_ROLE))
        ).otherwise(roles)
    return pages.select("chunk_id", "page_index", F.posexplode(roles).alias("rank", "role"))


def tag_document_roles(evidence: DataFrame, spans: DataFrame, roles: DataFrame) -> DataFrame:
    """Evidence with every role of every owned page; running it again changes nothing."""
    tags = spans.distinct().join(roles, ["chunk_id", "page_index"])
    return add_evidence(evidence, tags)


def add_evidence(evidence: DataFrame, tags: DataFrame) -> DataFrame:
    return evidence.unionByName(tags.select(*evidence.columns)).distinct()


def span_invariants(spans: DataFrame, bills: DataFrame, pages: DataFrame) -> DataFrame:
    """Broken rules as rows (chunk_id, rule, n): empty when every page is owned exactly once."""
    owned = spans.distinct()
    claims = owned.groupBy("chunk_id", "page_index").agg(F.count(F.lit(1)).alias("owners"))
    grid = pages.select("chunk_id", "page_index").join(
        claims, ["chunk_id", "page_index"], "full_outer"
    ).join(
        pages.select("chunk_id", "page_index", F.lit(True).alias("listed")),
        ["chunk_id", "page_index"], "left",
    )
    per_page = grid.select(
        "chunk_id",
        F.when(F.col("owners") > 1, F.lit("page claimed twice"))
        .when(F.col("owners").isNull(), F.lit("page not owned"))
        .when(F.col("listed").isNull(), F.lit("page not in chunk")).alias("rule"),
    )
    own = owned.select(
        *BILL_KEY, F.col("page_index").alias("chunkPageIndex"), F.lit(True).alias("inside")
    )
    any_span = owned.groupBy(*BILL_KEY).agg(F.lit(True).alias("some"))
    per_bill = (
        bills.select(*BILL_KEY, "chunkPageIndex")
        .join(own, [*BILL_KEY, "chunkPageIndex"], "left")
        .join(any_span, BILL_KEY, "left")
        .select(
            "chunk_id",
            F.when(F.col("some").isNull(), F.lit("bill without pages"))
            .when(F.col("inside").isNull(), F.lit("own page outside span")).alias("rule"),
        )
    )
    broken = per_page.unionByName(per_bill).where(F.col("rule").isNotNull())
    return broken.groupBy("chunk_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def valid_box(box: Column) -> Column:
    inside = F.lit(True)
    for k in FULL_PAGE:
        inside = inside & box[k].between(0, 1000)
    return inside & (box["xMin"] < box["xMax"]) & (box["yMin"] < box["yMax"])


