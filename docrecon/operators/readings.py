"""Choosing among repeated readings of a page and repeated answers for a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions import text
from docrecon.functions.udfs import zlib_ratio
from docrecon.profile import Profile


def with_verdict(df: DataFrame, column: str, p: Profile) -> DataFrame:
    """Add ``verdict``: null for a usable text, else ``empty``, ``at_burst`` or ``loop(...)``.

    Compression runs in Python, so it is handed only texts that already look like a loop.
    """
    t = F.col(column)
    scored = df.withColumn("__score", text.repeat_score(t, p.limits.min_segment_chars)).withColumn(
        "__early", text.early_verdict(t, p)
    )
    ratio, n = F.col("__score")["ratio"], F.col("__score")["n"]
    suspect = F.col("__early").isNull() & text.looping(ratio, n, p)
    packed = scored.withColumn("__packed", zlib_ratio(F.when(suspect, t)))
    verdict = F.coalesce(
        F.col("__early"),
        F.when(
            F.col("__packed") <= p.limits.max_compression,
            text.loop_reason(ratio, F.col("__packed"), n),
        ),
    )
    return packed.withColumn("verdict", verdict).drop("__score", "__early", "__packed")


def best_reading(readings: DataFrame, keys, text_col: str = "text") -> DataFrame:
    """One row per page from its attempts: ``attempt, text, verdict``.

    The first attempt stands unless it looped; then the first later attempt without a verdict
    replaces it; with none the page keeps its first text and reason.  ``readings`` carries
    ``attempt`` and ``verdict``.
    """
    keys = list(keys)
    pick = F.struct("attempt", F.col(text_col).alias("text"), "verdict")
    ranked = readings.groupBy(*keys).agg(
        F.min_by(pick, "attempt").alias("first"),
        F.min_by(pick, F.when(F.col("verdict").isNull(), F.col("attempt"))).alias("clean"),
    )
    use_clean = text.worth_rereading(F.col("first")["verdict"]) & F.col("clean").isNotNull()
    chosen = F.when(use_clean, F.col("clean")).otherwise(F.col("first"))
    return ranked.select(*keys, chosen.alias("c")).select(*keys, "c.attempt", "c.text", "c.verdict")


def first_valid(responses: DataFrame, keys, ok: Column) -> DataFrame:
    """Per chunk the first attempt that passes, else a null attempt: ``attempt, attempts``."""
    return responses.groupBy(*keys).agg(
        F.min(F.when(ok, F.col("attempt"))).alias("attempt"),
        F.count(F.lit(1)).alias("attempts"),
    )
