"""Account categories: which rule text and which behaviour a request's code switches on.

Spark broadcasts a category table by its size in bytes; no plan depends on a row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.functions.text import category_key, strip


def category_rules(categories: DataFrame) -> DataFrame:
    """Only the categories that say something; a blank rule is no rule."""
    rule = strip(F.col("rule"))
    return categories.where(rule != "").withColumn("rule", rule)


def _per_key(categories: DataFrame) -> DataFrame:
    """One row per key: the rule of the first code that has one, and whether any code sums tickets."""
    rule = F.nullif(strip(F.coalesce("rule", F.lit(""))), F.lit(""))
    return (
        categories.withColumn("key", category_key(F.col("code")))
        .groupBy("key")
        .agg(
            F.min_by(rule, F.when(rule.isNotNull(), F.col("code"))).alias("rule"),
            F.coalesce(F.bool_or("sumTollTickets"), F.lit(False)).alias("sums"),
        )
    )


def category_lookup(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """Left join on the normalised code: ``rule`` or null.  ``requests`` carries ``key``."""
    return requests.join(_per_key(categories).select("key", "rule"), "key", "left")


def category_effect(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """Add ``effect`` (none, no-effect, prompt, tolls, prompt,tolls) and ``sums_tickets``.

    ``requests`` carries ``category`` and ``key``.
    """
    keyed = _per_key(categories).withColumnRenamed("rule", "__rule")
    joined = requests.join(keyed, "key", "left")
    stated = F.col("category").isNotNull() & (strip(F.col("category")) != "")
    fired = F.concat_ws(
        ",",
        F.when(F.col("__rule").isNotNull(), F.lit("prompt")),
        F.when(F.col("sums"), F.lit("tolls")),
    )
    return joined.select(
        *requests.columns,
        F.when(~F.coalesce(stated, F.lit(False)), F.lit("none"))
        .when(fired == "", F.lit("no-effect"))
        .otherwise(fired).alias("effect"),
        (F.coalesce(stated, F.lit(False)) & F.coalesce("sums", F.lit(False))).alias("sums_tickets"),
    )
