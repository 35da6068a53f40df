"""Exact values at given ranks of each group, without a group's values in one place.

A round cuts the range that holds a wanted rank into ``BINS`` ranges of equal width, counts the rows
of the group in each, and goes on with the one range that holds the rank, from its least to its
largest value.  Counts are summed in each task first, so a group sends a histogram, whatever its
size.  Least and largest value never share a range, so ranges shrink until they are one value: with
even values after a few rounds, and after 1,100 / log2(BINS) at most, as doubles have no more bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.operators.rounds import settle

BINS = 1024
_LARGEST = 1.7976931348623157e308


def _same(keys: Sequence[str], a: DataFrame, b: DataFrame) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"__{k}"])
    return out


def values_at(rows: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """``ranks`` with the column ``value``: of its group, the value at ``rank``, from 0 in ascending order.

    ``ranks``: (keys, rank), a row for each wanted rank, which must be below the group's rows.  Null
    and NaN are no values and take no rank.  A null key is a group of its own.  Equal ranks may
    repeat.  Beyond the first round only rows inside the ranges are read.
    """
    keys, marks = list(keys), [f"__{k}" for k in keys]
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("__v"))
    bounds = held.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    wanted = ranks.select(*keys, "rank").distinct()
    asked = wanted.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("rank").cast("long").alias("__rank"))
    asked = settle(asked.join(bounds, _same(keys, bounds, asked)).select(
        *marks, "__rank", F.col("__rank").alias("__left"), "__lo", "__hi"))
    scaled = lambda c: F.least(F.greatest(c, F.lit(-_LARGEST)), F.lit(_LARGEST)) / 2
    share = (scaled(F.col("__v")) - scaled(F.col("__lo"))) / (scaled(F.col("__hi")) - scaled(F.col("__lo")))
    while True:
        open_ = asked.where("__lo < __hi")
        if open_.isEmpty():
            break
        inside = held.join(open_, _same(keys, held, open_) & held["__v"].between(open_["__lo"], open_["__hi"]))
        bins = inside.select(*marks, "__rank", "__left", "__v", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("__bin")).groupBy(
            *marks, "__rank", "__left", "__bin").agg(
            F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        upto = F.sum("__n").over(Window.partitionBy(*marks, "__rank").orderBy("__bin"))
        found = bins.withColumn("__upto", upto).where(
            (F.col("__upto") > F.col("__left")) & (F.col("__upto") - F.col("__n") <= F.col("__left")))
        asked = settle(asked.where("__lo = __hi").unionByName(found.select(
            *marks, "__rank", (F.col("__left") - (F.col("__upto") - F.col("__n"))).alias("__left"), "__lo", "__hi")))
        spans = asked.where("__lo < __hi").select(*marks, "__lo", "__hi").distinct()
        held = settle(held.join(spans, _same(keys, held, spans) & held["__v"].between(spans["__lo"], spans["__hi"]), "left_semi"))
    return ranks.join(asked, _same(keys, ranks, asked) & (ranks["rank"] == asked["__rank"])).select(
        *ranks.columns, F.col("__lo").alias("value"))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """(keys, name): the exact quantile of each group, between two ranks by their distance."""
    keys = list(keys)
    sizes = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    place = F.lit(q) * (F.col("n") - 1)
    spots = settle(sizes.select(*keys, F.floor(place).cast("long").alias("low"), F.ceil(place).cast("long").alias("high"),
                                (place - F.floor(place)).alias("part")))
    wanted = spots.select(*keys, F.explode(F.array_distinct(F.array("low", "high"))).alias("rank"))
    found = values_at(rows, keys, value, wanted)
    both = spots.select(*[F.col(k).alias(f"__{k}") for k in keys], "low", "high", "part")
    met = found.join(both, _same(keys, found, both)).groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == F.col("low"), F.col("value"))).alias("a"),
        F.max(F.when(F.col("rank") == F.col("high"), F.col("value"))).alias("b"), F.max("part").alias("part"))
    return met.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias(name))
