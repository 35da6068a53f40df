"""Ranks and quantiles against sorting, for awkward values."""

import random

import numpy as np
from pyspark.sql import functions as F

from docrecon.operators.ranks import quantiles, values_at


def groups():
    rng = random.Random(3)
    return {
        "even": [rng.uniform(-5, 5) for _ in range(3000)],
        "ties": [float(rng.choice([0, 0, 0, 1, 2])) for _ in range(500)],
        "powers": [2.0 ** -rng.randint(0, 900) for _ in range(400)] + [-(2.0 ** k) for k in range(50)],
        "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, float("inf"), float("-inf"), 5.0],
        "one": [7.25],
        "same": [3.5] * 40,
        None: [1.0, 2.0, 3.0],
    }


def test_values_at_every_kind_of_rank(spark):
    data = groups()
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("even", None), ("even", float("nan")), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = [(k, r) for k, vs in data.items() for r in sorted({0, len(vs) - 1, len(vs) // 2, len(vs) // 3})]
    got = values_at(df, ["g"], "v", spark.createDataFrame(wanted, "g string, rank long")).collect()
    assert len(got) == len(wanted)
    for r in got:
        assert r.value == sorted(data[r.g])[r["rank"]], (r.g, r["rank"])


def test_quantiles_are_exact_and_hold_no_group(spark):
    data = {k: v for k, v in groups().items() if k not in ("wide", "powers")}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "g string, v double")
    got = quantiles(df, ["g"], "v", 0.95, "p95")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan
    for r in got.collect():
        assert abs(r.p95 - np.quantile(data[r.g], 0.95)) < 1e-12


def test_empty(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert quantiles(none, ["g"], "v", 0.5, "m").count() == 0
    nulls = spark.createDataFrame([("a", None)], "g string, v double")
    assert quantiles(nulls, ["g"], "v", 0.5, "m").select(F.col("m")).count() == 0
