"""One chunk holding everything: results stay right and no step forms all pairs."""

from pyspark.sql import functions as F

from docrecon.catalog import QUERIES
from docrecon.operators.certificates import ALWAYS, find_targets
from docrecon.operators.slips import match_amounts
from docrecon.profile import Profile

P = Profile()


def test_equal_amounts_are_counted_not_paired(spark):
    n = 60_000  # as pairs this would be 3.6 billion rows
    slips = spark.range(n).select(
        F.lit("hot").alias("chunk_id"), F.col("id").alias("slip_id"), F.lit(100.0).alias("amount")
    ).unionByName(spark.createDataFrame([("hot", -1, 55.5)], "chunk_id string, slip_id long, amount double"))
    bills = spark.range(n).select(
        F.lit("hot").alias("chunk_id"), F.col("id").alias("bill_id"), F.lit(100.0).alias("paid"),
        F.lit(100.02).alias("gross"),
    ).unionByName(
        spark.createDataFrame([("hot", -7, None, 55.54)], "chunk_id string, bill_id long, paid double, gross double")
    )
    out = match_amounts(slips, bills, 0.05)
    assert out.where("slip_id >= 0 and hits = 60000 and not matched").count() == n
    one = out.where("slip_id = -1").collect()[0]
    assert one.matched and one.bill_id == -7 and one.hits == 1


def test_copies_of_one_purchase_are_folded(spark):
    n = 40_000
    certs = spark.range(3000).select(
        F.lit("hot").alias("chunk_id"), (F.col("id") + n).cast("int").alias("page_index"),
        F.lit("7").alias("tax_id"), F.lit(500.0).alias("base"), F.lit("2026-01-01").alias("day"),
        F.lit("alpha").alias("name"),
    )

    def cell(c):
        return F.struct(c.alias("value"), F.lit(0.5).alias("confidence"))

    bills = spark.range(n).select(
        F.lit("hot").alias("chunk_id"), F.col("id").alias("cand_pos"),
        cell(F.lit(500.0)).alias("amountBeforeVat"), cell(F.lit("2026-01-01")).alias("documentDate"),
        cell(F.lit("Alpha")).alias("sellerName"), cell(F.lit(None).cast("string")).alias("sellerTaxId"),
    )
    known = bills.select("chunk_id", "cand_pos", F.lit("7").alias("tax_id"), F.lit(ALWAYS).alias("since"))
    out = find_targets(certs, bills, known, P)
    got = out.agg(F.count(F.lit(1)).alias("n"), F.max("cand_pos").alias("m")).collect()[0]
    assert (got.n, got.m) == (3000, 0)


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["page_quality_triage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<text:string,source:string>" in plan
    plan = QUERIES["consecutive_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
