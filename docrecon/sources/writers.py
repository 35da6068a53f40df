"""Sinks: contract responses and the two files the external scorer reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.operators.contract import LINE_ORDER, response_lines
from docrecon.operators.ledger import Ledger


def ledger_responses(ledger: Ledger, chunks: DataFrame) -> DataFrame:
    """Contract JSON of every chunk of a reconciled ledger, as ordered lines."""
    return response_lines(chunks, ledger)


def write_response(lines: DataFrame, path: str) -> None:
    """Text files whose lines, in order of file name, are one JSON document after another.

    Lines are sorted by range over all tasks and streamed out, so a document may begin in one file
    and end in the next, and no task holds a chunk or a bill.
    """
    ordered = lines.repartitionByRange(*LINE_ORDER).sortWithinPartitions(*LINE_ORDER)
    ordered.select("line").write.mode("errorifexists").text(path)


def write_scoring_inputs(golden: DataFrame, predictions: DataFrame, out: str) -> None:
    """Answer key without open fields, and flattened predictions, as two folders of JSON lines."""
    def cases(df: DataFrame, value: str) -> DataFrame:
        # One object per case; a case has only the contract's fields.
        return df.groupBy(F.col("case_id").alias("caseId")).agg(
            F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", value)))).alias("fields")
        )

    options = {"ignoreNullFields": "false"}
    wanted = golden.select("case_id", "field").distinct()
    known = predictions.join(wanted, ["case_id", "field"], "left_semi")
    # A case nobody predicted still appears, with no fields.
    flat = golden.select(F.col("case_id").alias("caseId")).distinct().join(
        cases(known, "value"), "caseId", "left"
    ).withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    cases(golden, "expected").write.options(**options).json(f"{out}/golden.scorable")
    flat.write.options(**options).json(f"{out}/prediction")
