"""Small hand-made inputs; every id and name is invented."""

from pyspark.sql import types as T

from docrecon.schema import (
    CELL_FIELDS, DATE_FIELDS, LINE_ITEM, NUMBER_CELL, NUMBER_FIELDS, STRING_CELL, STRING_FIELDS,
)

A, B = "0100000000018", "0100000000026"      # juristic, valid
P, Q = "3100000000039", "1100000000041"      # personal, valid

BILL = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("cand_pos", T.LongType()),
        T.StructField("chunkPageIndex", T.IntegerType()),
        T.StructField("candidateIndex", T.IntegerType()),
    ]
    + [T.StructField(f, STRING_CELL) for f in STRING_FIELDS]
    + [T.StructField(f, NUMBER_CELL) for f in NUMBER_FIELDS]
    + [T.StructField(f, STRING_CELL) for f in DATE_FIELDS]
    + [T.StructField("lineItems", T.ArrayType(LINE_ITEM))]
)


def cell(field, value, confidence=0.8):
    if value is None:
        return (None, 0.0)
    return (float(value) if field in NUMBER_FIELDS else value, confidence)


def bill(chunk, pos, page, items=(), **values):
    return (chunk, pos, page, pos) + tuple(
        cell(f, values.get(f)) for f in CELL_FIELDS_ORDER
    ) + (list(items),)


CELL_FIELDS_ORDER = STRING_FIELDS + NUMBER_FIELDS + DATE_FIELDS
assert sorted(CELL_FIELDS_ORDER) == sorted(CELL_FIELDS)


def bills_df(spark, rows):
    return spark.createDataFrame(rows, BILL)


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, page_index int, transcript string")
