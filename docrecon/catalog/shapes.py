"""Shared tables in the shape of the data model: events and conversations as chunks of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.catalog.registry import table
from docrecon.functions.fields import typed_cell
from docrecon.operators.ordered import running_count

EV_SQL = """ev as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as page
  from events)"""


def event_pages(spark, d, *cols) -> DataFrame:
    """Events as pages: chunk = user, page = position in time.  Blocks are hours, which order time."""
    e = table(spark, d, "events", "user_id", "ts", "event_id", *[c for c in cols if c not in
                                                                 ("user_id", "ts", "event_id")])
    e = e.withColumnRenamed("user_id", "chunk_id")
    hour = F.unix_date(F.to_date("ts")).cast("long") * 24 + F.hour("ts")
    return running_count(e, ["chunk_id"], ["ts", "event_id"], "page_index", block=hour).withColumn(
        "page_index", F.col("page_index").cast("int")
    )


def cells(df: DataFrame, keep, given, confidence: float = 0.8) -> DataFrame:
    """Select ``keep`` and wrap the given values as cells."""
    return df.select(*keep, *[typed_cell(f, v, confidence).alias(f) for f, v in given.items()])


def turns(spark, d) -> DataFrame:
    c = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return c.select(
        F.col("conv_id").alias("chunk_id"), F.col("turn").cast("int").alias("page_index"), "role", "text"
    )


def turn_lines(spark, d) -> DataFrame:
    """Every line of a turn as a candidate, numbered through the conversation."""
    rows = turns(spark, d).select(
        "chunk_id", "page_index", "role", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    return running_count(rows, ["chunk_id"], ["page_index", "pos"], "cand_pos")


LINES_SQL = """lines0 as (select conv_id, turn, role, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as pos from conversations),
  lines as (select *, row_number() over (partition by conv_id order by turn, pos) - 1 as cand_pos
    from lines0)"""
