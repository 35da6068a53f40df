"""A training corpus from raw documents: language, quality, lines, near copies, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``.  Learned
stages learn from what the stage is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.llm import langid, lines, ngram, packing, quality
from docrecon.llm.common import settled
from docrecon.llm.queries import word_bpe

CERTAIN = 0.5  # least posterior of a language


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without a letter, or null, go."""
    model = langid.learn(docs)
    found = langid.identify(docs, model, keep=True)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= CERTAIN)).select("row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base limits nor the learned rules reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more share; the largest id keeps them.  ``n_chars``
    follows the text.  Every row stays, also one that loses all its text."""
    kept = lines.dedup_lines(docs, keep=True)
    changed = F.col("n_dropped") > 0
    columns = [
        F.when(changed, F.col("text")).otherwise(F.col("row.text")).alias(c) if c == "text"
        else F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c)
        if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return kept.select(*columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies on five-word shingles: that of the least id, where a null
    id comes last and one of several rows with that id stays.  Rows without words all stay."""
    # The input travels as one struct, so no name of its columns can clash with a name used here.
    rows = settled(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                               F.monotonically_increasing_id().alias("_row")), "pipeline-rows")
    grouped = ngram.jaccard_components(rows.select("_row", "row.text"), id_col="_row", words=5, num=80, den=100)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    ids = rows.select("_row", F.col("row.doc_id").alias("doc_id"))
    first = grouped.join(ids, "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first._row").alias("_row")), "_row", "left_semi").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of at most 4096 tokens."""
    return packing.pack(docs, word_bpe(), end_id=2)


STAGES = [
    ("language", language), ("quality", good), ("lines", distinct_lines), ("near_copies", one_of_each),
    ("packing", packed),
]
# Learned stages and tokenizers have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
