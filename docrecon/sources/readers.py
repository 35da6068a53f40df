"""Reading transcripts, model answers, categories, answer keys and speed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrecon.schema import MODEL_RESPONSE


def read_transcripts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """One row per text file: ``label`` (file name without suffix) and ``text``."""
    stem = F.regexp_extract("_metadata.file_name", rf"^(.*)\Q{suffix}\E$", 1)
    raw = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    return raw.select(F.url_decode(stem).alias("label"), F.col("value").alias("text"))


def parse_candidates(
    df: DataFrame, column: str, schema: T.DataType = MODEL_RESPONSE, path: str = "billCandidates"
) -> DataFrame:
    """Model JSON to one row per candidate; other columns are carried, ``page_pos`` is its position.

    A response without candidates keeps one row with nulls.
    """
    rest = [c for c in df.columns if c != column]
    parsed = df.select(*rest, F.from_json(F.col(column), schema).alias("__r"))
    return parsed.select(
        *rest, F.posexplode_outer(F.col("__r")[path]).alias("page_pos", "__c")
    ).select(*rest, "page_pos", "__c.*")


def answer_faults(df: DataFrame, column: str, path: str = "billCandidates") -> DataFrame:
    """Rows whose answer gives no list of candidates, with ``fault`` saying why.

    ``parse_candidates`` gives such rows nulls, as it does for an empty list, which is no fault.
    A null or blank answer is ``no answer``; broken text, also one cut short, is ``not JSON``.
    """
    answer = F.col(f"`{column}`")
    parsed = F.try_parse_json(answer)
    fault = (
        F.when(answer.isNull() | (F.trim(answer) == ""), F.lit("no answer"))
        .when(parsed.isNull(), F.lit("not JSON"))
        .when(F.try_variant_get(parsed, f"$.{path}", "array<variant>").isNull(), F.lit("no candidate list"))
    )
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (column, "fault")]
    return df.select(*rest, fault.alias("fault")).where(F.col("fault").isNotNull())


def category_columns(key: Column, raw: Column) -> list[Column]:
    """A category entry as columns; a bare string counts as the rule."""
    is_object = F.json_object_keys(raw).isNotNull()

    def get(name):
        return F.when(is_object, F.get_json_object(raw, f"$.{name}"))

    return [
        key.alias("code"), get("group").alias("group"), get("name").alias("name"),
        F.when(is_object, F.get_json_object(raw, "$.rule")).otherwise(raw).alias("rule"),
        F.coalesce(get("sumTollTickets").cast("boolean"), F.lit(False)).alias("sumTollTickets"),
        get("vat").alias("vat"),
        get("withholdingTaxRate").try_cast("double").alias("withholdingTaxRate"),
        get("evidence").alias("evidence"),
    ]


def load_categories(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of codes to rows; keys starting with ``_`` are notes."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(
        F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("k", "v")
    ).where(~F.col("k").startswith("_"))
    return entries.select(*category_columns(F.col("k"), F.col("v")))


GOLDEN = (
    "cases array<struct<caseId:string,source:string,page:int,language:string,"
    "documentType:string,handwriting:boolean,fields:map<string,string>>>"
)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Answer key to long rows, one per case and field."""
    cases = spark.read.schema(GOLDEN).option("multiLine", True).json(path).select(
        F.explode("cases").alias("c")
    )
    return cases.select(
        F.col("c.caseId").alias("case_id"), "c.source", F.coalesce("c.page", F.lit(1)).alias("page"),
        "c.language", F.col("c.documentType").alias("document_type"), "c.handwriting",
        F.explode("c.fields").alias("field", "expected"),
    )


SPEED_RUN = (
    "machine struct<gpu:string,host:string,vram_total_mib:double>, settings string, when string, "
    "commit string, peak_vram_mib double, pages array<struct<file:string,page:int,"
    "rasterise_s:double,stage1_s:double,stage2_s:double,stage1_chars:long,stage1_failed:boolean,"
    "stage2_error:string>>"
)


def read_speed_runs(spark: SparkSession, path: str) -> DataFrame:
    """Speed-run files to one row per timed page, with the run's machine and settings."""
    runs = spark.read.schema(SPEED_RUN).option("multiLine", True).json(path)
    return runs.select(
        F.concat_ws("", F.col("machine.gpu"), F.lit(" ("), F.col("machine.host"), F.lit(")")).alias(
            "run"
        ),
        "settings", "when", "commit", "peak_vram_mib", F.col("machine.vram_total_mib").alias("vram_total_mib"),
        F.explode("pages").alias("p"),
    ).select("run", "settings", "when", "commit", "peak_vram_mib", "vram_total_mib", "p.*")


def settings_differ(runs: DataFrame) -> DataFrame:
    """One row saying whether the runs used more than one set of settings."""
    return runs.agg((F.count_distinct("settings") > 1).alias("differ"))
