"""Scoring against an answer key, calibration, run comparison, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.fields import canonical_by_kind, matches
from docrecon.functions.text import strip
from docrecon.operators.ranks import quantiles, values_at
from docrecon.operators.rounds import settle
from docrecon.profile import CALIBRATION_BANDS
from docrecon.schema import AMOUNT_FIELDS, RATE_FIELDS

TODO = "TODO"


def golden_long(golden: DataFrame) -> DataFrame:
    """Cases with a map of fields to one row per field."""
    rest = [c for c in golden.columns if c != "fields"]
    return golden.select(*rest, F.explode("fields").alias("field", "expected"))


def scorable(long: DataFrame) -> DataFrame:
    """Fields already filled in; a case with none drops out with its last row."""
    return long.where(F.col("expected").isNull() | (F.col("expected") != TODO))


def todo_report(long: DataFrame) -> DataFrame:
    """Filled and open fields per case, and a total row whose ``case_id`` is null."""
    open_ = F.col("expected").eqNullSafe(TODO)
    return long.rollup("case_id").agg(
        F.count_if(~open_).alias("filled"), F.count_if(open_).alias("todo")
    )


def open_fields(long: DataFrame) -> DataFrame:
    """The open fields of each case as text; a case has no more fields than the contract."""
    return (
        long.where(F.col("expected") == TODO)
        .groupBy("case_id")
        .agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("open_fields"))
    )


def single_candidate(predictions: DataFrame) -> DataFrame:
    """A case split over several candidates counts as no prediction at all."""
    return predictions.where("n_candidates = 1")


def flatten_candidates(bills: DataFrame, fields) -> DataFrame:
    """Cells to long rows (case_id, n_candidates, field, value, confidence), canonical text."""
    sizes = bills.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                canonical_by_kind(
                    F.col(f)["value"].cast("string"), F.lit(f in AMOUNT_FIELDS),
                    F.lit(f in RATE_FIELDS),
                ).alias("value"),
                F.col(f)["confidence"].alias("confidence"),
            )
            for f in fields
        ]
    )
    return (
        bills.join(sizes, "case_id")
        .select("case_id", "n_candidates", F.explode(cells).alias("c"))
        .select("case_id", "n_candidates", "c.field", "c.value", "c.confidence")
    )


def join_predictions(golden: DataFrame, predictions: DataFrame) -> DataFrame:
    """Left join on case and field; a field nobody predicted is wrong, not skipped."""
    numeric = F.col("field").isin(AMOUNT_FIELDS + RATE_FIELDS)
    pred = predictions.select(
        "case_id", "field", "value", "confidence", F.lit(True).alias("predicted")
    )
    joined = golden.join(pred, ["case_id", "field"], "left")
    ok = F.coalesce("predicted", F.lit(False)) & matches(F.col("value"), F.col("expected"), numeric)
    return joined.withColumn("predicted", F.coalesce("predicted", F.lit(False))).withColumn(
        "correct", ok
    )


def band_of(confidence: Column, bands=CALIBRATION_BANDS) -> Column:
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(bands))):
        out = F.when((confidence >= lo) & (confidence < hi), F.lit(i)).otherwise(out)
    return out


def calibration(scored: DataFrame, bands=CALIBRATION_BANDS) -> DataFrame:
    """Correct, n and accuracy per confidence band (empty ones too) and over all bands."""
    spark = scored.sparkSession
    table = spark.createDataFrame(
        [(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(bands)],
        "band int, lo double, hi double",
    )
    tally = (
        scored.where("predicted").withColumn("band", band_of(F.col("confidence"), bands))
        .where(F.col("band").isNotNull())
        .groupBy("band").agg(F.count_if("correct").alias("c"), F.count(F.lit(1)).alias("k"))
    )
    rows = table.join(tally, "band", "left")
    total = rows.rollup("band", "lo", "hi").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("correct"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"),
        F.grouping_id().alias("gid"),
    )
    return total.where("gid in (0, 7)").select(
        F.when(F.col("gid") == 7, F.lit("all")).otherwise(
            F.format_string("%.2f-%.2f", "lo", F.least(F.col("hi"), F.lit(1.0)))
        ).alias("band"),
        "correct", "n", F.round(F.try_divide("correct", "n"), 6).alias("accuracy"),
    )


def accuracy_report(scored: DataFrame, strata) -> DataFrame:
    """Share correct overall and per value of each stratum: (dimension, level, correct, n, accuracy)."""
    sets = [F.col(s) for s in strata]
    grouped = scored.groupingSets([[], *[[s] for s in sets]], *sets).agg(
        F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("n"),
        F.grouping_id().alias("gid"),
    )
    full = 2 ** len(strata) - 1
    dimension, level = F.lit("all"), F.lit("all")
    for i, s in enumerate(strata):
        here = F.col("gid") == full - 2 ** (len(strata) - 1 - i)
        dimension = F.when(here, F.lit(s)).otherwise(dimension)
        level = F.when(here, F.col(s).cast("string")).otherwise(level)
    return grouped.select(
        dimension.alias("dimension"), level.alias("level"), "correct", "n",
        F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"),
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields of two scored runs side by side, counted by what changed."""
    left = a.select("case_id", "field", F.col("correct").alias("ca"), F.col("value").alias("va"))
    right = b.select("case_id", "field", F.col("correct").alias("cb"), F.col("value").alias("vb"))
    both = left.join(right, ["case_id", "field"], "full_outer")
    ca, cb = F.coalesce("ca", F.lit(False)), F.coalesce("cb", F.lit(False))
    change = (
        F.when(ca & cb, F.lit("both_right"))
        .when(~ca & cb, F.lit("gained"))
        .when(ca & ~cb, F.lit("lost"))
        .when(F.col("va").eqNullSafe(F.col("vb")), F.lit("both_wrong_same"))
        .otherwise(F.lit("both_wrong_changed"))
    )
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def response_health(chunks: DataFrame) -> DataFrame:
    """Failed, valid and candidate counts over (chunk_id, failed, ok, n_candidates)."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("failed").alias("failed"),
        F.count_if(~F.col("failed") & F.col("ok")).alias("valid"),
        F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("candidates"),
    )


def confidence_spread(confidences: DataFrame, column: str = "confidence") -> DataFrame:
    """Smallest, upper-median and largest confidence, and whether all are the same.

    The upper median is the value at 0-based rank ``n div 2``, found by counting ranges of values, so
    no task sorts them all.  Nulls do not count.
    """
    # The key is one value, told from the data so that the rows stay a group like any other.
    held = confidences.select(F.when(F.col(column).isNotNull(), F.lit(0)).alias("all"), F.col(column).alias("v")).where("v is not null")
    half = held.groupBy("all").agg(F.floor(F.count(F.lit(1)) / 2).cast("long").alias("rank"))
    mid = values_at(held, ["all"], "v", half).agg(F.max("value")).scalar()
    return held.agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
        (F.min("v") == F.max("v")).alias("flat"),
    ).select("n", "min", mid.alias("p50"), "max", "flat")


def stage_timing(rows: DataFrame, keys, seconds: str, error: str) -> DataFrame:
    """Rows, mean, min and max seconds per key, failed rows left out."""
    return rows.where(F.col(error).isNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"), F.round(F.avg(seconds), 6).alias("mean_s"),
        F.min(seconds).alias("min_s"), F.max(seconds).alias("max_s"),
    )


def speed_comparison(pages: DataFrame, run: str) -> DataFrame:
    """Per run: page count, failures, mean stage times over completed pages, ratio to the slowest.

    ``pages``: run, rasterise_s, stage1_s, stage2_s (null = not completed), stage1_failed; where it
    has them, also when, commit, peak_vram_mib and vram_total_mib of the run, which become
    ``measured`` (to the minute), ``commit``, ``peak_gb`` and ``memory_gb``.
    """
    done = F.col("stage2_s").isNotNull()

    def mean(c):
        return F.avg(F.when(done, c))

    total = F.col("rasterise_s") + F.col("stage1_s") + F.col("stage2_s")
    notes = {
        "measured": ("when", lambda c: F.replace(F.left(c, F.lit(16)), F.lit("T"), F.lit(" "))),
        "commit": ("commit", lambda c: c),
        "peak_gb": ("peak_vram_mib", lambda c: F.round(c / 1024, 6)),
        "memory_gb": ("vram_total_mib", lambda c: F.round(c / 1024, 6)),
    }
    notes = {name: make(F.max(c)).alias(name) for name, (c, make) in notes.items() if c in pages.columns}
    per_run = pages.groupBy(run).agg(
        *notes.values(),
        F.count(F.lit(1)).alias("pages"),
        F.count_if("stage1_failed").alias("failed"),
        mean(F.col("stage1_s")).alias("stage1"),
        mean(F.col("stage2_s")).alias("stage2"),
        mean(total).alias("total"),
    )
    slowest = per_run.agg(F.max("total")).scalar()
    return per_run.select(
        run, *notes, "pages", "failed", F.round("stage1", 6).alias("stage1_s"),
        F.round("stage2", 6).alias("stage2_s"), F.round("total", 6).alias("total_s"),
        F.round(10 * F.col("total"), 6).alias("ten_pages_s"),
        F.round(F.try_divide(slowest, F.col("total")), 6).alias("times_faster"),
    )


def concurrency_summary(
    rows: DataFrame, level: str, deadline_s: float = 600.0, chunk_pages: tuple[int, int] = (10, 40)
) -> DataFrame:
    """Per level: pages, errors, failures, pages per minute, means, p95, ratio to the first level.

    ``rows``: level, wall_s (same on a level), total_s, failed, error, and where known stage1_s,
    stage2_s and peak_vram_mib.  ``small_chunk_s`` and ``large_chunk_s`` are the times of chunks of
    ``chunk_pages`` pages; ``fits`` says whether the larger stays inside the deadline; ``best`` and
    ``largest_fit`` mark the chosen levels.  The 95th percentile is exact and found by counting
    ranges of values, so no level's rows are held together.
    """
    good = F.col("error").isNull() & ~F.col("failed")
    small, large = chunk_pages
    stages = [c for c in ("stage1_s", "stage2_s") if c in rows.columns]
    peak = [(F.max("peak_vram_mib") / 1024).alias("peak_gb")] if "peak_vram_mib" in rows.columns else []
    per = rows.groupBy(level).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if("failed").alias("failed"),
        F.max("wall_s").alias("wall_s"),
        F.avg(F.when(good, F.col("total_s"))).alias("mean_s"),
        *[F.avg(F.when(good, F.col(c))).alias(c) for c in stages], *peak,
    )
    p95 = quantiles(rows.where(good), [level], "total_s", 0.95, "p95_s").withColumnRenamed(level, "__level")
    rate = settle(per.join(p95, per[level].eqNullSafe(p95["__level"]), "left").drop("__level").withColumn(
        "per_min", 60 * F.col("pages") / F.col("wall_s")).withColumn("fits", large * F.col("mean_s") <= deadline_s))
    first_rate = rate.agg(F.min_by("per_min", level)).scalar()
    best = rate.agg(F.max(F.struct("per_min", -F.col(level)))).scalar()
    largest = rate.agg(F.max(F.when(F.col("fits"), F.col(level)))).scalar()
    rounded = lambda c, name: F.round(c, 6).alias(name)
    return rate.select(
        level, "pages", "errors", "failed", rounded(F.col("wall_s"), "wall_s"),
        rounded(F.col("per_min"), "pages_per_min"), rounded(F.col("mean_s"), "mean_s"), rounded(F.col("p95_s"), "p95_s"),
        *[rounded(F.col(c), c) for c in (*stages, *(["peak_gb"] if peak else []))],
        rounded(small * F.col("mean_s"), "small_chunk_s"), rounded(large * F.col("mean_s"), "large_chunk_s"),
        rounded(F.col("per_min") / first_rate, "ratio_to_first"),
        F.coalesce("fits", F.lit(False)).alias("fits"),
        (F.struct("per_min", -F.col(level)) == best).alias("best"),
        F.col(level).eqNullSafe(largest).alias("largest_fit"),
    )


def guard_audit(audit: DataFrame) -> DataFrame:
    """Decisions per step and reason."""
    return audit.groupBy("step", "attached", "reason").agg(F.count(F.lit(1)).alias("n"))

