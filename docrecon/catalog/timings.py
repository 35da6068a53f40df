"""Timing and health reports with events as measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrecon.catalog.registry import query, table
from docrecon.operators import readings, scoring


@query(
    "stage_timing",
    """select event_type as model, count(*)::bigint as pages, round(avg(value), 6) as mean_s,
         min(value) as min_s, max(value) as max_s from events where value <= 150 group by event_type""",
)
def stage_timing(spark, d):
    e = table(spark, d, "events", "event_type", "value").select(
        F.col("event_type").alias("model"), "value",
        F.when(F.col("value") > 150, F.lit("timeout")).alias("error"),
    )
    return scoring.stage_timing(e, ["model"], "value", "error")


@query(
    "speed_ratio",
    """
    with p as (select user_id as run, value < 5 as failed, 0.1 as r, value as s1, ts, event_type,
         case when value >= 5 then value / 2 end as s2 from events),
    m as (select run, strftime(max(ts), '%Y-%m-%d %H:%M') as measured, max(event_type) as commit,
         round(max(s1) / 1024, 6) as peak_gb, 8.0::double as memory_gb, count(*) as pages, count(*) filter (where failed) as failed,
         avg(s1) filter (where s2 is not null) as s1, avg(s2) as s2,
         avg(r + s1 + s2) filter (where s2 is not null) as total from p group by run)
    select run, measured, commit, peak_gb, memory_gb, pages::bigint as pages, failed::bigint as failed, round(s1, 6) as stage1_s,
      round(s2, 6) as stage2_s, round(total, 6) as total_s, round(10 * total, 6) as ten_pages_s,
      round(max(total) over () / total, 6) as times_faster from m
    """,
)
def speed_ratio(spark, d):
    v = F.col("value")
    e = table(spark, d, "events", "user_id", "value", "ts", "event_type").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("when"), F.col("event_type").alias("commit"),
        v.alias("peak_vram_mib"), F.lit(8192.0).alias("vram_total_mib"),
        F.col("user_id").alias("run"), (v < 5).alias("stage1_failed"), F.lit(0.1).alias("rasterise_s"),
        v.alias("stage1_s"), F.when(v >= 5, v / 2).alias("stage2_s"),
    )
    return scoring.speed_comparison(e, "run")


@query(
    "level_summary",
    """
    with r as (select case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 4
           when 'purchase' then 6 else 8 end as level, value, event_type,
         case when value > 300 then 'late' end as error, value < 1 as failed from events),
    w as (select *, 1000.0 + length(event_type) * 100 as wall from r),
    s as (select level, count(*) as pages, count(error) as errors, count(*) filter (where failed) as failed,
         max(wall) as wall, avg(value) filter (where error is null and not failed) as mean,
         avg(value / 4) filter (where error is null and not failed) as s1,
         avg(value - value / 4) filter (where error is null and not failed) as s2,
         quantile_cont(value, 0.95) filter (where error is null and not failed) as p95 from w group by level),
    t as (select *, 60 * pages / wall as per_min, 40 * mean <= 2000 as fits from s)
    select level, pages::bigint as pages, errors::bigint as errors, failed::bigint as failed,
      round(wall, 6)::double as wall_s, round(per_min, 6) as pages_per_min, round(mean, 6) as mean_s,
      round(p95, 6) as p95_s, round(s1, 6) as stage1_s, round(s2, 6) as stage2_s, 2.0::double as peak_gb,
      round(10 * mean, 6) as small_chunk_s, round(40 * mean, 6) as large_chunk_s, round(per_min / first_value(per_min) over (order by level), 6)
        as ratio_to_first, fits, per_min = max(per_min) over () as best,
      level is not distinct from (select max(level) from t where fits) as largest_fit
    from t
    """,
)
def level_summary(spark, d):
    e = table(spark, d, "events", "event_type", "value")
    kind = F.col("event_type")
    level = (
        F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "signup", 4)
        .when(kind == "purchase", 6).otherwise(8)
    )
    rows = e.select(
        level.alias("level"), (F.lit(1000.0) + F.length(kind) * 100).alias("wall_s"),
        F.col("value").alias("total_s"), (F.col("value") < 1).alias("failed"),
        (F.col("value") / 4).alias("stage1_s"), (F.col("value") - F.col("value") / 4).alias("stage2_s"),
        F.lit(2048.0).alias("peak_vram_mib"),
        F.when(F.col("value") > 300, F.lit("late")).alias("error"),
    )
    return scoring.concurrency_summary(rows, "level", 2000.0)


@query(
    "response_health",
    """with c as (select user_id, bool_or(event_type = 'error' and value > 200) as failed,
         min(value) >= 1 as ok, count(*) filter (where event_type = 'purchase') as k
         from events group by user_id)
    select count(*)::bigint as chunks, count(*) filter (where failed)::bigint as failed,
      count(*) filter (where not failed and ok)::bigint as valid, sum(k)::bigint as candidates from c""",
)
def response_health(spark, d):
    e = table(spark, d, "events", "user_id", "event_type", "value")
    kind = F.col("event_type")
    chunks = e.groupBy("user_id").agg(
        F.bool_or((kind == "error") & (F.col("value") > 200)).alias("failed"),
        (F.min("value") >= 1).alias("ok"), F.count_if(kind == "purchase").alias("n_candidates"),
    )
    return scoring.response_health(chunks)


@query(
    "confidence_spread",
    """with v as (select value, row_number() over (order by value) - 1 as r, count(*) over () as n
         from events)
    select count(*)::bigint as n, min(value) as min, min(value) filter (where r = n // 2) as p50,
      max(value) as max, min(value) = max(value) as flat from v""",
)
def confidence_spread(spark, d):
    return scoring.confidence_spread(table(spark, d, "events", "value"), "value")


@query(
    "first_valid",
    """with a as (select user_id, row_number() over (partition by user_id, cast(ts as date)
           order by ts, event_id) as attempt, cast(ts as date) as day, event_type from events)
    select user_id, strftime(day, '%Y-%m-%d') as day, min(case when event_type <> 'error' then attempt end)::int
      as attempt, count(*)::bigint as attempts from a group by user_id, day""",
)
def first_valid(spark, d):
    """Attempts of one day; an error is an invalid answer."""
    from docrecon.operators.ordered import running_count

    e = table(spark, d, "events", "user_id", "ts", "event_id", "event_type").withColumn(
        "day", F.date_format("ts", "yyyy-MM-dd")
    )
    hour = F.hour("ts").cast("long")
    rows = running_count(e, ["user_id", "day"], ["ts", "event_id"], "n", block=hour).withColumn(
        "attempt", (F.col("n") + 1).cast("int")
    )
    return readings.first_valid(rows, ["user_id", "day"], F.col("event_type") != "error")


@query(
    "slowest_first",
    """select event_id, value from events order by value desc, event_id limit 50""",
)
def slowest_first(spark, d):
    """The fifty slowest pages, slowest first: a top-k report."""
    return table(spark, d, "events", "event_id", "value").orderBy(
        F.col("value").desc(), "event_id"
    ).limit(50)
