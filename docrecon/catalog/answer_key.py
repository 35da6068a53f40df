"""Scoring queries: labels as the answer key, rules over documents as predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrecon.catalog.registry import query, table
from docrecon.functions.fields import match_field
from docrecon.operators import scoring

# Answer key: two fields per labelled document; toxic is open (TODO) for the low-quality ones.
GOLD_SQL = """gold as (
  select l.doc_id as case_id, lang, source, 'vatRate' as field, quality::varchar as expected
    from labels l join documents d on d.doc_id = l.doc_id
  union all select l.doc_id, lang, source, 'documentType', case when quality = 0 and n_chars > 800
      then 'TODO' when toxic = 1 then ' Toxic' else null end
    from labels l join documents d on d.doc_id = l.doc_id
  union all select l.doc_id, lang, source, 'originalTotal', n_chars::varchar
    from labels l join documents d on d.doc_id = l.doc_id where quality = 1)"""


def golden(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "n_chars")
    lab = table(spark, d, "labels").join(docs, "doc_id")
    kind = F.when((F.col("quality") == 0) & (F.col("n_chars") > 800), F.lit("TODO")).when(
        F.col("toxic") == 1, F.lit(" Toxic")
    )
    base = F.create_map(
        F.lit("vatRate"), F.col("quality").cast("string"), F.lit("documentType"), kind
    )
    total = F.create_map(F.lit("originalTotal"), F.col("n_chars").cast("string"))
    fields = F.when(F.col("quality") == 1, F.map_concat(base, total)).otherwise(base)
    cases = lab.select(
        F.col("doc_id").alias("case_id"), "lang", "source", fields.alias("fields")
    )
    return scoring.golden_long(cases)


PRED_SQL = """rule as (select doc_id, case when n_chars > 9000 then 2 else 1 end as k, n_chars, text,
    (n_chars % 100) / 100.0 as conf from documents),
  pred as (select doc_id as case_id, 'vatRate' as field, case when n_chars > 500 then '1' else '0' end
      as value, conf as confidence from rule where k = 1
    union all select doc_id, 'documentType', case when contains(lower(text), 'hat') then 'toxic' end, conf
      from rule where k = 1
    union all select doc_id, 'originalTotal', printf('%.2f', case when n_chars % 5 = 0 then n_chars + 1.0
      else n_chars::double end), 0.97 from rule where k = 1),
  pred_b as (select doc_id as case_id, 'vatRate' as field, case when n_chars > 700 then '1' else '0' end
      as value from rule where k = 1
    union all select doc_id, 'documentType', null from rule where k = 1
    union all select doc_id, 'originalTotal', n_chars::varchar from rule where k = 1)"""


def _rule_cells(spark, d, cut, second=False):
    """Candidates with cells; a very long document comes back split in two."""
    docs = table(spark, d, "documents", "doc_id", "text", "n_chars")
    n = F.col("n_chars")
    conf = (n % 100) / F.lit(100.0)
    kind = F.when(F.contains(F.lower("text"), F.lit("hat")) & F.lit(not second), F.lit("toxic"))
    shown = n if second else F.when(n % 5 == 0, n + 1).otherwise(n)

    def cell(value, c):
        return F.struct(value.alias("value"), c.alias("confidence"))

    copies = F.when(n > 9000, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cells = docs.select(
        F.col("doc_id").alias("case_id"), copies.alias("copies"),
        cell(F.when(n > cut, F.lit(1)).otherwise(F.lit(0)), conf).alias("vatRate"),
        cell(kind, conf).alias("documentType"),
        cell(shown.cast("double"), F.lit(0.97)).alias("originalTotal"),
    )
    return cells.withColumn("copy", F.explode("copies"))


def predictions(spark, d, cut=500, second=False):
    bills = _rule_cells(spark, d, cut, second)
    flat = scoring.flatten_candidates(bills, ["vatRate", "documentType", "originalTotal"])
    return scoring.single_candidate(flat)


def scored(spark, d):
    return scoring.join_predictions(scoring.scorable(golden(spark, d)), predictions(spark, d))


_MATCH = """case when p.value is null or g.expected is null then p.value is null and g.expected is null
    when g.field in ('vatRate', 'originalTotal') and try_cast(p.value as double) is not null
      and try_cast(g.expected as double) is not null
      then abs(p.value::double - g.expected::double) < 0.005
    else lower(trim(p.value)) = lower(trim(g.expected)) end"""
_SCORED = f"""scored as (select g.*, p.value, p.confidence, p.case_id is not null as predicted,
     p.case_id is not null and {_MATCH} as correct
   from gold g left join pred p on p.case_id = g.case_id and p.field = g.field
   where g.expected is null or g.expected <> 'TODO')"""


@query(
    "golden_fields",
    f"with {GOLD_SQL} select case_id, field, expected from gold",
)
def golden_fields(spark, d):
    return golden(spark, d).select("case_id", "field", "expected")


@query(
    "golden_scorable",
    f"""with {GOLD_SQL} select case_id, field, expected from gold
        where expected is null or expected <> 'TODO'""",
)
def golden_scorable(spark, d):
    return scoring.scorable(golden(spark, d)).select("case_id", "field", "expected")


@query(
    "golden_todo",
    f"""with {GOLD_SQL}, t as (select case_id, count(*) filter (where expected is distinct from 'TODO')::bigint
      as filled, count(*) filter (where expected = 'TODO')::bigint as todo,
      string_agg(case when expected = 'TODO' then field end, ', ') as open_fields
      from gold group by rollup (case_id))
    select case_id, filled, todo, case when case_id is null then null else open_fields end as open_fields
    from t""",
)
def golden_todo(spark, d):
    long = golden(spark, d)
    report = scoring.todo_report(long)
    return report.join(scoring.open_fields(long), "case_id", "left")


@query(
    "flatten_predictions",
    f"with {PRED_SQL} select case_id, field, value from pred",
)
def flatten_predictions(spark, d):
    return predictions(spark, d).select("case_id", "field", "value")


@query(
    "field_match",
    f"""with {GOLD_SQL}, {PRED_SQL}, {_SCORED}
        select case_id, field, predicted, correct from scored""",
)
def field_match(spark, d):
    return scored(spark, d).select("case_id", "field", "predicted", "correct")


@query(
    "number_match",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      abs(l_extendedprice - round(l_extendedprice)) < 0.005 as amount_ok,
      l_returnflag = 'A' as text_ok, l_tax is null as null_ok from lineitem""",
)
def number_match(spark, d):
    li = table(spark, d, "lineitem")
    whole = F.round("l_extendedprice").cast("long").cast("string")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        match_field("vat", F.col("l_extendedprice").cast("string"), whole).alias("amount_ok"),
        match_field("documentType", F.concat(F.lit(" "), F.lower("l_returnflag")), F.lit("A")).alias(
            "text_ok"
        ),
        match_field("vat", F.col("l_tax").cast("string"), F.lit(None).cast("string")).alias("null_ok"),
    )


@query(
    "calibration_bands",
    f"""with {GOLD_SQL}, {PRED_SQL}, {_SCORED},
    bands(i, lo, hi, band) as (values (0, 0.0, 0.5, '0.00-0.50'), (1, 0.5, 0.8, '0.50-0.80'),
       (2, 0.8, 0.95, '0.80-0.95'), (3, 0.95, 1.01, '0.95-1.00')),
    r as (select band, s.correct, s.case_id from bands left join scored s on s.predicted
       and s.confidence >= lo and s.confidence < hi)
    select coalesce(band, 'all') as band, count(*) filter (where correct)::bigint as correct,
      count(case_id)::bigint as n,
      round(count(*) filter (where correct) / nullif(count(case_id), 0), 6) as accuracy
    from r group by rollup (band)""",
)
def calibration_bands(spark, d):
    return scoring.calibration(scored(spark, d))


@query(
    "accuracy_grouping_sets",
    f"""with {GOLD_SQL}, {PRED_SQL}, {_SCORED}
    select case when grouping(field) = 0 then 'field' when grouping(lang) = 0 then 'lang'
        when grouping(source) = 0 then 'source' else 'all' end as dimension,
      coalesce(field, lang, source, 'all') as level, count(*) filter (where correct)::bigint as correct,
      count(*)::bigint as n, round(count(*) filter (where correct) / count(*), 6) as accuracy
    from scored group by grouping sets ((), (field), (lang), (source))""",
)
def accuracy_grouping_sets(spark, d):
    return scoring.accuracy_report(scored(spark, d), ["field", "lang", "source"])


@query(
    "run_compare",
    f"""with {GOLD_SQL}, {PRED_SQL}, {_SCORED},
    scored_b as (select g.case_id, g.field, p.value, p.case_id is not null and {_MATCH} as correct
       from gold g left join pred_b p on p.case_id = g.case_id and p.field = g.field
       where g.expected is null or g.expected <> 'TODO')
    select case when a.correct and b.correct then 'both_right' when b.correct then 'gained'
       when a.correct then 'lost' when a.value is not distinct from b.value then 'both_wrong_same'
       else 'both_wrong_changed' end as change, count(*)::bigint as n
    from scored a full join scored_b b on a.case_id = b.case_id and a.field = b.field group by change""",
)
def run_compare(spark, d):
    gold = scoring.scorable(golden(spark, d))
    b = scoring.join_predictions(gold, predictions(spark, d, 700, True))
    return scoring.compare_runs(scored(spark, d), b)
