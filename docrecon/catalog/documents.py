"""Text, identifier and amount queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrecon.catalog.demo import LOOSE, OWN, PROSE
from docrecon.catalog.registry import query, table
from docrecon.functions import ids, money, text
from docrecon.functions.udfs import nfkc
from docrecon.operators import readings
from docrecon.operators.assemble import apply_party_constant
from docrecon.profile import ACCOUNT_LIKE, AMOUNT, LUHN_16, Profile

DEFAULT = Profile()

SEGS = r"""list_filter(list_transform(regexp_split_to_array(text, '<[^>]+>|\n'),
      lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 8)"""
RATIO = "(case when len(segs) = 0 then 1.0 else len(list_distinct(segs)) / len(segs) end)"
AT = "(length(text) - length(replace(text, '@', '')))"


@query(
    "page_quality_triage",
    f"""
    with s as (select source, text, {SEGS} as segs from documents),
    v as (select source, len(segs) as n, {RATIO} as ratio,
            case when text is null or length(text) < 80 then 'empty'
                 when {AT} > 10 then 'at_burst'
                 when len(segs) >= 12 and {RATIO} <= 0.35 then 'loop'
                 else 'ok' end as verdict from s)
    select source, verdict, count(*)::bigint as pages, sum(n)::bigint as segments,
           round(avg(ratio), 6) as mean_ratio
    from v group by source, verdict
    """,
)
def page_quality_triage(spark, d):
    docs = table(spark, d, "documents", "source", "text")
    t = F.col("text")
    score = docs.select("source", "text", text.repeat_score(t).alias("s"))
    verdict = F.coalesce(
        text.early_verdict(t, DEFAULT),
        F.when(text.looping(F.col("s.ratio"), F.col("s.n"), DEFAULT), F.lit("loop")),
        F.lit("ok"),
    )
    return (
        score.select("source", verdict.alias("verdict"), "s.n", "s.ratio")
        .groupBy("source", "verdict")
        .agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("segments"),
             F.round(F.avg("ratio"), 6).alias("mean_ratio"))
    )


@query("page_verdicts")
def page_verdicts(spark, d):
    """Full verdict with compression; DuckDB has no zlib, so rows only."""
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    out = readings.with_verdict(docs, "text", DEFAULT)
    return out.select(
        "doc_id", "source", "verdict",
        text.worth_rereading(F.col("verdict")).alias("worth_rereading"),
    )


@query(
    "segment_repeat_stats",
    f"""
    with s as (select doc_id, {SEGS} as segs from documents)
    select doc_id, len(segs)::int as segments, len(list_distinct(segs))::int as distinct_segments,
           round({RATIO}, 6) as ratio from s
    """,
)
def segment_repeat_stats(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    segs = docs.select("doc_id", text.segments(F.col("text")).alias("segs"))
    n, k = F.size("segs"), F.size(F.array_distinct("segs"))
    return segs.select(
        "doc_id", n.alias("segments"), k.alias("distinct_segments"),
        F.round(F.when(n == 0, F.lit(1.0)).otherwise(k / n), 6).alias("ratio"),
    )


@query(
    "short_or_burst_pages",
    f"""
    select doc_id, length(text)::int as chars, {AT}::int as at_signs,
           (text is null or length(text) < 80 or {AT} > 10) as failed
    from documents
    """,
)
def short_or_burst_pages(spark, d):
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.length(t).alias("chars"), text.count_of(t, "@").alias("at_signs"),
        text.looks_failed(t, DEFAULT).alias("failed"),
    )


def _count_sql(markers, column="text"):
    return " + ".join(f"contains({column}, '{m}')::int" for m in markers)


@query(
    "marker_page_classes",
    f"""
    with h as (select conv_id, turn,
        {_count_sql(PROSE.certificate_markers)} as certificate_hits,
        {_count_sql(PROSE.card_markers)} as card_hits,
        {_count_sql(PROSE.slip_markers)}
          + (({_count_sql(PROSE.bank_markers)}) > 0)::int as slip_hits,
        {_count_sql(PROSE.toll_markers)}
          + contains(regexp_replace(text, '\\s+', '', 'g'), 'theof')::int as toll_hits
        from conversations)
    select conv_id, turn, certificate_hits::int as certificate_hits,
           certificate_hits >= 2 as is_certificate, card_hits >= 2 as is_card,
           slip_hits >= 2 as is_slip, toll_hits >= 1 as is_toll
    from h
    """,
)
def marker_page_classes(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn",
        text.marker_count(t, PROSE.certificate_markers).alias("certificate_hits"),
        text.is_certificate(t, PROSE).alias("is_certificate"),
        text.is_id_card(t, PROSE).alias("is_card"),
        text.is_transfer_slip(t, PROSE).alias("is_slip"),
        text.is_toll_page(t, PROSE).alias("is_toll"),
    )


@query(
    "role_headings",
    r"""
    with c as (select doc_id, regexp_replace(text, 'Apache\s*License,\s*Version', ' ', 'g') as t
               from documents),
    f as (select doc_id, contains(t, 'Licensed') or contains(t, 'Version') as receipt,
                 contains(t, 'token') as invoice, contains(t, '+1 (') as cash,
                 (contains(t, 'mail') or contains(t, '@'))
                   and not (contains(t, 'Licensed') or contains(t, 'token')) as english from c)
    select doc_id, concat_ws(',', case when receipt then 'receipt' end,
        case when invoice then 'tax_invoice' end,
        case when cash or english then 'cash_bill' end) as roles
    from f
    """,
)
def role_headings(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.array_join(text.roles_for_page(F.col("text"), PROSE), ",").alias("roles")
    )


@query(
    "labelled_headings",
    r"""
    select page_id,
      nullif(trim(regexp_replace(regexp_extract(html, '<h1>\s*([^<]+)', 1), '\s+', ' ', 'g')), '')
        as heading,
      nullif(trim(regexp_replace(regexp_extract(html, '<title>\s*([^<]+)', 1), '\s+', ' ', 'g')), '')
        as title
    from pages
    """,
)
def labelled_headings(spark, d):
    h = F.col("html")
    return table(spark, d, "pages", "page_id", "html").select(
        "page_id",
        text.labelled_value(h, r"<h1>\s*([^<]+)").alias("heading"),
        text.labelled_value(h, r"<title>\s*([^<]+)").alias("title"),
    )


@query(
    "page_markers",
    r"""
    with m as (select page_id,
        regexp_extract_all(url, '/([0-9]{1,2})\?page=([0-9]{1,2})', 1) as a,
        regexp_extract_all(url, '/([0-9]{1,2})\?page=([0-9]{1,2})', 2) as b from pages),
    z as (select page_id, list_filter(list_zip(list_transform(a, lambda x: x::int),
             list_transform(b, lambda x: x::int)),
             lambda p: p[2] > 1 and p[1] between 1 and p[2] and p[2] <= 20) as good from m)
    select page_id, good[1][1] as page, good[1][2] as of_pages from z
    """,
)
def page_markers(spark, d):
    marker = text.page_marker(F.col("url"), PROSE.page_marker)
    return table(spark, d, "pages", "page_id", "url").select("page_id", marker.alias("m")).select(
        "page_id", F.col("m.page").alias("page"), F.col("m.of").alias("of_pages")
    )


_DOC_NO = (
    r"coalesce(nullif(regexp_extract(text, '555-[0-9]{4}', 0), ''),"
    r" nullif(regexp_extract(text, '[0-9]{16}', 0), ''),"
    r" nullif(regexp_extract(text, '[A-Z][a-z]+', 0), ''))"
)


@query(
    "labelled_document_number",
    rf"""
    with v as (select doc_id, text, {_DOC_NO} as val from documents),
    p as (select doc_id, text, val, case when val is null then []
            else string_split(replace(text, val, chr(1)), chr(1)) end as parts from v),
    b as (select doc_id, val, contains(text, val) as on_page, list_transform(
            range(1, len(parts)), lambda i: right(replace(
              array_to_string(list_slice(parts, 1, i), chr(1)), chr(1), val), 60)) as befores
          from p)
    select doc_id, val as stated,
      case when not regexp_matches(val, '[0-9]') then null
           when not on_page then val
           when len(list_filter(befores, lambda s:
                regexp_matches(s, '(?i)(\+1 \([0-9]{{3}}\)|of|and|de|die|le|en)[\s:.]*$')
                and not regexp_matches(s, '(?i)(by the|on the|of the)[\s:.]*$'))) > 0 then val
           end as kept
    from b
    """,
)
def labelled_document_number(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").withColumn("val", F.expr(_DOC_NO))
    return docs.select(
        "doc_id", F.col("val").alias("stated"),
        text.clean_document_number(F.col("val"), F.col("text"), PROSE).alias("kept"),
    )


@query(
    "account_like_mask",
    r"""
    select doc_id, trim(regexp_replace(right(text, 60), '\s+', ' ', 'g')) as stated,
      case when not regexp_matches(right(text, 60), '[0-9Xx*•]{4,}')
           then nullif(trim(regexp_replace(right(text, 60), '\s+', ' ', 'g')), '') end as kept
    from documents
    """,
)
def account_like_mask(spark, d):
    method = text.squeeze(F.right("text", F.lit(60)))
    return table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", method.alias("stated"),
        text.clean_payment_method(method, ACCOUNT_LIKE).alias("kept"),
    )


@query(
    "party_constant",
    """
    with n as (select doc_id, (contains(lower(text), 'apache license') or
        contains(lower(text), '@mail') or contains(lower(text), '555-')) as named from documents)
    select doc_id, named, case when named then 'Example Holdings' end as buyer_name,
           case when named then '0000000000000' end as buyer_id,
           (case when named then 1.0 else 0.0 end)::double as confidence
    from n
    """,
)
def party_constant(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    out = apply_party_constant(docs, F.col("text"), OWN)
    return out.select(
        "doc_id", text.names_party(F.col("text"), OWN.evidence).alias("named"),
        F.col("buyerName.value").alias("buyer_name"), F.col("buyerTaxId.value").alias("buyer_id"),
        F.col("buyerName.confidence").alias("confidence"),
    )


_RUN = r"coalesce(nullif(regexp_extract(text, '[0-9][0-9 ()+-]{9,}[0-9]', 0), ''), 'none')"


@query(
    "clean_tax_ids",
    rf"""
    with v as (select doc_id, {_RUN} as stated from documents),
    g as (select doc_id, stated, regexp_replace(stated, '[^0-9]', '', 'g') as digits from v)
    select doc_id, stated, case when length(digits) = 16 then digits end as cleaned,
      case when length(digits) = 16 and digits <> '4316522678525456' then digits end as not_ours
    from g
    """,
)
def clean_tax_ids(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.expr(_RUN).alias("stated")
    )
    v = F.col("stated")
    return docs.select(
        "doc_id", "stated", ids.clean_tax_id(v, 16).alias("cleaned"),
        ids.clean_tax_id(v, 16, "4316522678525456").alias("not_ours"),
    )


@query(
    "amount_extract",
    r"""
    with a as (select doc_id, list_filter(list_transform(
          regexp_extract_all(text, '[0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2}'),
          lambda x: replace(x, ',', '')::double), lambda v: v > 0) as found from documents),
    o as (select doc_id, list_filter(found, lambda v, i: list_position(found, v) = i) as amounts
          from a)
    select doc_id, len(amounts)::int as n,
           array_to_string(list_transform(amounts, lambda v: printf('%.2f', v)), ' ') as amounts
    from o
    """,
)
def amount_extract(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", money.extract_amounts(F.col("text"), AMOUNT).alias("a")
    )
    return docs.select(
        "doc_id", F.size("a").alias("n"),
        F.array_join(F.transform("a", lambda v: F.format_string("%.2f", v)), " ").alias("amounts"),
    )


_LUHN_SQL = """(10 - list_sum(list_transform(range(1, 16), lambda i:
   case when i % 2 = 1 then (substr(id, i, 1)::int * 2) - (case when substr(id, i, 1)::int > 4
        then 9 else 0 end) else substr(id, i, 1)::int end)) % 10) % 10 = substr(id, 16, 1)::int"""
_IDS_SQL = r"""list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'),
   lambda w: regexp_full_match(w, '[0-9]{16}'))"""


@query(
    "id_check_digit",
    f"""
    with w as (select doc_id, unnest({_IDS_SQL}) as id from documents)
    select doc_id, id, {_LUHN_SQL} as valid, count(*)::bigint as seen
    from w group by doc_id, id
    """,
)
def id_check_digit(spark, d):
    found = table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.explode(ids.extract_ids(F.col("text"), 16)).alias("id")
    )
    return found.groupBy(
        "doc_id", "id", ids.check_digit_valid(F.col("id"), LUHN_16).alias("valid")
    ).agg(F.count(F.lit(1)).alias("seen"))


@query(
    "single_valid_id",
    f"""
    with w as (select doc_id, {_IDS_SQL} as found from documents),
    v as (select doc_id, len(found) as printed, list_distinct(list_filter(found, lambda id:
            {_LUHN_SQL} and id <> '4316522678525456')) as good from w)
    select doc_id, printed::int as printed,
           case when len(good) = 1 then good[1] end as only_id from v
    """,
)
def single_valid_id(spark, d):
    found = table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", ids.extract_ids(F.col("text"), 16).alias("found")
    )
    return found.select(
        "doc_id", F.size("found").alias("printed"),
        ids.single_valid_id(F.col("found"), LUHN_16, "4316522678525456").alias("only_id"),
    )


@query(
    "spaced_ids",
    r"""
    with w as (select doc_id, list_transform(
          regexp_extract_all(concat(' ', replace(text, ' ', '  ')), '[^\p{L}\p{N}_]([0-9](?:[ \t-]*[0-9]){15})(?:[^0-9]|$)', 1),
          lambda s: regexp_replace(s, '[^0-9]', '', 'g')) as found from documents)
    select doc_id, array_to_string(list_distinct(found), ' ') as found from w where len(found) = 1
    """,
)
def spaced_ids(spark, d):
    found = table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", ids.extract_spaced_ids(F.col("text"), 16).alias("found")
    )
    return found.where(F.size("found") == 1).select("doc_id", F.array_join("found", " ").alias("found"))


@query(
    "single_amount_excluding",
    r"""
    with a as (select doc_id,
        list_distinct(regexp_extract_all(text, '([0-9,]+\.[0-9]{1,2})', 1)) as amounts,
        regexp_extract_all(text, '[0-9]\.([0-9]+\.[0-9]{1,2})', 1) as fees from documents),
    k as (select doc_id, list_distinct(list_filter(list_transform(list_filter(amounts,
          lambda x: not list_contains(fees, x)), lambda x: try_cast(replace(x, ',', '') as double)),
          lambda v: v > 0)) as vals from a)
    select doc_id, case when len(vals) = 1 then vals[1] end as amount from k
    """,
)
def single_amount_excluding(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select(
        "doc_id",
        money.single_amount_excluding(
            F.col("text"), r"([0-9,]+\.[0-9]{1,2})", r"[0-9]\.([0-9]+\.[0-9]{1,2})"
        ).alias("amount"),
    )


@query("unicode_normal_form")
def unicode_normal_form(spark, d):
    """Rows whose compatibility form differs, per language; DuckDB has no such function."""
    docs = table(spark, d, "documents", "lang", "text")
    changed = F.lower(nfkc(F.col("text"))) != F.lower("text")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(changed).alias("changed")
    )


_V = f"""(case when length(text) < 120 then 'empty'
      when {AT} > 10 then 'at_burst' when len(segs) >= 2 then 'loop' end)"""


@query(
    "best_reading",
    f"""
    with r as (select conv_id, turn, text, {SEGS} as segs from conversations),
    v as (select conv_id, turn, text, {_V} as verdict from r),
    f as (select conv_id, arg_min({{'t': turn, 'x': text, 'v': verdict}}, turn) as first,
          arg_min({{'t': turn, 'x': text, 'v': verdict}}, turn) filter (where verdict is null)
            as clean, count(*) as attempts from v group by conv_id),
    c as (select conv_id, attempts, case when first.v = 'loop' and clean is not null
          then clean else first end as c from f)
    select conv_id, c.t as attempt, length(c.x)::int as chars, c.v as verdict from c
    """,
)
def best_reading(spark, d):
    """Turns of a conversation as repeated readings of one page; the loop test without zlib."""
    t = F.col("text")
    rows = table(spark, d, "conversations", "conv_id", "turn", "text")
    scored = rows.withColumn("s", text.repeat_score(t))
    verdict = F.coalesce(
        text.early_verdict(t, LOOSE),
        F.when(text.looping(F.col("s.ratio"), F.col("s.n"), LOOSE), F.lit("loop")),
    )
    tries = scored.select("conv_id", F.col("turn").alias("attempt"), "text", verdict.alias("verdict"))
    best = readings.best_reading(tries, ["conv_id"])
    return best.select("conv_id", "attempt", F.length("text").alias("chars"), "verdict")
