"""Field, party and arithmetic queries over orders, lineitem, customer, supplier and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrecon.catalog.demo import OWN, PROSE
from docrecon.catalog.registry import query, table
from docrecon.functions import fields, ids, money, names, text
from docrecon.operators import assemble as asm
from docrecon.operators import categories as cat
from docrecon.operators import checks
from docrecon.operators.contract import contract_errors, json_key_errors
from docrecon.profile import LEGAL_RATE_PERCENTS, MOD11_13, Profile
from docrecon.sources.readers import answer_faults, category_columns, parse_candidates

DEFAULT = Profile()

# Exact sums: decimals until the last step, so both engines agree to the cent.
MONEY_SQL = """money as (
  select l_orderkey as k,
    cast(round(sum(cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(4,2)))), 2)
      as double) as base,
    cast(round(sum(cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(4,2)))
      * cast(l_tax as decimal(4,2))), 2) as double) as tax
  from lineitem group by l_orderkey)"""


def order_money(spark, d):
    """Per order: pre-tax base and tax from its lines."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_tax")
    net = F.col("l_extendedprice").cast("decimal(15,2)") * (
        F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    )
    tax = net * F.col("l_tax").cast("decimal(4,2)")
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.round(F.sum(net), 2).cast("double").alias("base"),
        F.round(F.sum(tax), 2).cast("double").alias("tax"),
    )


# Every order as a bill: total either as printed or, for finished orders, as base plus tax.
BILLS_SQL = f"""{MONEY_SQL},
bills as (select o_orderkey as k, base, tax as vat,
   case when o_orderstatus = 'F' then round(base + tax, 2) else o_totalprice end as total,
   case when o_orderpriority = '1-URGENT' then 0.0
        when o_orderpriority = '2-HIGH' then round(base * 0.03, 2)
        when o_orderpriority = '3-MEDIUM' then round(base * 0.04, 2) end as wht
   from orders left join money on k = o_orderkey)"""


def order_bills(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    m = order_money(spark, d)
    j = o.join(m, o.o_orderkey == m.k, "left")
    pri = F.col("o_orderpriority")
    total = F.when(
        F.col("o_orderstatus") == "F", F.round(F.col("base") + F.col("tax"), 2)
    ).otherwise(F.col("o_totalprice"))
    wht = (
        F.when(pri == "1-URGENT", F.lit(0.0))
        .when(pri == "2-HIGH", F.round(F.col("base") * 0.03, 2))
        .when(pri == "3-MEDIUM", F.round(F.col("base") * 0.04, 2))
    )
    return j.select(
        F.col("o_orderkey").alias("k"), "base", F.col("tax").alias("vat"), total.alias("total"),
        wht.alias("wht"),
    )


def order_cells(spark, d):
    """The same bills with money as cells."""
    b = order_bills(spark, d)
    cells = {"originalTotal": "total", "amountBeforeVat": "base", "vat": "vat", "withholdingTax": "wht"}
    return b.select(
        "k", *[fields.typed_cell(f, F.col(c), 0.8).alias(f) for f, c in cells.items()]
    )


_TOL = "(0.05 + abs({0}) * 1e-4)"
_FINDINGS_SQL = f"""{BILLS_SQL},
gap as (select *, least(abs(wht - round(base * 0.01, 2)), abs(wht - round(base * 0.015, 2)),
     abs(wht - round(base * 0.02, 2)), abs(wht - round(base * 0.03, 2)),
     abs(wht - round(base * 0.05, 2)), abs(wht - round(base * 0.1, 2)),
     abs(wht - round(base * 0.15, 2))) as near from bills),
found as (select *,
   coalesce(abs(base + vat - total) > {_TOL.format('total')}, false) as bad_sum,
   coalesce(vat <> 0 and abs(vat - round(base * 0.07, 2)) > {_TOL.format('base')}, false) as bad_vat,
   coalesce(wht <> 0 and base is not null and near > {_TOL.format('base')}, false) as bad_wht
   from gap)"""


@query(
    "identity_findings",
    f"""with {_FINDINGS_SQL}
    select k, concat_ws(',', case when bad_sum then 'VAT_SUM' end,
      case when bad_vat then 'VAT_RATE' end, case when bad_wht then 'WHT_RATE' end) as findings
    from found""",
)
def identity_findings(spark, d):
    out = checks.check_identities(order_cells(spark, d), DEFAULT)
    return out.select("k", F.array_join("findings", ",").alias("findings"))


@query(
    "distrust_confidence",
    f"""with {_FINDINGS_SQL}
    select k, (case when bad_sum then 0.3 else 0.8 end)::double as total_conf,
      (case when bad_sum or bad_vat or bad_wht then 0.3 else 0.8 end)::double as base_conf,
      (case when bad_sum or bad_vat then 0.3 else 0.8 end)::double as vat_conf,
      (case when bad_wht then 0.3 else 0.8 end)::double as wht_conf
    from found""",
)
def distrust_confidence(spark, d):
    out = checks.distrust(checks.check_identities(order_cells(spark, d), DEFAULT))
    return out.select(
        "k", F.col("originalTotal.confidence").alias("total_conf"),
        F.col("amountBeforeVat.confidence").alias("base_conf"),
        F.col("vat.confidence").alias("vat_conf"),
        F.col("withholdingTax.confidence").alias("wht_conf"),
    )


@query(
    "legal_rate_pairs",
    """
    with v as (select row_number() over () as line, l_orderkey, l_linenumber, l_partkey,
         list_distinct([l_extendedprice, floor(l_extendedprice * l_tax * 100) / 100, l_quantity]) as a
         from lineitem),
    x as (select *, list_filter(a, lambda z: z > 0) as amounts from v),
    p as (select line, l_orderkey, l_linenumber, l_partkey, unnest(amounts) as base, amounts from x),
    t as (select line, l_orderkey, l_linenumber, l_partkey, base, unnest(amounts) as tax from p),
    ok as (select * from t where tax < base and len(list_filter([1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 15.0],
              lambda q: abs(tax / base * 100 - q) < 0.01)) > 0),
    n as (select line, l_orderkey, l_linenumber, l_partkey, count(distinct base) as bases,
            min(base) as base, count(*) as pairs, min(tax) as tax from ok group by all)
    select l_orderkey, l_linenumber, l_partkey, base, tax, round(tax / base * 100, 2) as rate
    from n where bases = 1 and pairs = 1
    """,
)
def legal_rate_pairs(spark, d):
    """Price, tax and quantity of a line as the amounts of one certificate."""
    li = table(
        spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        "l_quantity", "l_tax",
    )
    listed = F.filter(
        F.array_distinct(
            F.array(
                F.col("l_extendedprice"),
                F.floor(F.col("l_extendedprice") * F.col("l_tax") * 100) / 100,
                F.col("l_quantity"),
            )
        ),
        lambda v: v > 0,
    )
    found = money.base_and_tax(listed, LEGAL_RATE_PERCENTS)
    rows = li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.explode(F.array_compact(F.array(found))).alias("c"),
    )
    # The SQL states the case of a single pair; with several the order of amounts decides.
    return rows.where("c.fits = 1").select(
        "l_orderkey", "l_linenumber", "l_partkey", "c.base", "c.tax", "c.rate"
    )


@query(
    "money_equal",
    """
    select event_id, abs(value - floor(value)) < 0.01 as strict,
           abs(value - floor(value)) <= 0.05 as inclusive from events
    """,
)
def money_equal(spark, d):
    v, w = F.col("value"), F.floor("value")
    return table(spark, d, "events", "event_id", "value").select(
        "event_id", money.money_equal(v, w, 0.01, False).alias("strict"),
        money.money_equal(v, w, 0.05, True).alias("inclusive"),
    )


@query(
    "legal_rates",
    """
    select l_tax, len(list_filter([1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 15.0],
        lambda q: abs(l_tax * 100 - q) < 0.01)) > 0 as legal, count(*)::bigint as lines
    from lineitem group by l_tax
    """,
)
def legal_rates(spark, d):
    legal = money.is_legal_rate(F.col("l_tax") * 100, LEGAL_RATE_PERCENTS)
    return table(spark, d, "lineitem", "l_tax").groupBy("l_tax", legal.alias("legal")).agg(
        F.count(F.lit(1)).alias("lines")
    )


@query(
    "tolerances",
    "select o_orderkey, round(0.05 + abs(o_totalprice) * 1e-4, 6) as tolerance from orders",
)
def tolerances(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey", F.round(money.tolerance(F.col("o_totalprice")), 6).alias("tolerance")
    )


_STATED_SQL = """stated as (select o_orderkey as k, o_orderstatus as s,
   case when o_orderstatus = 'F' then o_totalprice end as total,
   case when o_orderstatus = 'P' and o_orderpriority > '3' then 5.0 end as vat,
   length(o_orderpriority) > 7 as certificate from orders)"""


@query(
    "money_filters",
    f"""with {_STATED_SQL}
    select s, (total is not null) as has_money, (total is not null or certificate) as kept,
      (total is null and vat is null) as phantom, count(*)::bigint as bills
    from stated group by all""",
)
def money_filters(spark, d):
    o = table(spark, d, "orders", "o_orderstatus", "o_totalprice", "o_orderpriority")
    status, pri = F.col("o_orderstatus"), F.col("o_orderpriority")
    given = {
        "originalTotal": F.when(status == "F", F.col("o_totalprice")),
        "vat": F.when((status == "P") & (pri > "3"), F.lit(5.0)),
    }
    names_ = ("originalTotal", "amountBeforeVat", "clearingAmount", "vat", "withholdingTax")
    b = o.select(
        status.alias("s"), (F.length(pri) > 7).alias("certificate"),
        *[fields.typed_cell(f, given.get(f), 0.5).alias(f) for f in names_],
    )
    return b.groupBy(
        "s", asm.has_money().alias("has_money"),
        asm.has_money(keep=F.col("certificate")).alias("kept"), asm.is_phantom().alias("phantom"),
    ).agg(F.count(F.lit(1)).alias("bills"))


@query(
    "cell_values",
    """select o_orderkey, o_totalprice as total, (case when o_orderstatus = 'F' then 0.9 else 0.4 end)::double
       as confidence, try_cast(o_orderpriority as double) as as_number from orders""",
)
def cell_values(spark, d):
    o = table(spark, d, "orders")
    conf = F.when(F.col("o_orderstatus") == "F", F.lit(0.9)).otherwise(F.lit(0.4))
    wrapped = o.select(
        "o_orderkey", "o_orderpriority", fields.cell(F.col("o_totalprice"), conf).alias("originalTotal")
    )
    return wrapped.select(
        "o_orderkey", fields.val("originalTotal").alias("total"),
        F.col("originalTotal.confidence").alias("confidence"),
        F.col("o_orderpriority").try_cast("double").alias("as_number"),
    )


@query(
    "canonical_strings",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
         printf('%.2f', l_extendedprice) as amount, cast(cast(trunc(l_tax * 100) as bigint) as varchar)
           as rate, l_returnflag as flag from lineitem""",
)
def canonical_strings(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        fields.canonical_string("originalTotal", F.col("l_extendedprice")).alias("amount"),
        fields.canonical_string("vatRate", F.col("l_tax") * 100).alias("rate"),
        fields.canonical_string("documentType", F.col("l_returnflag")).alias("flag"),
    )


@query(
    "line_item_texts",
    r"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(array_to_string(list_filter(
          [case when l_returnflag = 'A' then '' else l_returnflag end, l_linestatus,
           case when l_tax > 0.04 then '  ' else 'tax ' || l_linenumber end],
          lambda x: trim(x) <> ''), chr(10)), '') as lines from lineitem""",
)
def line_item_texts(spark, d):
    li = table(spark, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.col("l_returnflag"))
    tax = F.when(F.col("l_tax") > 0.04, F.lit("  ")).otherwise(
        F.concat(F.lit("tax "), F.col("l_linenumber").cast("string"))
    )
    items = F.array(
        *[
            F.struct(F.struct(c.alias("value"), F.lit(0.5).alias("confidence")).alias("description"))
            for c in (flag, F.col("l_linestatus"), tax)
        ]
    )
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        fields.line_item_text(items).alias("lines"),
    )


@query(
    "printed_dates",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso,
         strftime(o_orderdate, '%Y-%m-%d') as from_buddhist,
         strftime(o_orderdate, '%Y-%m-%d') as from_short from orders""",
)
def printed_dates(spark, d):
    day = F.col("o_orderdate")
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    dd, mm, yyyy = (F.date_format(day, f) for f in ("dd", "MM", "yyyy"))
    thai = (F.year(day) + 543).cast("string")
    return o.select(
        "o_orderkey", fields.printed_date_iso(dd, mm, yyyy).alias("iso"),
        fields.buddhist_to_iso(F.concat_ws("/", F.day(day), F.month(day), thai)).alias("from_buddhist"),
        fields.buddhist_to_iso(F.concat_ws("/", dd, mm, F.right(thai, F.lit(2)))).alias("from_short"),
    )


@query(
    "collapse_blank_rows",
    r"""
    with h as (select o_orderkey, concat('<table border=1><tr><td>', o_orderpriority, '</td><td>-</td></tr>',
        '<TR><td>&nbsp;</td><td> <br/> </td></TR><tr><th>', case when o_orderstatus = 'P' then '•' else 'x'
        end, '</th></tr></table><table><tbody><tr><td>–</td></tr></tbody></table>') as html from orders),
    r as (select o_orderkey, html, regexp_replace(html,
       '<tr[^>]*>\s*(?:<t[dh][^>]*>(?:\s|&nbsp;|&#160;|<br\s*/?>|[-\x{2010}-\x{2015}•.])*</t[dh]>\s*)+</tr>',
       '', 'gi') as rows_gone from h)
    select o_orderkey, length(html)::int as before, regexp_replace(rows_gone,
       '<table[^>]*>\s*(?:<t(?:body|head)>\s*</t(?:body|head)>\s*)*</table>', '', 'gi') as after
    from r
    """,
)
def collapse_blank_rows(spark, d):
    mark = F.when(F.col("o_orderstatus") == "P", F.lit("•")).otherwise(F.lit("x"))
    html = F.concat(
        F.lit("<table border=1><tr><td>"), F.col("o_orderpriority"), F.lit("</td><td>-</td></tr>"),
        F.lit("<TR><td>&nbsp;</td><td> <br/> </td></TR><tr><th>"), mark,
        F.lit("</th></tr></table><table><tbody><tr><td>–</td></tr></tbody></table>"),
    )
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.select(
        "o_orderkey", F.length(html).alias("before"), text.collapse_empty_rows(html).alias("after")
    )


@query(
    "category_keys",
    r"""
    with c as (select o_orderpriority as stated from orders union all
      select concat(' ', c_custkey, '-', c_nationkey, ' label 95') from customer union all
      select concat(' ', c_mktsegment, ' ') from customer)
    select case when regexp_extract(stated, '^\s*([0-9][0-9-]*)', 1) <> ''
        then replace(regexp_extract(stated, '^\s*([0-9][0-9-]*)', 1), '-', '')
        else trim(stated) end as key, count(*)::bigint as n
    from c group by key
    """,
)
def category_keys(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("stated"))
    c = table(spark, d, "customer")
    coded = c.select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit("-"),
                 F.col("c_nationkey").cast("string"), F.lit(" label 95")).alias("stated")
    )
    named = c.select(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")).alias("stated"))
    every = o.unionByName(coded).unionByName(named)
    return every.groupBy(text.category_key(F.col("stated")).alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _categories(spark, d):
    """A category list read off the order priorities, as raw JSON entries."""
    code = F.substring("o_orderpriority", 1, 1)
    entry = (
        F.when(code == "1", F.lit("be quick"))
        .when(code == "2", F.lit('{"rule":"  ","sumTollTickets":true}'))
        .when(code == "3", F.lit('{"rule":" look twice ","sumTollTickets":true}'))
        .when(code == "4", F.lit('{"name":"plain"}'))
    )
    raw = table(spark, d, "orders", "o_orderpriority").distinct().select(
        code.alias("k"), entry.alias("v")
    ).where(F.col("v").isNotNull())
    return raw.select(*category_columns(F.col("k"), F.col("v")))


@query(
    "category_effect",
    """
    with r as (select case when o_orderstatus = 'P' then null else o_orderpriority end as category
               from orders)
    select category, case substr(category, 1, 1) when '1' then 'be quick' when '3' then 'look twice' end
        as rule,
      case when category is null then 'none' when category like '1%' then 'prompt'
           when category like '2%' then 'tolls' when category like '3%' then 'prompt,tolls'
           else 'no-effect' end as effect, count(*)::bigint as requests
    from r group by all
    """,
)
def category_effect(spark, d):
    asked = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    r = table(spark, d, "orders", "o_orderstatus", "o_orderpriority").select(asked.alias("category"))
    r = r.groupBy("category").agg(F.count(F.lit(1)).alias("requests"))
    keyed = r.withColumn("key", text.category_key(F.col("category")))
    cats = _categories(spark, d)
    both = cat.category_effect(cat.category_lookup(keyed, cats), cats)
    return both.select("category", "rule", "effect", "requests")


@query(
    "category_rules",
    """select substr(o_orderpriority, 1, 1) as code, case substr(o_orderpriority, 1, 1)
         when '1' then 'be quick' else 'look twice' end as rule
       from (select distinct o_orderpriority from orders)
       where o_orderpriority like '1%' or o_orderpriority like '3%'""",
)
def category_rules(spark, d):
    return cat.category_rules(_categories(spark, d)).select("code", "rule")


@query(
    "normalise_names",
    r"""
    with n as (select s_suppkey as k, concat('  ', s_name, '  (Main Office', case when s_nationkey > 9
        then ') branch 12 (branch 3)' else ')' end) as stated from supplier
      union all select -c_custkey - 1, concat(upper(c_name), chr(9), ' Ltd branch 7 ') from customer)
    select k, nullif(lower(regexp_replace(regexp_replace(trim(regexp_replace(stated, '\s+', ' ', 'g')),
      '(?:[(\s]*(?:main office|branch\s*[0-9]+)[)\s]*)+$', ''), '\s+', '', 'g')), '') as name
    from n
    """,
)
def normalise_names(spark, d):
    many = F.when(F.col("s_nationkey") > 9, F.lit(") branch 12 (branch 3)")).otherwise(F.lit(")"))
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("k"),
        F.concat(F.lit("  "), F.col("s_name"), F.lit("  (Main Office"), many).alias("stated"),
    )
    c = table(spark, d, "customer").select(
        (-F.col("c_custkey") - 1).alias("k"),
        F.concat(F.upper("c_name"), F.lit("\t Ltd branch 7 ")).alias("stated"),
    )
    return s.unionByName(c).select(
        "k", names.norm_name(F.col("stated"), PROSE.branch_suffix).alias("name")
    )


@query(
    "identity_norms",
    r"""select c_custkey, nullif(lower(regexp_replace(concat(' ', upper(c_mktsegment), ' x'), '\s+', '',
       'g')), '') as segment, printf('%.2f', c_acctbal) as total,
       nullif(case when c_nationkey > 12 then '' else lower(c_name) end, '') as name from customer""",
)
def identity_norms(spark, d):
    c = table(spark, d, "customer")
    blanked = F.when(F.col("c_nationkey") > 12, F.lit("  ")).otherwise(F.col("c_name"))
    return c.select(
        "c_custkey",
        fields.norm_identity(
            "sellerName", F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit(" x"))
        ).alias("segment"),
        fields.norm_identity("originalTotal", F.col("c_acctbal")).alias("total"),
        fields.norm_identity("documentDate", blanked).alias("name"),
    )


def _name_pairs(spark, d):
    """Every customer beside the first supplier of its nation."""
    first = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(
        F.min_by("s_name", "s_suppkey").alias("s_name")
    )
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    j = c.join(first, "c_nationkey", "left")
    return j.select(
        "c_custkey", F.lower("c_name").alias("a"),
        F.lower(
            F.when(F.col("c_mktsegment") == "MACHINERY", F.concat("c_name", F.lit(" international")))
            .when(F.col("c_mktsegment") == "BUILDING", F.replace("c_name", F.lit("00"), F.lit("oo")))
            .otherwise(F.col("s_name"))
        ).alias("b"),
    )


_PAIRS_SQL = """first as (select s_nationkey, arg_min(s_name, s_suppkey) as s_name
       from supplier group by s_nationkey),
  pairs as (select c_custkey, lower(c_name) as a, lower(case when c_mktsegment = 'MACHINERY'
       then concat(c_name, ' international') when c_mktsegment = 'BUILDING'
       then replace(c_name, '00', 'oo') else s_name end) as b
       from customer left join first on s_nationkey = c_nationkey)"""


@query(
    "names_agree_by_edits",
    f"""with {_PAIRS_SQL},
    v as (select c_custkey, a, b, 1.0 - levenshtein(a, b) / (length(a) + length(b)) as bound from pairs)
    select c_custkey, case when a = b then true
      when (length(a) >= 8 and starts_with(b, a)) or (length(b) >= 8 and starts_with(a, b)) then true
      when bound < 0.6 then false when bound >= 0.9 then true end as agree from v""",
)
def names_agree_by_edits(spark, d):
    p = _name_pairs(spark, d)
    return p.select(
        "c_custkey", names.names_agree_by_edits(F.col("a"), F.col("b"), DEFAULT).alias("agree")
    )


@query("names_agree")
def names_agree(spark, d):
    """With the sequence ratio, which SQL has not; rows only."""
    p = _name_pairs(spark, d)
    return p.select("c_custkey", names.names_agree(F.col("a"), F.col("b"), DEFAULT).alias("agree"))


@query(
    "payee_from_name",
    """
    with n as (select 's' as side, s_suppkey as k, s_name as name from supplier union all
               select 'c', c_custkey, c_name from customer)
    select side, k, case
      when starts_with(upper(name), 'SUPPLIER#00000000') or starts_with(upper(name), 'CUSTOMER#00000000')
        then 'individual'
      when contains(upper(name), '7') or contains(upper(name), '55') then 'company'
      when starts_with(upper(name), 'SUPPLIER#0000000') or starts_with(upper(name), 'CUSTOMER#0000001')
        then 'company' end as payee
    from n
    """,
)
def payee_from_name(spark, d):
    s = table(spark, d, "supplier").select(
        F.lit("s").alias("side"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")
    )
    c = table(spark, d, "customer").select(
        F.lit("c").alias("side"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name")
    )
    return s.unionByName(c).select(
        "side", "k", names.payee_from_name(F.col("name"), PROSE).alias("payee")
    )


_PAD_SQL = """pad as (select c_custkey as k, c_name as name, c_mktsegment as seg,
    lpad(cast(c_custkey * 7919 * 104729 as varchar), 13, cast(c_nationkey % 10 as varchar)) as id
    from customer),
  chk as (select *, (11 - list_sum(list_transform(range(1, 13), lambda i:
      substr(id, i, 1)::int * (14 - i))) % 11) % 10 = substr(id, 13, 1)::int as valid from pad)"""


def _padded(spark, d):
    c = table(spark, d, "customer")
    big = (F.col("c_custkey") * 7919 * 104729).cast("string")
    digit = (F.col("c_nationkey") % 10).cast("string")
    return c.select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"),
        F.expr("lpad(cast(c_custkey * 7919 * 104729 as string), 13, cast(c_nationkey % 10 as string))")
        .alias("id"), big.alias("_b"), digit.alias("_d"),
    ).drop("_b", "_d")


@query(
    "payee_from_id",
    f"""with {_PAD_SQL} select k, id, valid, case when valid then case when left(id, 1) = '0'
      then 'company' when left(id, 1) <> '9' then 'individual' end end as payee from chk""",
)
def payee_from_id(spark, d):
    return _padded(spark, d).select(
        "k", "id", ids.check_digit_valid(F.col("id"), MOD11_13).alias("valid"),
        names.payee_from_id(F.col("id"), DEFAULT).alias("payee"),
    )


_SEG_TYPE = {"BUILDING": "company", "MACHINERY": "individual"}


@query(
    "payee_types_applied",
    f"""with {_PAD_SQL},
    t as (select k, case seg when 'BUILDING' then 'company' when 'MACHINERY' then 'individual' end as was,
       coalesce(case when seg = 'FURNITURE' then 'individual' end,
         case when valid then case when left(id, 1) = '0' then 'company' when left(id, 1) <> '9'
           then 'individual' end end) as decided from chk)
    select k, was, coalesce(decided, was) as now,
      (case when decided is not null and was is distinct from decided then 0.9
           when was is null then 0.0 else 0.5 end)::double as confidence,
      (decided is not null and was is distinct from decided) as changed from t""",
)
def payee_types_applied(spark, d):
    seg = F.col("seg")
    was = F.when(seg == "BUILDING", F.lit("company")).when(seg == "MACHINERY", F.lit("individual"))
    rows = _padded(spark, d).select(
        F.lit("all").alias("chunk_id"), F.col("k").alias("cand_pos"),
        F.lit(0).alias("chunkPageIndex"),
        fields.typed_cell(
            "payeeType", was, F.when(was.isNull(), F.lit(0.0)).otherwise(F.lit(0.5))
        ).alias("payeeType"),
        fields.typed_cell(
            "sellerName", F.when(seg == "FURNITURE", F.lit("นาย ก")).otherwise(F.lit("ร้าน x")), 0.5
        ).alias("sellerName"),
        fields.typed_cell("sellerTaxId", F.col("id"), 0.5).alias("sellerTaxId"),
        was.alias("was"),
    )
    fixed, _ = checks.apply_payee_types(rows, DEFAULT)
    now = F.col("payeeType.value")
    return fixed.select(
        F.col("cand_pos").alias("k"), "was", now.alias("now"),
        F.col("payeeType.confidence").alias("confidence"),
        (~now.eqNullSafe(F.col("was"))).alias("changed"),
    )


def _party_cells(df, values):
    cells = [fields.typed_cell(f, v, 0.5).alias(f) for f, v in values.items()]
    return df.select("o_orderkey", *cells)


@query(
    "resolve_parties",
    """
    with p as (select o_orderkey as k,
      case when o_orderpriority < '2' then 'Licensed trader' when o_orderpriority < '4' then c_name end as sn,
      case when o_orderpriority like '2%' then 'Version road' when o_orderpriority like '3%' then c_mktsegment
        end as sa,
      case when o_orderstatus = 'F' then '0000000000000' end as si, 'Main' as sb,
      case when o_orderstatus = 'P' then 'LICENSED buyer' when o_orderstatus = 'F' then c_mktsegment end as bn,
      c_mktsegment as ba, cast(c_custkey as varchar) as bi, 'Main' as bb
      from orders join customer on c_custkey = o_custkey),
    f as (select *, coalesce(contains(lower(sn), 'licensed'), false) as on_, coalesce(contains(sa,
        'Version'), false) as oa, coalesce(si = '0000000000000', false) as oi,
      coalesce(contains(lower(bn), 'licensed'), false) as un, coalesce(contains(ba, 'Version'), false)
        as ua, coalesce(bi = '0000000000000', false) as ui from p),
    g as (select *, (on_ or oa or oi) as su, (un or ua or ui) as bu from f),
    h as (select *, su and bu as twice, su and not bu as swap,
       not su and sn is null and bn is not null and not un as shift from g)
    select k,
      case when twice and (on_ or coalesce(sn = bn, false)) then null when swap or (shift and sn is null
        and not un) then bn else sn end as seller_name,
      case when twice and (oa or coalesce(sa = ba, false)) then null when swap or (shift and sa is null
        and not ua) then ba else sa end as seller_address,
      case when twice and (oi or coalesce(si = bi, false)) then null when swap or (shift and si is null
        and not ui) then bi else si end as seller_id,
      case when twice and coalesce(sb = bb, false) then null else sb end as seller_branch,
      case when swap then sn when shift and sn is null and not un then null else bn end as buyer_name,
      case when swap then sa when shift and sa is null and not ua then null else ba end as buyer_address,
      case when swap then si when shift and si is null and not ui then null else bi end as buyer_id
    from h
    """,
)
def resolve_parties(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    pri, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    given = {
        "sellerName": F.when(pri < "2", F.lit("Licensed trader")).when(pri < "4", F.col("c_name")),
        "sellerAddress": F.when(pri.startswith("2"), F.lit("Version road")).when(
            pri.startswith("3"), F.col("c_mktsegment")
        ),
        "sellerTaxId": F.when(status == "F", F.lit("0000000000000")),
        "sellerBranch": F.lit("Main"),
        "buyerName": F.when(status == "P", F.lit("LICENSED buyer")).when(
            status == "F", F.col("c_mktsegment")
        ),
        "buyerAddress": F.col("c_mktsegment"),
        "buyerTaxId": F.col("c_custkey").cast("string"),
        "buyerBranch": F.lit("Main"),
    }
    out = asm.resolve_parties(_party_cells(j, given), OWN)
    wanted = {
        "seller_name": "sellerName", "seller_address": "sellerAddress", "seller_id": "sellerTaxId",
        "seller_branch": "sellerBranch", "buyer_name": "buyerName",
        "buyer_address": "buyerAddress", "buyer_id": "buyerTaxId",
    }
    return out.select(
        F.col("o_orderkey").alias("k"), *[F.col(f)["value"].alias(n) for n, f in wanted.items()]
    )


@query(
    "own_party_values",
    """select s_suppkey, contains(lower(s_name), '9') as name_ours, s_nationkey = 7 as id_ours,
       (contains(lower(s_name), '9') or s_nationkey = 7) as is_us from supplier""",
)
def own_party_values(spark, d):
    from docrecon.profile import OwnParty

    own = OwnParty(tax_id="7", name_markers=("9",))
    s = table(spark, d, "supplier")
    n = names.is_our_value("Name", F.col("s_name"), own)
    i = names.is_our_value("TaxId", F.concat(F.lit(" "), F.col("s_nationkey").cast("string")), own)
    b = names.is_our_value("Branch", F.col("s_name"), own)
    return s.select("s_suppkey", n.alias("name_ours"), i.alias("id_ours"), (n | i | b).alias("is_us"))


EVENT_RESPONSE = T.StructType(
    [T.StructField("billCandidates", T.ArrayType(T.StructType([T.StructField("k", T.IntegerType())])))]
)


@query(
    "parse_candidates",
    """
    select event_id, 0 as page_pos, cast(json_extract(props, '$.k') as int) as k from events
      where event_type <> 'error'
    union all select event_id, 1, cast(value as int) from events where event_type = 'purchase'
      and false
    union all select event_id, 1, cast(floor(value) as int) from events where event_type = 'purchase'
    union all select event_id, null, null from events where event_type = 'error'
    """,
)
def parse_candidates_query(spark, d):
    """Event properties as a model answer: errors answer with no candidate, purchases with two."""
    e = table(spark, d, "events", "event_id", "event_type", "value", "props")
    second = F.when(
        F.col("event_type") == "purchase",
        F.concat(F.lit(',{"k":'), F.floor("value").cast("string"), F.lit("}")),
    ).otherwise(F.lit(""))
    inner = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.concat("props", second))
    raw = e.select(
        "event_id", F.concat(F.lit('{"billCandidates":['), inner, F.lit("]}")).alias("answer")
    )
    return parse_candidates(raw, "answer", EVENT_RESPONSE)


@query(
    "answer_faults",
    """
    with whole as (select *, '{"billCandidates":[' || props || ']}' as answer from events),
    given as (select event_id, case event_type when 'view' then left(answer, length(answer) - 2)
      when 'click' then null when 'error' then replace(answer, 'billCandidates', 'bills')
      when 'signup' then '{"billCandidates":' || props || '}' else answer end as answer from whole),
    judged as (select event_id, case when answer is null then 'no answer'
      when not json_valid(answer) then 'not JSON'
      when json_type(case when json_valid(answer) then answer end, '$.billCandidates') = 'ARRAY' then null
      else 'no candidate list' end as fault from given)
    select event_id, fault from judged where fault is not null
    """,
)
def answer_faults_query(spark, d):
    """Event properties as a model answer: views are cut short, clicks have none, errors name the
    list otherwise and sign-ups give an object in its place."""
    e = table(spark, d, "events", "event_id", "event_type", "props")
    kind, whole = F.col("event_type"), F.concat(F.lit('{"billCandidates":['), F.col("props"), F.lit("]}"))
    answer = (
        F.when(kind == "view", F.expr("left(whole, length(whole) - 2)"))
        .when(kind == "click", F.lit(None))
        .when(kind == "error", F.replace("whole", F.lit("billCandidates"), F.lit("bills")))
        .when(kind == "signup", F.concat(F.lit('{"billCandidates":'), F.col("props"), F.lit("}")))
        .otherwise(F.col("whole"))
    )
    raw = e.withColumn("whole", whole).select("event_id", answer.alias("answer"))
    return answer_faults(raw, "answer")


@query(
    "contract_keys",
    """select case event_type when 'view' then 'value: required'
           when 'error' then 'not an object' when 'click' then 'extra: not declared' end as error,
         count(*)::bigint as answers from events group by error""",
)
def contract_keys(spark, d):
    """Key checks on event properties: complete, missing, undeclared and unreadable answers."""
    e = table(spark, d, "events", "event_type", "value", "props")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    full = F.concat(F.lit('{"k":'), k, F.lit(',"value":1}'))
    raw = (
        F.when(kind == "view", F.col("props"))
        .when(kind == "error", F.lit("no json"))
        .when(kind == "click", F.replace(full, F.lit("}"), F.lit(',"extra":0}')))
        .otherwise(full)
    )
    parsed = F.from_json(raw, "k int, value int")
    error = json_key_errors(raw, ["k", "value"], parsed)
    return e.groupBy(error.alias("error")).agg(F.count(F.lit(1)).alias("answers"))


_CONTRACT_CELLS = ["documentDate", "currency", "payeeType", "originalTotal"]


@query(
    "contract_validate",
    """
    select o_orderkey, case
        when o_orderstatus = 'P' and o_orderpriority like '1%' then 'originalTotal/confidence'
        when o_orderpriority like '2%' then 'documentDate/value'
        when o_orderpriority like '3%' then 'currency/value'
        when o_orderpriority like '4%' and o_orderstatus = 'F' then 'payeeType/value'
        when o_orderpriority like '4%' then 'regions'
        when o_orderpriority like '5%' and o_orderstatus = 'O' then 'evidence/role' end as error,
      not (coalesce(o_orderpriority between '2' and '4z', false)
           or (o_orderstatus = 'P' and o_orderpriority like '1%')
           or (o_orderpriority like '5%' and o_orderstatus = 'O')) as ok
    from orders
    """,
)
def contract_validate(spark, d):
    from docrecon.operators.spans import whole_page
    from docrecon.profile import EVIDENCE_ROLES

    pri, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    day = F.when(pri.startswith("2"), F.lit("3 May 2026")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    kind = F.when(pri.startswith("4") & (status == "F"), F.lit("shop")).otherwise(F.lit("company"))
    too_sure = F.when(pri.startswith("1") & (status == "P"), F.lit(1.5)).otherwise(F.lit(1.0))
    box = F.array(whole_page(F.lit(0)))
    role = F.when(pri.startswith("5") & (status == "O"), F.lit("poster")).otherwise(F.lit("receipt"))
    bills = table(spark, d, "orders").select(
        "o_orderkey", F.lit(0).alias("candidateIndex"), F.lit(0).alias("chunkPageIndex"),
        fields.typed_cell("documentDate", day, 0.5).alias("documentDate"),
        fields.typed_cell(
            "currency", F.when(pri.startswith("3"), F.lit("baht")).otherwise(F.lit("THB")), 0.5
        ).alias("currency"),
        fields.typed_cell("payeeType", kind, 0.5).alias("payeeType"),
        fields.typed_cell("originalTotal", F.col("o_totalprice"), too_sure).alias("originalTotal"),
        F.when(pri.startswith("4") & (status != "F"), F.slice(box, 1, 0)).otherwise(box).alias("regions"),
        F.array(F.struct(role.alias("role"), box.alias("regions"))).alias("evidence"),
    )
    errors = contract_errors(EVIDENCE_ROLES, _CONTRACT_CELLS)
    return bills.select(
        "o_orderkey", F.get(errors, F.lit(0)).alias("error"), (F.size(errors) == 0).alias("ok")
    )
