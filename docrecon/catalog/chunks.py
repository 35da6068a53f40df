"""Ordered, folding and page-ownership queries over chunks built from events and conversations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrecon.catalog.demo import PROSE, RECEIPTS
from docrecon.catalog.registry import query, table
from docrecon.catalog.shapes import EV_SQL, LINES_SQL, cells, event_pages, turn_lines, turns
from docrecon.functions import text
from docrecon.functions.fields import val
from docrecon.operators import merge, spans, tickets
from docrecon.operators.assemble import renumber
from docrecon.operators.certificates import candidate_on_page
from docrecon.operators.contract import response_documents, response_lines, strip_internal
from docrecon.operators.ledger import new_ledger
from docrecon.operators.ordered import consecutive_runs
from docrecon.operators.rounds import settle
from docrecon.profile import CERTIFICATE_ROLE, EVIDENCE_ROLES
from docrecon.schema import LINE_ITEM


@query(
    "page_positions",
    f"with {EV_SQL} select user_id as chunk_id, event_id, page::int as page_index from ev",
)
def page_positions(spark, d):
    return event_pages(spark, d).select("chunk_id", "event_id", "page_index")


@query(
    "consecutive_runs",
    f"""with {EV_SQL},
    v as (select user_id, page, page - row_number() over (partition by user_id order by page) as g
          from ev where event_type = 'view')
    select user_id as chunk_id, min(page)::int as run_start, count(*)::bigint as pages from v
    group by user_id, g""",
)
def runs(spark, d):
    views = event_pages(spark, d, "event_type").where("event_type = 'view'").select(
        "chunk_id", "page_index"
    )
    out = consecutive_runs(views, ["chunk_id"], "page_index")
    return out.groupBy("chunk_id", "run_start").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "orphan_fill",
    f"""with {EV_SQL},
    h as (select user_id, page, event_type, last_value(case when event_type = 'purchase' then page end
        ignore nulls) over (partition by user_id order by page rows unbounded preceding) as held,
      min(case when event_type = 'purchase' then page end) over (partition by user_id) as first_bill
      from ev)
    select user_id as chunk_id, coalesce(held, first_bill)::bigint as cand_pos, page::int as page_index
    from h where event_type <> 'purchase' and first_bill is not null""",
)
def orphan_fill(spark, d):
    pages = event_pages(spark, d, "event_type")
    bills = pages.where("event_type = 'purchase'").select(
        "chunk_id", F.col("page_index").cast("long").alias("cand_pos"), "page_index"
    )
    return spans.attach_orphans(pages, bills, bills)


@query(
    "renumber_candidates",
    f"""with {EV_SQL} select user_id as chunk_id, event_id,
      (row_number() over (partition by user_id order by page) - 1)::int as "candidateIndex"
    from ev where event_type = 'purchase'""",
)
def renumber_candidates(spark, d):
    bills = event_pages(spark, d, "event_type").where("event_type = 'purchase'").select(
        "chunk_id", "event_id", F.col("page_index").cast("long").alias("cand_pos")
    )
    return renumber(bills).select("chunk_id", "event_id", "candidateIndex")


def _event_bills(spark, d):
    """One bill per event; types without a total or a date leave gaps for later parts to fill."""
    e = settle(event_pages(spark, d, "event_type", "value"))  # bills and pages both read it
    kind = F.col("event_type")
    given = {
        "originalDocumentNumber": F.when(F.col("value") > 60, F.lit("big")),
        "sellerName": F.when(kind.isin("view", "click"), F.lit("view")).when(kind == "error", kind),
        "originalTotal": F.when(kind != "view", F.floor(F.col("value") / 40).cast("double")),
        "documentDate": F.when(kind != "click", F.date_format("ts", "yyyy-MM")),
    }
    keep = ["chunk_id", F.col("page_index").cast("long").alias("cand_pos"),
            F.col("page_index").alias("chunkPageIndex")]
    bills = cells(e, keep, given)
    listed = e.select(
        "chunk_id", "page_index",
        F.when(F.col("value") < 8, F.struct(
            (F.col("page_index") % 3).alias("page"), F.lit(3).alias("of")
        )).alias("marker"),
    )
    return bills, listed


_EVENT_BILLS_SQL = f"""{EV_SQL},
  b as (select user_id, page, case when value > 60 then 'big' end as doc,
    case when event_type in ('view', 'click') then 'view' when event_type = 'error' then event_type end
      as seller,
    case when event_type <> 'view' then floor(value / 40) end as total,
    case when event_type <> 'click' then strftime(ts, '%Y-%m') end as day,
    case when value < 8 then page % 3 end as mark from ev)"""


@query(
    "merge_spanning",
    f"""with recursive {_EVENT_BILLS_SQL},
    fold as (
      select user_id, page, page as head, doc, seller, total, day, mark from b where page = 0
      union all
      select user_id, page, case when j then fhead else page end,
        case when j then coalesce(fdoc, doc) else doc end,
        case when j then coalesce(fseller, seller) else seller end,
        case when j then coalesce(ftotal, total) else total end,
        case when j then coalesce(fday, day) else day end, mark
      from (select b.*, f.head as fhead, f.doc as fdoc, f.seller as fseller, f.total as ftotal,
              f.day as fday,
              coalesce(f.doc = b.doc, true) and coalesce(f.seller = b.seller, true)
                and coalesce(f.total = b.total, true) and coalesce(f.day = b.day, true)
              and (coalesce(b.mark = f.mark + 1, false)
                or coalesce((f.doc = b.doc)::int, 0) + coalesce((f.seller = b.seller)::int, 0)
                 + coalesce((f.total = b.total)::int, 0) + coalesce((f.day = b.day)::int, 0) >= 2) as j
            from fold f join b on b.user_id = f.user_id and b.page = f.page + 1) x
    ),
    heads as (select user_id, head, max(page) as last_page, count(*) as parts,
        arg_max(total, page) as total, arg_max(doc, page) as doc, arg_max(day, page) as day
      from fold group by user_id, head)
    select user_id as chunk_id, head::bigint as cand_pos,
       (row_number() over (partition by user_id order by head) - 1)::int as "candidateIndex",
       parts::bigint as parts, total, doc, day
    from (select h.user_id, h.head, h.parts, f.total, f.doc, f.day from heads h
          join fold f on f.user_id = h.user_id and f.page = h.last_page) z""",
)
def merge_spanning(spark, d):
    bills, listed = _event_bills(spark, d)
    missing = {"candidateIndex": F.lit(0), "lineItems": F.array().cast("array<string>")}
    full = bills.withColumns(missing)
    from docrecon.functions.fields import typed_cell
    from docrecon.schema import CELL_FIELDS

    full = full.withColumns(
        {f: typed_cell(f, None, 0.0) for f in CELL_FIELDS if f not in bills.columns}
    ).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    ledger = merge.merge_spanning(
        full, listed.withColumn("chunk_id", F.col("chunk_id").cast("string")), PROSE
    )
    parts = ledger.spans.groupBy("chunk_id", "cand_pos").agg(F.count(F.lit(1)).alias("parts"))
    return ledger.bills.join(parts, ["chunk_id", "cand_pos"]).select(
        F.col("chunk_id").cast("long").alias("chunk_id"), "cand_pos", "candidateIndex", "parts",
        val("originalTotal").alias("total"), val("originalDocumentNumber").alias("doc"),
        val("documentDate").alias("day"),
    )


@query(
    "merge_pairwise",
    f"""with {_EVENT_BILLS_SQL},
    p as (select *, lag(doc) over w as pdoc, lag(seller) over w as pseller, lag(total) over w as ptotal,
       lag(day) over w as pday, lag(mark) over w as pmark from b
       window w as (partition by user_id order by page))
    select user_id as chunk_id, page::bigint as cand_pos, page > 0
      and coalesce(doc = pdoc, true) and coalesce(seller = pseller, true)
      and coalesce(total = ptotal, true) and coalesce(day = pday, true)
      and (coalesce(mark = pmark + 1, false) or coalesce((doc = pdoc)::int, 0)
        + coalesce((seller = pseller)::int, 0) + coalesce((total = ptotal)::int, 0)
        + coalesce((day = pday)::int, 0) >= 2) as joins
    from p""",
)
def merge_pairwise(spark, d):
    bills, listed = _event_bills(spark, d)
    return merge.merge_pairwise(merge.boundary_facts(bills, listed, PROSE), PROSE)


@query(
    "page_edges",
    f"""with {LINES_SQL}
    select conv_id as chunk_id, cand_pos::bigint as cand_pos,
      cand_pos = min(cand_pos) over w as is_first, cand_pos = max(cand_pos) over w as is_last,
      (count(*) over w)::bigint as n_on_page,
      exists (select 1 from conversations c where c.conv_id = l.conv_id and c.turn = l.turn - 1)
        as prev_read
    from lines l window w as (partition by conv_id, turn)""",
)
def page_edges(spark, d):
    lines = turn_lines(spark, d)
    given = {
        "originalDocumentNumber": F.lit(None).cast("string"),
        "sellerName": F.left("line", F.lit(12)),
        "originalTotal": F.length("line").cast("double"),
        "documentDate": F.col("role"),
    }
    bills = cells(lines, ["chunk_id", "cand_pos", F.col("page_index").alias("chunkPageIndex")], given)
    listed = turns(spark, d).select(
        "chunk_id", "page_index", F.lit(None).cast("struct<page:int,of:int>").alias("marker")
    )
    facts = merge.boundary_facts(bills, listed, PROSE)
    return facts.select("chunk_id", "cand_pos", "is_first", "is_last", "n_on_page", "prev_read")


@query(
    "candidate_on_page",
    f"""with {LINES_SQL} select conv_id as chunk_id, turn::int as page_index,
      min(cand_pos)::bigint as cand_pos, arg_min(line, cand_pos) as seller
    from lines where role = 'assistant' group by conv_id, turn""",
)
def candidate_on_page_query(spark, d):
    lines = turn_lines(spark, d)
    bills = cells(
        lines, ["chunk_id", "cand_pos", F.col("page_index").alias("chunkPageIndex")],
        {"documentDate": F.col("role"), "sellerName": F.col("line")},
    )
    wanted = turns(spark, d).where("role = 'assistant'").select("chunk_id", "page_index")
    out = candidate_on_page(bills, wanted)
    return out.select(
        "chunk_id", "page_index", F.col("on_page.cand_pos").alias("cand_pos"),
        F.col("on_page.seller").alias("seller"),
    )


# User turns are bills; every other turn is a page without a bill.
_OWNED_SQL = """h as (select conv_id, turn, role, text, last_value(case when role = 'user' then turn end
      ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as held,
      min(case when role = 'user' then turn end) over (partition by conv_id) as first_bill
      from conversations),
  owned as (select conv_id, coalesce(held, first_bill) as cand_pos, turn, text from h
      where first_bill is not null)"""


def _owned(spark, d):
    pages = turns(spark, d)
    bills = pages.where("role = 'user'").select(
        "chunk_id", F.col("page_index").cast("long").alias("cand_pos"), "page_index"
    )
    more = spans.attach_orphans(pages, bills, bills)
    return pages, bills, spans.widen(bills, more)


@query(
    "span_build",
    f"""with {_OWNED_SQL} select conv_id as chunk_id, cand_pos::bigint as cand_pos,
      string_agg(turn::varchar, ' ' order by turn) as pages, count(*)::int as n
    from owned group by conv_id, cand_pos""",
)
def span_build(spark, d):
    _, _, owned = _owned(spark, d)
    out = spans.page_span(owned)
    boxes = F.transform("pages", spans.whole_page)
    return out.select(
        "chunk_id", "cand_pos",
        F.array_join(
            F.transform(boxes, lambda b: b["chunkPageIndex"].cast("string")), " "
        ).alias("pages"),
        F.size("pages").alias("n"),
    )


_HEADINGS = (("Die ", "receipt"), ("La ", "tax_invoice"), ("The ", "cash_bill"), ("Le ", "receipt"))
_TAGS = replace(
    PROSE, heading_roles=_HEADINGS, cash_headings=("xyzzy",), citation_forms="The the ",
    declared_roles=(*EVIDENCE_ROLES, CERTIFICATE_ROLE),
)


@query(
    "evidence_tags",
    f"""with {_OWNED_SQL},
    r as (select conv_id, cand_pos, turn, text, replace(text, 'The the ', ' ') as t,
      contains(text, 'the ')::int + contains(text, 'and ')::int + contains(text, 'that ')::int
        + contains(text, 'with ')::int as hits from owned),
    e as (select conv_id, cand_pos, unnest(list_filter([
        case when contains(t, 'Die ') or contains(t, 'Le ') then 'receipt' end,
        case when contains(t, 'La ') then 'tax_invoice' end,
        case when contains(t, 'The ') then 'cash_bill' end,
        case when hits >= 2 then 'withholding_certificate' end], lambda x: x is not null)) as role from r)
    select conv_id as chunk_id, cand_pos::bigint as cand_pos, role, count(*)::bigint as pages
    from e group by all""",
)
def evidence_tags(spark, d):
    pages, _, owned = _owned(spark, d)
    t = F.col("text")
    facts = pages.select(
        "chunk_id", "page_index", text.roles_for_page(t, _TAGS).alias("roles"),
        text.is_certificate(t, _TAGS).alias("is_certificate"),
    )
    none = owned.select("chunk_id", "cand_pos", F.lit("").alias("role"), "page_index").limit(0)
    roles = spans.page_roles(facts, _TAGS)
    once = spans.tag_document_roles(none, owned, roles)
    # A second pass adds nothing.
    twice = spans.tag_document_roles(once, owned, roles)
    return twice.groupBy("chunk_id", "cand_pos", "role").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "span_invariants",
    """with s as (select conv_id, turn as cand_pos, unnest([turn, turn + 1, turn + 2]) as page
        from conversations where role = 'user'),
    claims as (select conv_id, page, count(*) as owners from s group by conv_id, page),
    g as (select coalesce(c.conv_id, k.conv_id) as conv_id, c.turn, k.page, k.owners
          from conversations c full join claims k on k.conv_id = c.conv_id and k.page = c.turn)
    select conv_id as chunk_id, case when owners > 1 then 'page claimed twice'
       when owners is null then 'page not owned' else 'page not in chunk' end as rule,
       count(*)::bigint as n
    from g where owners > 1 or owners is null or turn is null group by all""",
)
def span_invariants(spark, d):
    """Greedy spans, a bill's page and the two after it, break the rules on purpose."""
    pages = turns(spark, d)
    bills = pages.where("role = 'user'").select(
        "chunk_id", F.col("page_index").cast("long").alias("cand_pos"),
        F.col("page_index").alias("chunkPageIndex"),
    )
    p = F.col("chunkPageIndex")
    greedy = bills.select("chunk_id", "cand_pos", F.explode(F.sequence(p, p + 2)).alias("page_index"))
    return spans.span_invariants(greedy, bills, pages)


@query(
    "response_nest",
    """with b as (select conv_id, turn, to_json({'candidateIndex': turn::int, 'role': role,
        'chars': case when role = 'system' then null else length(text)::int end})::varchar as body
        from conversations where role <> 'assistant'),
    parts as (select conv_id, turn // 4 as part, string_agg(body, ',' order by turn) as list
              from b group by conv_id, turn // 4)
    select c.conv_id as chunk_id, coalesce(part, 0)::int as part,
      concat('{"billCandidates":[', coalesce(list, ''), ']}') as response
    from (select distinct conv_id from conversations) c left join parts p on p.conv_id = c.conv_id""",
)
def response_nest(spark, d):
    """User and system turns as bills; parts of four positions instead of five hundred."""
    pages = turns(spark, d)
    bills = pages.where("role <> 'assistant'").select(
        "chunk_id", F.col("page_index").alias("candidateIndex"), "role",
        F.when(F.col("role") != "system", F.length("text")).alias("chars"),
    )
    return response_documents(
        pages, bills, "candidateIndex", ["candidateIndex", "role", "chars"], shard=4
    )


_WHOLE_PAGE_SQL = """concat('{"chunkPageIndex":', turn, ',"xMin":0,"yMin":0,"xMax":1000,"yMax":1000}')"""


@query(
    "response_lines",
    f"""with {_OWNED_SQL},
    chunk as (select distinct conv_id from conversations),
    bill as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as nth
             from conversations where role = 'user'),
    toll as (select conv_id, turn, unnest(range(turn % 3)) as i from bill),
    tag as (select conv_id, cand_pos, turn, 2 as stage, 'receipt' as role from owned where length(text) % 2 = 0
      union all select conv_id, cand_pos, turn, 1, 'transfer_slip' from owned where length(text) % 3 = 0),
    line as (
      select conv_id, -9223372036854775808 as cand_pos, 0 as kind, 0 as a, 0 as b, 0 as c, '' as d,
        concat('{{"chunk_id":', to_json(conv_id), ',"response":{{"billCandidates":[') as line from chunk
      union all select conv_id, turn, 1, 0, 0, 0, '', concat(case when nth > 1 then ',' else '' end,
        '{{"candidateIndex":', turn, ',"lineItems":[') from bill
      union all select conv_id, turn, 2, 1, i, 0, '', concat(case when i > 0 then ',' else '' end,
        '{{"description":{{"value":"TOLLFARE T', i, '","confidence":0.9}},"quantity":{{"value":null,"confidence":1.0}},',
        '"unit":{{"value":null,"confidence":1.0}},"unitPrice":{{"value":null,"confidence":1.0}},',
        '"discount":{{"value":null,"confidence":1.0}},"amount":{{"value":', i, '.5,"confidence":0.9}}}}') from toll
      union all select conv_id, turn, 3, 0, 0, 0, '', '],"regions":[' from bill
      union all select conv_id, cand_pos, 4, turn, 0, 0, '',
        concat(case when turn > min(turn) over (partition by conv_id, cand_pos) then ',' else '' end, {_WHOLE_PAGE_SQL}) from owned
      union all select conv_id, turn, 5, 0, 0, 0, '', '],"evidence":[' from bill
      union all select conv_id, cand_pos, 6, stage, turn, 0, role, concat(
        case when row_number() over (partition by conv_id, cand_pos order by stage, turn) > 1 then ',' else '' end,
        '{{"role":"', role, '","regions":[', {_WHOLE_PAGE_SQL}, ']}}') from tag
      union all select conv_id, turn, 7, 0, 0, 0, '', ']}}' from bill
      union all select conv_id, 9223372036854775807, 8, 0, 0, 0, '', ']}}}}' from chunk)
    select conv_id as chunk_id, cand_pos::bigint as cand_pos, kind::int as kind, a::bigint as a, b::bigint as b,
      c::bigint as c, d, line from line""",
)
def response_lines_query(spark, d):
    """User turns as bills with the pages after them, made-up tolls and tags by text length."""
    pages, bills, owned = _owned(spark, d)
    items = F.array().cast(T.ArrayType(LINE_ITEM))
    ledger = new_ledger(bills.select(
        "chunk_id", "cand_pos", F.col("page_index").alias("chunkPageIndex"),
        F.col("cand_pos").cast("int").alias("candidateIndex"), items.alias("lineItems")))
    tolls = bills.select("chunk_id", "cand_pos", F.explode(F.expr("sequence(0L, cand_pos % 3)")).alias("item_no")).where(
        "item_no < cand_pos % 3")
    tags = [(2, "receipt"), (3, "transfer_slip")]
    held = owned.join(pages.select("chunk_id", "page_index", F.length("text").alias("chars")), ["chunk_id", "page_index"])
    evidence = held.select("chunk_id", "cand_pos", F.explode(F.array_compact(F.array(*[
        F.when(F.col("chars") % n == 0, F.lit(role)) for n, role in tags]))).alias("role"), "page_index")
    ledger = ledger.but(
        spans=owned, evidence=evidence,
        tickets=tolls.select("chunk_id", "cand_pos", "item_no", F.concat(F.lit("T"), "item_no").alias("ref"),
                             (F.col("item_no") + 0.5).alias("amount"), F.lit(None).cast("string").alias("ticket_date")))
    return response_lines(pages, ledger, heads=["candidateIndex"]).select("chunk_id", "cand_pos", "kind", "at.*", "line")


@query(
    "contract_columns",
    """select conv_id as chunk_id, turn::int as "candidateIndex", turn::int as "chunkPageIndex"
       from conversations""",
)
def contract_columns(spark, d):
    rows = turns(spark, d).select(
        "chunk_id", F.col("page_index").alias("candidateIndex"),
        F.col("page_index").alias("chunkPageIndex"), F.lit(True).alias("joins"), "text",
    )
    return strip_internal(rows)


# ------------------------------------------------------------------------------------ tickets

def _toll_text():
    """View events as ticket pages: a flat ticket, its copy when cheap, a table ticket when dear."""
    ref = F.format_string("%d", 500000 + F.col("chunk_id") * 7 + F.floor(F.col("value") / 20))
    flat = F.format_string(
        "EXAT Receipt Running No : %s Date Time %s Baht(Vat Included) %.2f\n",
        ref, F.date_format("ts", "dd/MM/yyyy"), F.floor("value") + F.lit(0.5),
    )
    table_ = F.format_string(
        "<td>No.</td><td>%d</td><td>Baht(Non Vat)</td><td>25.00 บาท</td>", 700000 + F.floor("value")
    )
    text_ = F.concat(
        flat,
        F.when(F.col("value") < 10, flat).otherwise(F.lit("")),
        F.when(F.col("value") > 30, table_).otherwise(F.lit("")),
        F.lit("Receipt Running No : 999999"),
    )
    return F.when(F.col("event_type") == "view", text_)


_TICKETS_SQL = f"""{EV_SQL},
  views as (select user_id, page, value, ts from ev where event_type = 'view'),
  raw as (select user_id, page, 0 as pos, (500000 + user_id * 7 + floor(value / 20)::bigint)::varchar as ref,
      floor(value) + 0.5 as amount, true as vat_included, strftime(ts, '%Y-%m-%d') as ticket_date
      from views
    union all select user_id, page, 1, (700000 + floor(value)::bigint)::varchar, 25.0, false, null
      from views where value > 30)"""


@query(
    "ticket_parse",
    f"""with {_TICKETS_SQL} select user_id as chunk_id, page::int as page_index, ref, amount,
       vat_included, ticket_date from raw""",
)
def ticket_parse(spark, d):
    pages = event_pages(spark, d, "event_type", "value").select(
        "chunk_id", "page_index", _toll_text().alias("toll_text")
    ).where(F.col("toll_text").isNotNull())
    return tickets.parse_tickets(pages, "toll_text", RECEIPTS).drop("pos")


@query(
    "ticket_images",
    f"""with {EV_SQL} select user_id as chunk_id, page::int as page_index,
      (2 + (value < 10)::int + (value > 30)::int)::int as images from ev where event_type = 'view'""",
)
def ticket_images(spark, d):
    pages = event_pages(spark, d, "event_type", "value").withColumn("t", _toll_text()).where(
        F.col("t").isNotNull()
    )
    return pages.select(
        "chunk_id", "page_index", tickets.ticket_images(F.col("t"), RECEIPTS).alias("images")
    )


@query(
    "ticket_sum",
    f"""with {_TICKETS_SQL},
    buyers as (select distinct user_id from ev where event_type = 'purchase' and value > 30),
    runs as (select user_id, page, value, min(page) over (partition by user_id, g) as run from (
        select *, page - row_number() over (partition by user_id order by page) as g from views
        where user_id in (select user_id from buyers)) x),
    kept as (select r.user_id, r.run, ref, arg_min(amount, t.page * 10 + pos) as amount,
        arg_min(ticket_date, t.page * 10 + pos) as d
        from runs r join raw t on t.user_id = r.user_id and t.page = r.page group by 1, 2, 3),
    sums as (select user_id, run, round(sum(amount), 2) as total, min(d) as day, count(*) as n
        from kept group by 1, 2),
    bills as (select user_id, page, value from ev where event_type in ('view', 'purchase')
        and value >= 3),
    own as (select r.user_id, r.run, min(b.page) as base, count(*) as replaced from runs r
        join bills b on b.user_id = r.user_id and b.page = r.page group by 1, 2),
    act as (select * from sums join own using (user_id, run)),
    gone as (select b.user_id, b.page from bills b join runs r using (user_id, page)
        join act a on a.user_id = b.user_id and a.run = r.run where b.page <> a.base)
    select b.user_id as chunk_id, b.page::bigint as cand_pos, coalesce(a.run, b.page)::int as page_index,
      coalesce(a.total, b.value) as total, coalesce(a.day, case when a.run is null then 'none' end) as day,
      coalesce(a.n, 0)::bigint as tickets
    from bills b left join act a on a.user_id = b.user_id and a.base = b.page
    where not exists (select 1 from gone g where g.user_id = b.user_id and g.page = b.page)""",
)
def ticket_sum(spark, d):
    """Runs of view pages of users with a larger purchase, summed into one bill each."""
    e = event_pages(spark, d, "event_type", "value").withColumn(
        "chunk_key", F.col("chunk_id").cast("string")
    )
    facts = e.select(
        F.col("chunk_key").alias("chunk_id"), "page_index",
        (F.col("event_type") == "view").alias("is_toll"), _toll_text().alias("toll_text"),
    )
    billed = e.where(F.col("event_type").isin("view", "purchase") & (F.col("value") >= 3))
    given = {
        "originalTotal": F.col("value"), "clearingAmount": F.col("value"),
        "amountBeforeVat": F.col("value"), "vat": F.lit(0.0), "vatRate": F.lit(7.0),
        "originalDocumentNumber": F.lit("n"), "documentBookNumber": F.lit("b"),
        "documentDate": F.lit("none"),
    }
    bills = cells(
        billed,
        [F.col("chunk_key").alias("chunk_id"), F.col("page_index").cast("long").alias("cand_pos"),
         F.col("page_index").alias("chunkPageIndex")],
        given,
    ).withColumn("lineItems", F.array().cast("array<string>"))
    flagged = e.where("event_type = 'purchase' and value > 30").select(
        F.col("chunk_key").alias("chunk_id")
    )
    ledger = tickets.sum_tickets(new_ledger(bills), facts, flagged, RECEIPTS)
    listed = ledger.tickets.groupBy("chunk_id", "cand_pos").agg(F.count(F.lit(1)).alias("tickets"))
    return ledger.bills.join(listed, ["chunk_id", "cand_pos"], "left").select(
        F.col("chunk_id").cast("long").alias("chunk_id"), "cand_pos",
        F.col("chunkPageIndex").alias("page_index"), val("originalTotal").alias("total"),
        val("documentDate").alias("day"), F.coalesce("tickets", F.lit(0)).alias("tickets"),
    )


@query(
    "unreferenced_pages",
    f"""with {EV_SQL} select user_id as chunk_id, count(*)::bigint as pages from ev e
      where not exists (select 1 from ev p where p.user_id = e.user_id and p.event_type = 'purchase'
        and p.page = e.page) and exists (select 1 from ev q where q.user_id = e.user_id
        and q.event_type = 'error') group by user_id""",
)
def unreferenced_pages(spark, d):
    """Set difference and semi-join on pages: pages that are no bill, in chunks that have a card."""
    pages = event_pages(spark, d, "event_type")
    bills = pages.where("event_type = 'purchase'").select("chunk_id", "page_index")
    carded = pages.where("event_type = 'error'").select("chunk_id").distinct()
    left = pages.join(bills, ["chunk_id", "page_index"], "left_anti")
    return left.join(carded, "chunk_id", "left_semi").groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("pages")
    )


@query(
    "longest_pages",
    """select conv_id as chunk_id, turn::int as page_index, role from conversations
       order by length(text) desc, conv_id, turn limit 20""",
)
def longest_pages(spark, d):
    """Ordering with a limit: the twenty longest pages as a report."""
    return turns(spark, d).orderBy(
        F.length("text").desc(), "chunk_id", "page_index"
    ).limit(20).select("chunk_id", "page_index", "role")


@query(
    "distinct_first_seen",
    r"""with w as (select doc_id, regexp_extract_all(lower(text), '\b[a-z]{9}\b') as words from documents)
    select doc_id, array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i), ' ') as words
    from w""",
)
def distinct_first_seen(spark, d):
    """Duplicates removed in order of first appearance."""
    words = F.regexp_extract_all(
        F.lower("text"), F.lit(r"(?<![A-Za-z0-9_])[a-z]{9}(?![A-Za-z0-9_])"), 0
    )
    return table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.array_join(F.array_distinct(words), " ").alias("words")
    )
