"""Linkage queries: certificates, cards, slips and the assembly of bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrecon.catalog.demo import PROSE
from docrecon.catalog.registry import query, table
from docrecon.catalog.shapes import EV_SQL, cells, event_pages
from docrecon.functions import ids
from docrecon.functions.fields import typed_cell, val
from docrecon.functions.names import norm_name
from docrecon.operators import slips
from docrecon.operators.assemble import assemble
from docrecon.operators.cards import asof_owner
from docrecon.operators.certificates import ALWAYS, find_targets, tax_ids_for
from docrecon.operators.ledger import audit_rows
from docrecon.operators.ordered import running_count
from docrecon.operators.scoring import guard_audit
from docrecon.profile import LUHN_16


@query(
    "card_asof_attach",
    f"""with {EV_SQL} , m as (select user_id, page, event_type, max(case when event_type = 'purchase'
       then page end) over (partition by user_id order by page rows between unbounded preceding and
       1 preceding) as owner from ev where event_type in ('error', 'purchase'))
    select user_id as chunk_id, page::int as page_index, owner::bigint as cand_pos from m
    where event_type = 'error'""",
)
def card_asof_attach(spark, d):
    """Errors as card pages, purchases as bills."""
    e = event_pages(spark, d, "event_type")
    bills = e.where("event_type = 'purchase'").select(
        "chunk_id", F.col("page_index").cast("long").alias("cand_pos"),
        F.col("page_index").alias("chunkPageIndex"),
    )
    return asof_owner(e.where("event_type = 'error'").select("chunk_id", "page_index"), bills)


_SLIPS_SQL = f"""{EV_SQL},
  s as (select user_id, page, case when value < 80 then floor(value) end as amount from ev
        where event_type = 'click'),
  b as (select user_id, page, case when value > 5 then floor(value) end as paid,
        floor(value) + 0.04 as gross from ev where event_type = 'purchase'),
  p as (select s.user_id, s.page as slip, s.amount, b.page as bill from s left join b
        on b.user_id = s.user_id and (abs(b.paid - s.amount) <= 0.05 or abs(b.gross - s.amount) <= 0.05)),
  h as (select user_id, slip, any_value(amount) as amount, count(bill) as hits,
        case when count(bill) = 1 then min(bill) end as bill from p group by user_id, slip),
  r as (select *, case when hits = 1 then count(*) over (partition by user_id, bill) end as rivals from h),
  judged as (select user_id, slip, amount, hits, bill, rivals, hits = 1 and rivals = 1 as matched from r)"""


def _judged_slips(spark, d):
    e = event_pages(spark, d, "event_type", "value")
    asked = e.where("event_type = 'click'").select(
        "chunk_id", F.col("page_index").alias("slip_id"),
        F.when(F.col("value") < 80, F.floor("value").cast("double")).alias("amount"),
    )
    bills = e.where("event_type = 'purchase'").select(
        "chunk_id", F.col("page_index").cast("long").alias("bill_id"),
        F.when(F.col("value") > 5, F.floor("value").cast("double")).alias("paid"),
        (F.floor("value") + F.lit(0.04)).alias("gross"),
    )
    return slips.match_amounts(asked, bills, 0.05)


@query(
    "slip_unique_match",
    f"""with {_SLIPS_SQL} select user_id as chunk_id, slip::int as slip_id, amount, hits::bigint as hits,
       bill::bigint as bill_id, coalesce(rivals, 0)::bigint as rivals, matched from judged""",
)
def slip_unique_match(spark, d):
    return _judged_slips(spark, d).withColumn("rivals", F.coalesce("rivals", F.lit(0)))


@query(
    "guard_audit",
    f"""with {_SLIPS_SQL}, m as (select user_id, page, event_type, max(case when event_type = 'purchase'
        then page end) over (partition by user_id order by page rows between unbounded preceding and
        1 preceding) as owner from ev where event_type in ('error', 'purchase')),
    a as (select 'slip' as step, matched as attached, case when amount is null then 'amount-unread'
        when hits = 0 then 'no-bill'
        when hits > 1 then 'many-bills'
        when rivals > 1 then 'many-slips' else 'folded' end as reason
        from judged
      union all select 'card', owner is not null, case when owner is null then 'no bill before the card'
        else 'page attached' end from m where event_type = 'error')
    select step, attached, reason, count(*)::bigint as n from a group by all""",
)
def guard_audit_query(spark, d):
    judged = _judged_slips(spark, d)
    slip = audit_rows(
        judged, "slip", page_index=F.col("slip_id"), cand_pos=F.col("bill_id"),
        attached=F.col("matched"),
        reason=F.coalesce(
            slips.slip_reason(F.col("amount"), F.col("hits"), F.col("rivals")), F.lit("folded")
        ),
    )
    owned = card_asof_attach(spark, d)
    card = audit_rows(
        owned, "card", attached=F.col("cand_pos").isNotNull(),
        reason=F.when(F.col("cand_pos").isNull(), F.lit("no bill before the card")).otherwise(
            F.lit("page attached")
        ),
    )
    return guard_audit(slip.unionByName(card))


# Orders of a customer are the pages of a chunk; orders in status P are certificates.
_CERT_SQL = """o as (select o_custkey as chunk, row_number() over (partition by o_custkey
      order by o_orderdate, o_orderkey) - 1 as page, o_orderstatus as s, o_orderpriority as pri,
      floor(o_totalprice / 100000) * 1000 + 1000 as base, strftime(o_orderdate, '%Y') as day,
      o_orderkey from orders),
  c as (select chunk, page, base, day, nullif(pri, '2-HIGH') as name,
      case when pri < '4' then left(pri, 1) end as tax_id from o where s = 'P'),
  b as (select chunk, page, case when pri <> '1-URGENT' then base end as base,
      case when pri <> '5-LOW' then day end as day, nullif(pri, '3-MEDIUM') as name,
      case when pri > '3' and s = 'F' then 'x' || pri end as field_id, s, pri from o where s <> 'P'),
  bid as (select distinct chunk, page, left(pri, 1) as tax_id from b where pri < '5' and s = 'O'
      union select chunk, page, '2' from b where pri like '4%' and s = 'F'),
  pr as (select c.chunk, c.page, b.page as bill, b.field_id, b.base as bb, b.day as bd,
      c.base = b.base as v_base, c.day = b.day as v_day,
      lower(replace(c.name, ' ', '')) = lower(replace(b.name, ' ', '')) as v_name,
      case when c.tax_id is not null and exists (select 1 from bid where bid.chunk = b.chunk
             and bid.page = b.page) then exists (select 1 from bid where bid.chunk = b.chunk
             and bid.page = b.page and bid.tax_id = c.tax_id) end as v_id
      from c join b on b.chunk = c.chunk),
  hit as (select * from pr where coalesce(v_base, true) and coalesce(v_day, true)
      and coalesce(v_name, true) and coalesce(v_id, true)
      and coalesce(v_base::int, 0) + coalesce(v_day::int, 0) + coalesce(v_name::int, 0)
        + coalesce(v_id::int, 0) >= 2),
  tgt as (select chunk, page, min(bill) as bill from hit group by chunk, page
      having count(distinct concat_ws('|', coalesce(field_id, '~'), coalesce(bb::varchar, '~'),
        coalesce(bd, '~'))) = 1)"""


def _certificates(spark, d):
    """(certificates, bills, bill ids) made of orders."""
    o = table(
        spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority",
    ).withColumnRenamed("o_custkey", "chunk_id")
    o = running_count(
        o, ["chunk_id"], ["o_orderdate", "o_orderkey"], "page",
        block=F.unix_date(F.to_date("o_orderdate")).cast("long"),
    )
    pri, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    base = F.floor(F.col("o_totalprice") / 100000).cast("double") * 1000 + 1000
    day = F.date_format("o_orderdate", "yyyy")
    page = F.col("page").cast("int")
    certs = o.where(s == "P").select(
        "chunk_id", page.alias("page_index"), base.alias("base"), day.alias("day"),
        norm_name(F.when(pri != "2-HIGH", pri), PROSE.branch_suffix).alias("name"),
        F.when(pri < "4", F.left(pri, F.lit(1))).alias("tax_id"),
    )
    given = {
        "amountBeforeVat": F.when(pri != "1-URGENT", base),
        "documentDate": F.when(pri != "5-LOW", day),
        "sellerName": F.when(pri != "3-MEDIUM", pri),
        "sellerTaxId": F.when((pri > "3") & (s == "F"), F.concat(F.lit("x"), pri)),
        "withholdingTax": F.when(pri > "3", F.lit(0.0)),
    }
    rest = o.where(s != "P")
    bills = cells(
        rest, ["chunk_id", F.col("page").cast("long").alias("cand_pos"), page.alias("chunkPageIndex")],
        given,
    )
    stated = rest.where((pri < "5") & (s == "O")).select(
        "chunk_id", F.col("page").cast("long").alias("cand_pos"), F.left(pri, F.lit(1)).alias("tax_id")
    )
    two = rest.where(pri.startswith("4") & (s == "F")).select(
        "chunk_id", F.col("page").cast("long").alias("cand_pos"), F.lit("2").alias("tax_id")
    )
    known = stated.unionByName(two).distinct().withColumn("since", F.lit(ALWAYS))
    return certs, bills, known


@query(
    "certificate_link",
    f"""with {_CERT_SQL} select chunk as chunk_id, page::int as page_index, bill::bigint as cand_pos
        from tgt""",
)
def certificate_link(spark, d):
    certs, bills, known = _certificates(spark, d)
    return find_targets(certs, bills, known, PROSE)


@query(
    "certificate_taxes",
    f"""with {_CERT_SQL},
    f as (select t.chunk, t.bill, arg_min(c.base, t.page) as base, count(*) as pages from tgt t
          join c on c.chunk = t.chunk and c.page = t.page group by t.chunk, t.bill)
    select b.chunk as chunk_id, b.page::bigint as cand_pos, f.base as tax_of, f.pages::bigint as pages
    from b join f on f.chunk = b.chunk and f.bill = b.page""",
)
def certificate_taxes(spark, d):
    """What crosses to a bill: the first certificate's figures, and how many pages it gains."""
    certs, bills, known = _certificates(spark, d)
    found = find_targets(certs, bills, known, PROSE)
    with_base = found.join(certs.select("chunk_id", "page_index", "base"), ["chunk_id", "page_index"])
    firsts = with_base.groupBy("chunk_id", "cand_pos").agg(
        F.min_by("base", "page_index").alias("tax_of"), F.count(F.lit(1)).alias("pages")
    )
    return bills.select("chunk_id", "cand_pos").join(firsts, ["chunk_id", "cand_pos"])


@query(
    "page_tax_ids",
    r"""
    with w as (select doc_id, source, unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'),
        lambda w: regexp_full_match(w, '[0-9]{16}'))) as id from documents),
    v as (select *, (10 - list_sum(list_transform(range(1, 16), lambda i: case when i % 2 = 1
        then (substr(id, i, 1)::int * 2) - (case when substr(id, i, 1)::int > 4 then 9 else 0 end)
        else substr(id, i, 1)::int end)) % 10) % 10 = substr(id, 16, 1)::int as valid from w)
    select source as chunk_id, doc_id // 3 as cand_pos, id as tax_id from v where valid
    group by all
    """,
)
def page_tax_ids(spark, d):
    """Bills of three neighbouring documents; ids printed on any of their pages count."""
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    facts = docs.select(
        F.col("source").alias("chunk_id"), F.col("doc_id").cast("int").alias("page_index"),
        ids.valid_ids(ids.extract_ids(F.col("text"), 16), LUHN_16).alias("ids"),
    )
    pos = F.floor(F.col("doc_id") / 3).cast("long")
    spans = docs.select(
        F.col("source").alias("chunk_id"), pos.alias("cand_pos"),
        F.col("doc_id").cast("int").alias("page_index"),
    )
    bills = spans.select("chunk_id", "cand_pos").distinct().withColumn(
        "sellerTaxId", typed_cell("sellerTaxId", None, 0.0)
    )
    return tax_ids_for(bills, spans, facts, PROSE)


@query(
    "assemble_bills",
    """
    with m as (select o_custkey as chunk, o_orderkey, row_number() over (partition by o_custkey
         order by o_orderdate, o_orderkey) - 1 as page, o_orderstatus as s, o_orderpriority as pri,
         o_totalprice as total from orders),
    kept as (select *, row_number() over (partition by chunk order by page) - 1 as cand_pos from m
         where s <> 'P' or pri like '1%')
    select chunk as chunk_id, cand_pos::bigint as cand_pos, 0 as "candidateIndex",
      page::int as "chunkPageIndex", case when s <> 'P' then total end as total,
      case when s = 'O' then '4444333322221111' end as seller_id,
      (case when s = 'O' then 0.7 else 0.0 end)::double as seller_id_conf,
      case when pri like '4%' or s <> 'F' then 'no ' || pri end as doc_number,
      (case when pri like '4%' or s <> 'F' then 0.7 else 0.0 end)::double as doc_number_conf,
      case when pri like '5%' then null else pri end as method,
      case when s = 'F' then 'Example Holdings' end as buyer,
      (case when s = 'F' then 1.0 else 0.0 end)::double as buyer_conf, 1 as items
    from kept
    """,
)
def assemble_bills(spark, d):
    """Orders as model candidates through the guards, parties and the own-party constant."""
    o = table(
        spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority",
    ).withColumnRenamed("o_custkey", "chunk_id")
    o = running_count(
        o, ["chunk_id"], ["o_orderdate", "o_orderkey"], "page_index",
        block=F.unix_date(F.to_date("o_orderdate")).cast("long"),
    )
    s, pri = F.col("o_orderstatus"), F.col("o_orderpriority")
    number = F.concat(F.lit("no "), pri)
    page_text = (
        F.when(pri.startswith("4") & (s != "P"),
               F.concat(F.lit("cost of "), number, F.when(s == "F", F.lit(" 555-0000")).otherwise(F.lit(""))))
        .when(s == "F", F.concat(F.lit("here "), number, F.lit(" 555-0000")))
        # Kept regardless of money only where the page is a certificate.
        .when(pri.startswith("1") & (s == "P"), F.lit("the and "))
        .otherwise(F.lit("nothing"))
    )
    from docrecon.schema import CELL_FIELDS, LINE_ITEM

    given = {
        "originalTotal": F.when(s != "P", F.col("o_totalprice")),
        "sellerTaxId": F.when(s == "O", F.lit("4444 3333 2222 1111")).otherwise(F.lit("44")),
        "originalDocumentNumber": number,
        "paymentMethod": F.when(pri.startswith("5"), F.lit("card XXXX1234")).otherwise(
            F.concat(F.lit(" "), pri, F.lit(" "))
        ),
        "sellerName": F.lit("shop"),
    }
    wide = {f: typed_cell(f, given.get(f), 0.7 if f in given else None) for f in CELL_FIELDS}
    item = F.array(F.struct(*[F.lit(None).alias(f.name) for f in LINE_ITEM.fields]).cast(LINE_ITEM))
    raw = o.select(
        "chunk_id", "page_index", F.lit(0).alias("page_pos"), page_text.alias("transcript"),
        *[c.alias(f) for f, c in wide.items()], item.alias("lineItems"),
    )
    out = assemble(raw, PROSE)
    return out.select(
        "chunk_id", "cand_pos", "candidateIndex", "chunkPageIndex",
        val("originalTotal").alias("total"), val("sellerTaxId").alias("seller_id"),
        F.col("sellerTaxId.confidence").alias("seller_id_conf"),
        val("originalDocumentNumber").alias("doc_number"),
        F.col("originalDocumentNumber.confidence").alias("doc_number_conf"),
        val("paymentMethod").alias("method"), val("buyerName").alias("buyer"),
        F.col("buyerName.confidence").alias("buyer_conf"), F.size("lineItems").alias("items"),
    )
