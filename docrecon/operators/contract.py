"""The response contract: nesting a ledger into it and checking candidates against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.operators.ledger import BILL_KEY, Ledger
from docrecon.operators.spans import live, valid_box, whole_page
from docrecon.schema import CELL_FIELDS, ITEM_FIELDS, PAYEE_TYPES

# Order in which the steps add roles to a bill: cards, then slips, then headings.
_STAGE = {"id_document": 0, "transfer_slip": 1}


def strip_internal(bills: DataFrame, keep=("chunk_id",)) -> DataFrame:
    """Drop bookkeeping columns that are no contract keys."""
    allowed = {*keep, *CONTRACT_KEYS}
    return bills.select(*[c for c in bills.columns if c in allowed])


CONTRACT_KEYS = [
    "candidateIndex", "chunkPageIndex", *CELL_FIELDS, "relatedDocumentNumber", "lineItems",
    "regions", "evidence",
]


def _ticket_item() -> Column:
    def cell(value, confidence, kind):
        return F.struct(
            value.cast(kind).alias("value"), F.lit(confidence).cast("double").alias("confidence")
        )

    none = F.lit(None)
    kinds = {"description": "string", "unit": "string"}
    given = {
        "description": (F.concat(F.lit("TOLLFARE "), "ref"), 0.9),
        "amount": (F.col("amount"), 0.9),
    }
    return F.struct(
        *[
            cell(*given.get(f, (none, 1.0)), kinds.get(f, "double")).alias(f) for f in ITEM_FIELDS
        ]
    )


def nest(ledger: Ledger) -> DataFrame:
    """Bills with ``regions``, ``evidence`` and ticket line items nested: one row for each bill.

    A row holds all that one bill owns; ``response_lines`` and ``ledger_errors`` work without such
    rows.
    """
    spans = live(ledger.spans, ledger.bills)
    regions = spans.groupBy(*BILL_KEY).agg(
        F.transform(F.array_sort(F.collect_list("page_index")), whole_page).alias("regions")
    )
    evidence = ranked_tags(ledger).groupBy(*BILL_KEY).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("stage").alias("s"), "page_index",
                                                 F.col("rank").alias("r"), "role"))),
            lambda e: F.struct(
                e["role"].alias("role"), F.array(whole_page(e["page_index"])).alias("regions")
            ),
        ).alias("evidence")
    )
    tickets = ledger.tickets.groupBy(*BILL_KEY).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("item_no", _ticket_item().alias("item")))),
            lambda e: e["item"],
        ).alias("items")
    )
    keep = [c for c in ledger.bills.columns if c not in ("lineItems", "regions", "evidence")]
    out = ledger.bills
    for side in (regions, evidence, tickets):
        out = out.drop(side.columns[-1]).join(side, BILL_KEY, "left")
    return out.select(
        *keep,
        F.concat("lineItems", F.coalesce("items", F.array().cast(_items_type(ledger)))).alias("lineItems"),
        F.coalesce("regions", F.array()).alias("regions"),
        F.coalesce("evidence", F.array()).alias("evidence"),
    )


def _items_type(ledger: Ledger) -> str:
    return ledger.bills.schema["lineItems"].dataType.simpleString()


# Kinds of a response's lines, in the order they stand in.
CHUNK_HEAD, BILL_HEAD, ITEM, REGIONS, REGION, EVIDENCE, TAG, BILL_END, CHUNK_END = range(9)
LINE_ORDER = "chunk_id", "cand_pos", "kind", "at"


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _line(df: DataFrame, kind: int, text: Column, at: Column | None = None, cand_pos: Column | None = None) -> DataFrame:
    """Rows as lines; ``at`` orders the lines of one kind in a bill."""
    zero, none = F.lit(0).cast("long"), F.lit("")
    place = at if at is not None else F.struct(zero.alias("a"), zero.alias("b"), zero.alias("c"), none.alias("d"))
    return df.select(
        "chunk_id", (F.col("cand_pos") if cand_pos is None else cand_pos).cast("long").alias("cand_pos"),
        F.lit(kind).alias("kind"), place.alias("at"), text.alias("line"))


def _place(a, b=None, c=None, d=None) -> Column:
    whole = [(F.lit(0) if x is None else x).cast("long").alias(n) for n, x in zip("abc", (a, b, c))]
    return F.struct(*whole, F.coalesce(d, F.lit("")).alias("d") if d is not None else F.lit("").alias("d"))


def _listed(rows: DataFrame, kind: int, at: Column, value: Column) -> DataFrame:
    """Elements of a bill's list; all but the first begin with a comma."""
    placed = rows.select(*BILL_KEY, at.alias("at"), _json(value).alias("json"))
    first = placed.groupBy(*BILL_KEY).agg(F.min("at").alias("first"))
    joined = placed.join(first, BILL_KEY)
    return _line(joined, kind, F.concat(F.when(F.col("at") == F.col("first"), F.lit("")).otherwise(F.lit(",")), "json"), F.col("at"))


def response_lines(chunks: DataFrame, ledger: Ledger, heads=None) -> DataFrame:
    """(chunk_id, cand_pos, kind, at, line): the response of every chunk, line by line.

    Read in this order, the lines of a chunk are one JSON document, whatever the chunk's size:
    ``{"chunk_id": ..., "response": {"billCandidates": [...]}}``.  A bill's cells are one line, and
    each of its items, regions and tags is one; no row holds a bill's pages or a chunk's bills, and
    nothing is gathered.  A chunk without bills gives an empty list.

    ``heads`` names the bill columns before the lists, by default the contract's keys.
    """
    bills = ledger.bills
    heads = heads or [c for c in CONTRACT_KEYS if c in bills.columns and c not in ("lineItems", "regions", "evidence")]
    least, most = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    names = chunks.select("chunk_id").distinct()
    first = bills.groupBy("chunk_id").agg(F.min("cand_pos").alias("first_bill"))
    comma = F.when(F.col("cand_pos") == F.col("first_bill"), F.lit("")).otherwise(F.lit(","))
    body = _json(F.struct(*heads))
    head = F.concat(comma, F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"lineItems":['))
    items = bills.select(*BILL_KEY, F.posexplode("lineItems").alias("n", "item")).select(
        *BILL_KEY, F.lit(0).alias("printed"), F.col("n").cast("long").alias("n"), "item")
    kind = items.schema["item"].dataType.simpleString()
    tolls = live_rows(ledger.tickets, bills).select(
        *BILL_KEY, F.lit(1).alias("printed"), F.col("item_no").cast("long").alias("n"), _ticket_item().cast(kind).alias("item"))
    tags = ranked_tags(ledger)
    spans = live(ledger.spans, bills)
    parts = [
        _line(names, CHUNK_HEAD, F.concat(F.lit('{"chunk_id":'), F.expr("substring(to_json(array(chunk_id)), 2, length(to_json(array(chunk_id))) - 2)"),
                                          F.lit(',"response":{"billCandidates":[')), cand_pos=least),
        _line(bills.select(*BILL_KEY, body.alias("body")).join(first, "chunk_id"), BILL_HEAD, head),
        _listed(items.unionByName(tolls), ITEM, _place(F.col("printed"), F.col("n")), F.col("item")),
        _line(bills, REGIONS, F.lit('],"regions":[')),
        _listed(spans, REGION, _place(F.col("page_index")), whole_page(F.col("page_index"))),
        _line(bills, EVIDENCE, F.lit('],"evidence":[')),
        _listed(tags, TAG, _place(F.col("stage"), F.col("page_index"), F.col("rank"), F.col("role")),
                F.struct("role", F.array(whole_page(F.col("page_index"))).alias("regions"))),
        _line(bills, BILL_END, F.lit("]}")),
        _line(names, CHUNK_END, F.lit("]}}"), cand_pos=most),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def live_rows(side: DataFrame, bills: DataFrame) -> DataFrame:
    return side.join(bills.select(*BILL_KEY), BILL_KEY, "left_semi")


def ranked_tags(ledger: Ledger) -> DataFrame:
    """Evidence of live bills, each role of a page once, with ``stage`` and ``rank``: the order in
    which steps added the roles, and in which a page's headings stand."""
    rank = F.col("rank") if "rank" in ledger.evidence.columns else F.lit(0)
    stage = F.lit(len(_STAGE))
    for role, n in _STAGE.items():
        stage = F.when(F.col("role") == role, F.lit(n)).otherwise(stage)
    tags = live_rows(ledger.evidence, ledger.bills).groupBy(*BILL_KEY, "page_index", "role").agg(F.min(rank).alias("rank"))
    return tags.withColumns({"stage": stage, "rank": F.coalesce("rank", F.lit(0))})


def response_documents(
    chunks: DataFrame, bills: DataFrame, order: str, columns, shard: int
) -> DataFrame:
    """(chunk_id, part, response): ``{"billCandidates": [...]}`` per chunk, in parts of ``shard``
    positions, so that a row holds no more bills than that; a chunk without bills gives an empty
    list.  ``response_lines`` gives one document for a chunk of any size.
    """
    body = (
        bills.withColumn("part", F.floor(F.col(order) / shard).cast("int"))
        .groupBy("chunk_id", "part")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(order, F.struct(*columns).alias("body")))
            ).alias("rows")
        )
        .select("chunk_id", "part", F.transform("rows", lambda r: r["body"]).alias("list"))
    )
    named = chunks.select("chunk_id").distinct().join(body, "chunk_id", "left")
    return named.select(
        "chunk_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.when(F.col("list").isNull(), F.lit('{"billCandidates":[]}'))
        .otherwise(
            F.to_json(F.struct(F.col("list").alias("billCandidates")), {"ignoreNullFields": "false"})
        ).alias("response"),
    )


def owned_facts(ledger: Ledger, declared_roles) -> DataFrame:
    """Bills with ``pages``, ``tags`` and ``items``, how many of each they own, and whether a box or
    a role is wrong: counts over the long tables, nothing gathered."""
    spans, tags = live(ledger.spans, ledger.bills), ranked_tags(ledger)
    box = valid_box(whole_page(F.col("page_index")))
    pages = spans.groupBy(*BILL_KEY).agg(F.count(F.lit(1)).alias("pages"), F.bool_or(~box).alias("bad_box"))
    roles = tags.groupBy(*BILL_KEY).agg(
        F.count(F.lit(1)).alias("tags"), F.bool_or(~F.col("role").isin(list(declared_roles))).alias("bad_role"))
    tolls = live_rows(ledger.tickets, ledger.bills).groupBy(*BILL_KEY).agg(F.count(F.lit(1)).alias("tolls"))
    out = ledger.bills
    for side in (pages, roles, tolls):
        out = out.join(side, BILL_KEY, "left")
    none, no = F.lit(0), F.lit(False)
    return out.select(
        *ledger.bills.columns, *[F.coalesce(c, none).cast("int").alias(c) for c in ("pages", "tags")],
        (F.size("lineItems") + F.coalesce("tolls", none)).cast("int").alias("items"),
        F.coalesce("bad_box", no).alias("bad_box"), F.coalesce("bad_role", no).alias("bad_role"))


def ledger_errors(ledger: Ledger, declared_roles, cells=CELL_FIELDS) -> DataFrame:
    """``validate_contract`` on a ledger's long tables: ``owned_facts`` with ``ok`` and ``error``."""
    owned = owned_facts(ledger, declared_roles)
    sides = (F.col("pages") < 1, F.col("bad_box"), F.col("bad_role"))
    return _first_error(owned, contract_errors(declared_roles, cells, sides))


def contract_errors(declared_roles, cells=CELL_FIELDS, sides=None) -> Column:
    """Paths of everything wrong with a bill, in contract order.

    ``sides``: no region, a bad box, an undeclared role; by default read off the nested arrays.
    """
    bad = [
        F.when(F.col("candidateIndex").isNull() | (F.col("candidateIndex") < 0),
               F.lit("candidateIndex")),
        F.when(F.col("chunkPageIndex").isNull() | (F.col("chunkPageIndex") < 0),
               F.lit("chunkPageIndex")),
    ]
    for f in cells:
        c = F.col(f)
        bad.append(F.when(c.isNull(), F.lit(f)))
        bad.append(
            F.when(c.isNotNull() & ~F.coalesce(c["confidence"].between(0.0, 1.0), F.lit(False)),
                   F.lit(f"{f}/confidence"))
        )
    patterns = {"documentDate": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "currency": "^[A-Z]{3}$"}
    for f, pattern in patterns.items():
        if f in cells:
            bad.append(F.when(~F.col(f)["value"].rlike(pattern), F.lit(f"{f}/value")))
    if "payeeType" in cells:
        bad.append(
            F.when(~F.col("payeeType")["value"].isin(PAYEE_TYPES), F.lit("payeeType/value"))
        )
    if sides is None:
        sides = (
            F.coalesce(F.size("regions"), F.lit(0)) < 1, F.exists("regions", lambda r: ~valid_box(r)),
            F.exists("evidence", lambda e: ~e["role"].isin(list(declared_roles))),
        )
    bad += [F.when(wrong, F.lit(path)) for wrong, path in zip(sides, ("regions", "regions/box", "evidence/role"))]
    return F.array_compact(F.array(*bad))


def validate_contract(nested: DataFrame, declared_roles, cells=CELL_FIELDS) -> DataFrame:
    """Add ``ok`` and ``error`` (first path that fails)."""
    return _first_error(nested, contract_errors(declared_roles, cells))


def _first_error(df: DataFrame, errors: Column) -> DataFrame:
    return df.withColumn("__e", errors).select(
        *df.columns, (F.size("__e") == 0).alias("ok"), F.get("__e", F.lit(0)).alias("error")
    )


def json_key_errors(raw: Column, required, parsed: Column) -> Column:
    """First key problem of a JSON object: unreadable, undeclared key, missing key; null when fine."""
    keys = F.json_object_keys(raw)
    wanted = F.array(*[F.lit(k) for k in required])
    unknown = F.array_sort(F.array_except(keys, wanted))
    missing = F.array_except(wanted, keys)
    return (
        F.when(keys.isNull() | parsed.isNull(), F.lit("not an object"))
        .when(F.size(unknown) > 0, F.concat(F.get(unknown, F.lit(0)), F.lit(": not declared")))
        .when(F.size(missing) > 0, F.concat(F.get(missing, F.lit(0)), F.lit(": required")))
    )
