"""Join the parts of a bill that runs over a page break.

The rule is an ordered fold: the first candidate of a page may continue the bill that ended the
page before, judged against the bill *as filled so far*.  Only four identity values of the open
bill matter to the decision.

How it spreads: built-in tests on neighbouring rows find most page breaks that part bills whatever
is open (``hard``).  Rows between two of them form an island, and islands know nothing of each
other.  An island of two rows is decided in columns.  Longer ones are folded in streams, and one
that runs over several blocks of positions is folded block by block: rows that depend on the bill open before their block are
summed up by what any such bill would meet there, one pass over these summaries gives every block
its open bill, and these rows are folded again.  The number of passes is the same for any data.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.fields import norm_identity, val
from docrecon.functions.names import name_rule, names_agree, names_agree_by_edits, norm_name
from docrecon.operators.ledger import BILL_KEY, Ledger, audit_rows, new_ledger
from docrecon.operators.ordered import BLOCK, block_of, neighbours, running_count, running_last
from docrecon.operators.rounds import settle
from docrecon.profile import Profile
from docrecon.schema import CELL_FIELDS, cell_sql_type, is_number

# Workers need not have the package installed: the fold travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXACT = {"doc": "originalDocumentNumber", "total": "originalTotal", "day": "documentDate"}
STATE = ["doc", "seller", "total", "day"]
SELLER = STATE.index("seller")


def take(tail: list | None, values: list, continues: bool, same_name) -> list | None:
    """The open bill's values with a row's filled in, or null where the row does not join it."""
    if tail is None:
        return None
    agree = 0
    for at, (left, right) in enumerate(zip(tail, values)):
        if left is None or right is None:
            continue
        verdict = same_name(left, right) if at == SELLER else left == right
        if verdict is False:
            return None
        agree += verdict is True
    if not continues and agree < 2:
        return None
    return [b if a is None else a for a, b in zip(tail, values)]


class Piece:
    """Rows of an island within one block, summed up for any bill that may be open before them.

    While rows join, a combination of values that has joined once joins again: what it states, the
    open bill states too.  So only the first row of each combination can break.  Two values of an
    exact field break every bill, so nothing after them depends on what was open.
    """

    def __init__(self, rows: list[tuple], same_name):
        self.rows, self.same_name, self.ends = rows, same_name, {}

    def end(self, head: int) -> list:
        """The bill open after the last row when a new one starts at row ``head``."""
        heads = []
        while head not in self.ends:
            heads.append(head)
            tail, at = self.rows[head][1], head + 1
            while at < len(self.rows):
                joined = take(tail, self.rows[at][1], self.rows[at][0], self.same_name)
                if joined is None:
                    break
                tail, at = joined, at + 1
            if at == len(self.rows):
                self.ends[head] = tail
            else:
                head = at
        for h in heads:
            self.ends[h] = self.ends[head]
        return self.ends[head]

    def summary(self) -> list[dict]:
        """First rows of each combination up to the certain break, each with the bill open after the
        last row should the row break.  Values travel as lists of four."""
        seen, stated, out = set(), [None] * len(STATE), []
        for at, (continues, values) in enumerate(self.rows):
            mark = (continues, *values)
            if mark in seen:
                continue
            seen.add(mark)
            out.append({"continues": continues, "values": values, "end": self.end(at)})
            if any(a is not None and b is not None and a != b
                   for k, (a, b) in enumerate(zip(stated, values)) if k != SELLER):
                break
            stated = [b if a is None else a for a, b in zip(stated, values)]
        return out


def after(tail: list | None, summary: list[dict], same_name) -> list:
    """The bill open after a piece, given the one open before it."""
    for row in summary:
        joined = take(tail, row["values"], row["continues"], same_name)
        if joined is None:
            return row["end"]
        tail = joined
    return tail


_STRINGS = pa.list_(pa.string())
_ROW = pa.struct([("continues", pa.bool_()), ("values", _STRINGS), ("end", _STRINGS)])
_SUMMARY = "array<struct<continues boolean, values array<string>, end array<string>>>"


def _rows(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        yield from b.to_pylist()


def _out(schema: pa.Schema, rows, size: int = 4096):
    """Arrow batches of the rows of a generator."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def folded_blocks(rows: Iterator[dict], same_name):
    """First pass over rows sorted by chunk, block and position.

    Rows from a block's first hard row on are decided.  Rows before it depend on the bill open before
    the block: they leave undecided.  A block that takes a bill from the one before, or hands one to
    the next, adds a row without a position: its summary, and the bill open at its end where that
    does not depend on what came before.
    """
    for (chunk, blk), group in groupby(rows, key=itemgetter("chunk_id", "blk")):
        place = {"chunk_id": chunk, "blk": blk}
        leading, tail, handed = [], None, False
        for r in group:
            values = [r[c] for c in STATE]
            handed = not r["a1_hard"] and r["ends_block"]
            if tail is None and not r["hard"]:
                leading.append((r["continues"], values))
                yield {**place, "cand_pos": r["cand_pos"], **{c: r[c] for c in ("continues", *STATE)}}
                continue
            joined = None if r["hard"] else take(tail, values, r["continues"], same_name)
            tail = values if joined is None else joined
            yield {**place, "cand_pos": r["cand_pos"], "joins": joined is not None}
        if leading or handed:
            yield {**place, "summary": Piece(leading, same_name).summary(), "end": tail}


def scanned(blocks: Iterator[dict], same_name):
    """The bill open before each block that has undecided rows, from its chunk's sorted summaries."""
    for _, group in groupby(blocks, key=itemgetter("chunk_id")):
        tail = None
        for r in group:
            if r["summary"]:
                yield {"chunk_id": r["chunk_id"], "blk": r["blk"], "before": tail}
            tail = after(tail, r["summary"], same_name) if r["end"] is None else r["end"]


def folded(rows: Iterator[dict], same_name):
    """Decisions on the rows left undecided; ``before`` is the bill open before their block."""
    for _, group in groupby(rows, key=itemgetter("chunk_id", "blk")):
        tail = None
        for at, r in enumerate(group):
            values = [r[c] for c in STATE]
            joined = take(tail if at else r["before"], values, r["continues"], same_name)
            tail = values if joined is None else joined
            yield {"chunk_id": r["chunk_id"], "cand_pos": r["cand_pos"], "joins": joined is not None}


def boundary_facts(bills: DataFrame, pages: DataFrame, p: Profile) -> DataFrame:
    """Per bill: normal identity values, first/last on its page, and the facts of the page break.

    ``pages`` must list every page read, also those without bills: (chunk_id, page_index, marker).
    """
    # Each page goes to its own place and to that of the page after it.
    here = pages.select(
        "chunk_id", "page_index", "marker", F.explode(F.array(F.lit(0), F.lit(1))).alias("ahead")
    ).groupBy("chunk_id", (F.col("page_index") + F.col("ahead")).alias("chunkPageIndex")).agg(
        F.max(F.when(F.col("ahead") == 0, F.col("marker"))).alias("marker"),
        F.max(F.when(F.col("ahead") == 1, F.col("marker"))).alias("prev_marker"),
        F.max(F.col("ahead") == 1).alias("prev_read"),
    )
    rows = bills.select(
        *BILL_KEY, "chunkPageIndex",
        *[norm_identity(f, val(f)).alias(c) for c, f in EXACT.items()],
        norm_name(val("sellerName"), p.branch_suffix).alias("seller"),
    )
    # Candidates of one page are few, but a page may still be long: aggregate, then join back.
    ends = rows.groupBy("chunk_id", "chunkPageIndex").agg(
        F.min("cand_pos").alias("first_pos"),
        F.max("cand_pos").alias("last_pos"),
        F.count(F.lit(1)).alias("n_on_page"),
    )
    edges = ends.join(here, ["chunk_id", "chunkPageIndex"], "left")
    m, q = F.col("marker"), F.col("prev_marker")
    return rows.join(edges, ["chunk_id", "chunkPageIndex"]).select(
        *BILL_KEY, "chunkPageIndex", *STATE, "n_on_page",
        (F.col("cand_pos") == F.col("first_pos")).alias("is_first"),
        (F.col("cand_pos") == F.col("last_pos")).alias("is_last"),
        F.coalesce("prev_read", F.lit(False)).alias("prev_read"),
        F.coalesce((m["of"] == q["of"]) & (m["page"] == q["page"] + 1), F.lit(False)).alias(
            "continues"
        ),
    )


def _hard(row: Column, before: Column) -> Column:
    """Can this row join whatever the open bill looks like?  ``before`` is the row before it.

    That row is part of the open bill, so an exact value it states is the open bill's value too; a
    different one here is a conflict for certain.
    """
    stated = sum((row[c].isNotNull().cast("int") for c in STATE), F.lit(0))
    clash = F.lit(False)
    for c in EXACT:
        clash = clash | F.coalesce(row[c] != before[c], F.lit(False))
    can = row["is_first"] & row["prev_read"] & before.isNotNull() & (row["continues"] | (stated >= 2)) & ~clash
    return ~F.coalesce(can, F.lit(False))


def _verdicts(row: Column, before: Column, names: Column) -> Column:
    """Does the row join a bill that is nothing but the row before it?"""
    verdicts = [before[c] == row[c] for c in EXACT] + [names]
    agree = sum((F.coalesce(v.cast("int"), F.lit(0)) for v in verdicts), F.lit(0))
    conflict = sum((F.coalesce((~v).cast("int"), F.lit(0)) for v in verdicts), F.lit(0))
    return (conflict == 0) & (row["continues"] | (agree >= 2))


def merge_decisions(facts: DataFrame, p: Profile, block: int = BLOCK) -> DataFrame:
    """(chunk_id, cand_pos, joins): does the row continue the bill before it?

    ``cand_pos`` must be gapless within a chunk.  Rows that stand alone are left out.
    """
    rule = name_rule(p)
    row = F.struct(*STATE, "is_first", "prev_read", "continues")
    near = neighbours(facts, ["chunk_id"], "cand_pos", row, {"b2": -2, "b1": -1, "a1": 1, "a2": 2}, width=block)
    here = near.select(*BILL_KEY, row.alias("row"), "b2", "b1", "a1", "a2")
    row, b1, b2, a1, a2 = (F.col(c) for c in ("row", "b1", "b2", "a1", "a2"))
    # A row that is missing ends an island as a hard one does.
    marked = here.select(
        *BILL_KEY, "row", "b1", _hard(row, b1).alias("hard"), _hard(b1, b2).alias("b1_hard"),
        _hard(a1, row).alias("a1_hard"), _hard(a2, a1).alias("a2_hard"),
    ).where("not hard or not a1_hard")
    # Written once: the pairs and the longer islands both read it.
    marked = settle(marked.select(
        *BILL_KEY, "row", "b1", "hard", "a1_hard",
        F.when(F.col("hard"), F.col("a2_hard")).otherwise(F.col("b1_hard") & F.col("a1_hard")).alias("short"),
    ))
    pairs = marked.where("short and not hard").select(
        *BILL_KEY, _verdicts(F.col("row"), F.col("b1"), names_agree(F.col("b1")["seller"], F.col("row")["seller"], p)).alias("joins")
    )
    blk = block_of(F.col("cand_pos"), block)
    long = marked.where("not short").select(
        *BILL_KEY, blk.alias("blk"), "hard", "a1_hard", (F.pmod(F.col("cand_pos"), F.lit(block)) == block - 1).alias("ends_block"),
        "row.continues", *[F.col("row")[c].alias(c) for c in STATE])

    name = long.schema["chunk_id"].dataType.simpleString()
    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]
    key = [("chunk_id", kind), ("blk", pa.int64())]

    def stream(df: DataFrame, by: list[str], order: list[str], fields, ddl: str, work) -> DataFrame:
        schema = pa.schema(fields)
        return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(
            lambda batches: _out(schema, work(_rows(batches), lru_cache(maxsize=1 << 16)(rule))), f"chunk_id {name}, {ddl}")

    first = settle(stream(
        long, ["chunk_id", "blk"], ["cand_pos"],
        [*key, ("cand_pos", pa.int64()), ("joins", pa.bool_()), ("continues", pa.bool_()), *[(c, pa.string()) for c in STATE],
         ("summary", pa.list_(_ROW)), ("end", _STRINGS)],
        f"blk long, cand_pos long, joins boolean, continues boolean, {', '.join(f'{c} string' for c in STATE)}, "
        f"summary {_SUMMARY}, end array<string>", folded_blocks))
    blocks = first.where("cand_pos is null").select("chunk_id", "blk", "summary", "end")
    before = stream(blocks, ["chunk_id"], ["blk"], [*key, ("before", _STRINGS)], "blk long, before array<string>", scanned)
    left = first.where("cand_pos is not null and joins is null").select("chunk_id", "blk", "cand_pos", "continues", *STATE)
    late = stream(left.join(before, ["chunk_id", "blk"]), ["chunk_id", "blk"], ["cand_pos"],
                  [key[0], ("cand_pos", pa.int64()), ("joins", pa.bool_())], "cand_pos long, joins boolean", folded)
    return pairs.unionByName(first.where("joins is not null").select(*BILL_KEY, "joins")).unionByName(late)


def merge_spanning(
    bills: DataFrame, pages: DataFrame, p: Profile, *, block: int = BLOCK
) -> Ledger:
    """Fold page-spanning bills together and number the result.

    Values already stated stay; missing cells take the first later part that states them.  Only
    cells cross over, so line items of later parts are dropped.
    """
    # What decides is read several times, so it is cut out of the wide rows once.
    slim = settle(bills.select(*BILL_KEY, "chunkPageIndex", *EXACT.values(), "sellerName"))
    decisions = settle(merge_decisions(boundary_facts(slim, pages, p), p, block))
    lean = slim.select(*BILL_KEY).join(decisions, BILL_KEY, "left").withColumn(
        "joins", F.coalesce("joins", F.lit(False))
    )
    head = F.when(~F.col("joins"), F.col("cand_pos"))
    heads = settle(running_last(lean, ["chunk_id"], ["cand_pos"], head, "head"))
    # Numbered before the wide rows come in, so that these are dealt and sorted once; a row without a
    # position meets no bill and takes no number.
    number = running_count(heads.where("not joins and cand_pos is not null"), ["chunk_id"], ["cand_pos"], "candidateIndex").select(
        *BILL_KEY, F.col("candidateIndex").cast("int").alias("candidateIndex"))
    spans = slim.where(F.col("chunkPageIndex").isNotNull()).join(heads, BILL_KEY).select(
        "chunk_id", F.col("head").alias("cand_pos"), F.col("chunkPageIndex").alias("page_index")
    )
    later = _first_stated(bills.join(heads.where("joins"), BILL_KEY))
    cells = {f: _filled(f) for f in CELL_FIELDS}
    merged = bills.drop("candidateIndex").join(number, BILL_KEY).join(later.drop("parts"), BILL_KEY, "left").select(
        *[cells[c].alias(c) if c in cells else F.col(c) for c in bills.columns]
    )
    ledger = new_ledger(merged).but(spans=spans)
    return ledger.log(
        audit_rows(
            later, "merge", attached=F.lit(True), reason=F.lit("bill continues over a page break"),
            detail=F.concat_ws(" ", F.col("parts").cast("string"), F.lit("later parts")),
        )
    )


def _first_stated(parts: DataFrame) -> DataFrame:
    """Per bill, a map from field to the first later part's cell that states it, and the part count.

    Only stated cells travel; the map has at most one entry per contract field.
    """
    def entry(f: str) -> str:
        text, number = ("null", f"{f}.value") if is_number(f) else (f"{f}.value", "null")
        return (
            f"if({f}.value is not null, named_struct('f', '{f}', 'cell', named_struct("
            f"'s', cast({text} as string), 'd', cast({number} as double), 'c', {f}.confidence)), null)"
        )

    stated = F.expr(f"array_compact(array({', '.join(entry(f) for f in CELL_FIELDS)}))")
    rows = parts.select(
        "chunk_id", F.col("head").alias("cand_pos"), F.col("cand_pos").alias("at"), stated.alias("x")
    )
    sizes = rows.groupBy(*BILL_KEY).agg(F.count(F.lit(1)).alias("parts"))
    firsts = (
        rows.select(*BILL_KEY, "at", F.explode("x").alias("x"))
        .groupBy(*BILL_KEY, F.col("x.f").alias("f"))
        .agg(F.min_by("x.cell", "at").alias("cell"))
        .groupBy(*BILL_KEY)
        .agg(F.map_from_entries(F.collect_list(F.struct("f", "cell"))).alias("fills"))
    )
    return sizes.join(firsts, BILL_KEY, "left")


def _filled(f: str):
    """The head's own cell, or the first later one where the head states nothing."""
    given = f"fills['{f}']"
    value = f"{given}.{'d' if is_number(f) else 's'}"
    cell = f"cast(named_struct('value', {value}, 'confidence', {given}.c) as {cell_sql_type(f)})"
    return F.expr(f"if({f}.value is null and {given} is not null, {cell}, {f})")


def merge_pairwise(facts: DataFrame, p: Profile) -> DataFrame:
    """The decision against the row just before instead of the filled bill, fully built in.

    Same answer as the fold for bills of two pages.  Names are compared by edit distance.
    """
    row = F.struct(*STATE, "continues")
    near = neighbours(facts, ["chunk_id"], "cand_pos", row, {"before": -1})
    row, before = F.struct(*STATE, "continues"), F.col("before")
    names = names_agree_by_edits(before["seller"], F.col("seller"), p)
    joins = F.col("is_first") & F.col("prev_read") & (F.col("cand_pos") > 0) & _verdicts(row, before, names)
    return near.select(*BILL_KEY, joins.alias("joins"))
