"""Cells and field values: wrap, unwrap, canonical text, comparison, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrecon.functions.text import blank_to_null, no_space, strip
from docrecon.schema import AMOUNT_FIELDS, RATE_FIELDS, cell_sql_type


def cell(value: Column, confidence: Column) -> Column:
    return F.struct(value.alias("value"), confidence.cast("double").alias("confidence"))


def typed_cell(field: str, value, confidence) -> Column:
    """A cell of the field's own type, from columns or literals."""
    if value is None and not isinstance(confidence, Column):
        known = "null" if confidence is None else f"{float(confidence)}D"
        return F.expr(
            f"cast(named_struct('value', null, 'confidence', {known}) as {cell_sql_type(field)})"
        )
    v = value if isinstance(value, Column) else F.lit(value)
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(v.alias("value"), c.alias("confidence")).cast(cell_sql_type(field))


def val(name: str) -> Column:
    return F.col(name)["value"]


def canonical_by_kind(value: Column, is_amount: Column, is_rate: Column) -> Column:
    """Amounts with two decimals, rates as whole numbers, the rest as text; null stays null."""
    number = value.try_cast("double")
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(is_amount & number.isNotNull(), F.format_string("%.2f", number))
        .when(is_rate & number.isNotNull(), number.cast("long").cast("string"))
        .otherwise(value.cast("string"))
    )


def canonical_string(field: str, value: Column) -> Column:
    return canonical_by_kind(
        value, F.lit(field in AMOUNT_FIELDS), F.lit(field in RATE_FIELDS)
    )


def norm_identity(field: str, value: Column) -> Column:
    """Totals with two decimals; other values without spaces in lower case, blank as null."""
    if field == "originalTotal":
        number = value.try_cast("double")
        return F.when(number.isNotNull(), F.format_string("%.2f", number)).otherwise(
            F.lower(strip(value.cast("string")))
        )
    return blank_to_null(F.lower(no_space(value)))


def matches(actual: Column, expected: Column, numeric: Column) -> Column:
    """Field comparison of the scorer: null equals null, numbers within .005, text trimmed."""
    a, e = actual.try_cast("double"), expected.try_cast("double")
    as_number = numeric & a.isNotNull() & e.isNotNull()
    return (
        F.when(actual.isNull() | expected.isNull(), actual.isNull() & expected.isNull())
        .when(as_number, F.abs(a - e) < 0.005)
        .otherwise(F.lower(strip(actual)) == F.lower(strip(expected)))
    )


def match_field(field: str, actual: Column, expected: Column) -> Column:
    return matches(actual, expected, F.lit(field in AMOUNT_FIELDS or field in RATE_FIELDS))


def printed_date_iso(day: Column, month: Column, year: Column) -> Column:
    """Reorder only; nothing is checked against a calendar."""
    return F.concat_ws("-", year, month, day)


def buddhist_to_iso(text: Column) -> Column:
    """``d/m/y`` with a Buddhist or two-digit Buddhist year as an ISO date, null when impossible."""
    pattern = r"([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})"
    part = [F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2, 3)]
    year = (
        F.when(part[2] < 100, part[2] + 2500 - 543)
        .when(part[2] > 2400, part[2] - 543)
        .otherwise(part[2])
    )
    iso = F.format_string("%04d-%02d-%02d", year, part[1], part[0])
    return F.when(iso.try_cast("date").isNotNull(), iso)


def line_item_text(items: Column) -> Column:
    """Non-blank descriptions, one per line, null when there are none."""
    lines = F.transform(items, lambda i: strip(F.coalesce(i["description"]["value"], F.lit(""))))
    return blank_to_null(F.array_join(F.filter(lines, lambda s: s != ""), "\n"))
