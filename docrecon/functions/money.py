"""Money scalars: amounts in text, tolerances, identities, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrecon.functions.ids import only_one
from docrecon.functions.text import ascii_digits, bind


def to_number(raw: Column) -> Column:
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("double")


def extract_amounts(text: Column, pattern: str) -> Column:
    """Distinct positive amounts in first-seen order."""
    found = F.transform(F.regexp_extract_all(ascii_digits(text), F.lit(pattern), 0), to_number)
    return F.array_distinct(F.filter(found, lambda v: v > 0))


def single_amount_excluding(text: Column, amount: str, fee: str) -> Column:
    """The one labelled amount whose printed form is not also printed as a fee, else null."""
    shown = ascii_digits(text)
    fees = F.regexp_extract_all(shown, F.lit(fee), 1)
    amounts = F.array_except(F.regexp_extract_all(shown, F.lit(amount), 1), fees)
    return only_one(F.array_distinct(F.filter(F.transform(amounts, to_number), lambda v: v > 0)))


def tolerance(base: Column) -> Column:
    return F.lit(0.05) + F.abs(F.coalesce(base, F.lit(0.0))) * 1e-4


def money_equal(a: Column, b: Column, tol: float, inclusive: bool) -> Column:
    diff = F.abs(a - b)
    return diff <= tol if inclusive else diff < tol


def is_legal_rate(rate: Column, rates: Sequence[float], tol: float = 0.01) -> Column:
    close = [F.abs(rate - r) < tol for r in rates]
    out = close[0]
    for c in close[1:]:
        out = out | c
    return out


FEW = 16  # amounts up to which all pairs are tried


def base_and_tax(amounts: Column, rates: Sequence[float]) -> Column:
    """``struct(base, tax, rate, fits)`` when exactly one base has a tax at a legal rate, else null.

    The first fitting tax in printed order counts; ``fits`` says how many fit.  Amounts are distinct
    and positive.  A few amounts are tried in pairs.  More are sorted once together with the upper
    end of every base's window at every rate: the largest amount before such an end is in the window
    or none is.  A page of n amounts costs n log n.
    """
    def fits(tax, base, rate=None):
        legal = is_legal_rate(tax / base * 100, rates if rate is None else [rate])
        return (tax < base) & legal

    def tried(found):
        return F.filter(found, lambda base: F.exists(found, lambda t: fits(t, base)))

    def swept(found):
        none = F.lit(None).cast("double")

        def mark(value, base, rate):
            return F.struct(value.alias("v"), base.isNotNull().alias("end"), base.alias("base"), rate.alias("rate"))

        # Ends are a trifle wide, so that rounding loses no amount; the test itself is on the amounts.
        ends = F.flatten(F.transform(found, lambda base: F.array(*[
            mark(base * ((r + 0.01) / 100 * (1 + 1e-9)), base, F.lit(float(r))) for r in rates])))
        taxes = F.transform(found, lambda t: mark(t, none, none))

        def step(s, e):
            # An amount on the trifle itself may fail where the one before it fits.
            hit = e["end"] & (_fits_at(s["last"], e) | _fits_at(s["before"], e))
            base = F.when(hit, e["base"])
            return F.struct(
                F.when(e["end"], s["last"]).otherwise(e["v"]).alias("last"),
                F.when(e["end"], s["before"]).otherwise(s["last"]).alias("before"),
                F.least(s["low"], base).alias("low"), F.greatest(s["high"], base).alias("high"))

        def _fits_at(tax, e):
            return F.coalesce((tax < e["base"]) & (F.abs(tax / e["base"] * 100 - e["rate"]) < 0.01), F.lit(False))

        start = F.struct(*[none.alias(c) for c in ("last", "before", "low", "high")])
        return F.aggregate(
            F.array_sort(F.concat(taxes, ends)), start, step,
            lambda s: F.array_distinct(F.array_compact(F.array(s["low"], s["high"]))))

    def chosen(found):
        bases = F.when(F.size(found) <= FEW, tried(found)).otherwise(swept(found))

        def single(bases):
            base = F.get(bases, F.lit(0))

            def told(taxes):
                tax = F.get(taxes, F.lit(0))
                return F.struct(base.alias("base"), tax.alias("tax"), F.round(tax / base * 100, 2).alias("rate"),
                                F.size(taxes).alias("fits"))

            return F.when(F.size(bases) == 1, bind(F.filter(found, lambda t: fits(t, base)), told))

        return bind(bases, single)

    return bind(amounts, chosen)


def nearest_rate_gap(base: Column, tax: Column, rates: Sequence[float]) -> Column:
    """Distance from ``tax`` to the closest legal tax on ``base``."""
    return F.least(*[F.abs(tax - F.round(base * r, 2)) for r in rates])


def findings(
    total: Column, base: Column, vat: Column, wht: Column, vat_rate: float, wht_rates: Sequence[float]
) -> Column:
    """Array of the equation codes that fail; null operands say nothing."""
    return F.array_compact(
        F.array(
            F.when(F.abs(base + vat - total) > tolerance(total), F.lit("VAT_SUM")),
            F.when(
                (vat != 0) & (F.abs(vat - F.round(base * vat_rate, 2)) > tolerance(base)),
                F.lit("VAT_RATE"),
            ),
            F.when(
                (wht != 0) & base.isNotNull()
                & (nearest_rate_gap(base, wht, wht_rates) > tolerance(base)),
                F.lit("WHT_RATE"),
            ),
        )
    )
