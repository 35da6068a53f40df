"""Identifier scalars: extraction, check digits, unambiguous choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrecon.functions.text import ascii_digits, bind
from docrecon.profile import CheckScheme

# A digit run not touching a letter, digit or underscore of any script.
_WORD = r"[\p{L}\p{N}_]"


def digits_only(c: Column) -> Column:
    return F.regexp_replace(ascii_digits(c), "[^0-9]", "")


def extract_ids(text: Column, length: int = 13) -> Column:
    """Word-bounded runs of exactly ``length`` digits, in order, repeats included."""
    pattern = rf"(?<!{_WORD})[0-9]{{{length}}}(?!{_WORD})"
    return F.regexp_extract_all(ascii_digits(text), F.lit(pattern), 0)


def extract_spaced_ids(text: Column, length: int = 13) -> Column:
    """Like ``extract_ids`` for numbers printed in groups; separators never cross a line."""
    pattern = rf"(?<!{_WORD})[0-9](?:[ \t-]*[0-9]){{{length - 1}}}(?![0-9])"
    found = F.regexp_extract_all(ascii_digits(text), F.lit(pattern), 0)
    return F.transform(found, lambda s: F.regexp_replace(s, "[^0-9]", ""))


def check_digit_valid(digits: Column, scheme: CheckScheme) -> Column:
    """True when the last digit is the weighted check digit of the ones before it."""
    total = F.lit(0)
    for i, weight in enumerate(scheme.weights, start=1):
        product = F.substring(digits, i, 1).try_cast("int") * weight
        if scheme.fold_products:
            product = product.cast("int") - F.when(product > 9, 9).otherwise(0)
        total = total + product
    expected = (F.lit(scheme.modulus) - total % scheme.modulus) % 10
    last = F.substring(digits, scheme.length, 1).try_cast("int")
    shape = digits.rlike(rf"^[0-9]{{{scheme.length}}}$")
    return F.coalesce(F.when(shape, expected == last), F.lit(False))


def clean_tax_id(value: Column, length: int = 13, reject: str | None = None) -> Column:
    """Digits only, exactly ``length`` of them, and optionally not a given id."""
    digits = digits_only(value)
    ok = F.length(digits) == length
    if reject:
        ok = ok & (digits != reject)
    return F.when(ok, digits)


def valid_ids(found: Column, scheme: CheckScheme, exclude: str | None = None) -> Column:
    """Distinct checksum-valid ids in first-seen order, ours left out."""

    def keep(d):
        ok = check_digit_valid(d, scheme)
        return ok & (d != exclude) if exclude else ok

    return F.array_distinct(F.filter(found, keep))


def only_one(values: Column) -> Column:
    return bind(values, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def single_valid_id(found: Column, scheme: CheckScheme, exclude: str | None = None) -> Column:
    """The only valid id, or null when there is none or more than one."""
    return only_one(valid_ids(found, scheme, exclude))
