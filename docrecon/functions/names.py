"""Party names: normal form, three-valued comparison, payee type, own-party tests."""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from docrecon.functions import ids
from docrecon.functions.text import blank_to_null, contains_any, no_space, squeeze
from docrecon.functions.udfs import sequence_ratio
from docrecon.profile import OwnParty, Profile

# Workers need not have the package installed: the name rule travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def norm_name(value: Column, branch_suffix: str) -> Column:
    """Spaces squeezed, trailing branch words removed however often repeated, lower case."""
    return blank_to_null(
        F.lower(no_space(F.regexp_replace(squeeze(value), branch_suffix, "")))
    )


def similarity_bound(a: Column, b: Column) -> Column:
    """Never below the sequence ratio, so a low bound settles "different" without Python."""
    total = F.length(a) + F.length(b)
    return F.lit(1.0) - F.try_divide(F.levenshtein(a, b), total)


def settled_names(a: Column, b: Column, p: Profile) -> Column:
    """What built-in tests settle about two normal names: true, false, or null for undecided."""
    lim = p.limits
    a_short = F.length(a) <= F.length(b)
    shorter = F.when(a_short, a).otherwise(b)
    longer = F.when(a_short, b).otherwise(a)
    prefix = (F.length(shorter) >= lim.name_prefix_chars) & longer.startswith(shorter)
    return (
        F.when(a == b, F.lit(True))
        .when(prefix, F.lit(True))
        .when(similarity_bound(a, b) < lim.name_different, F.lit(False))
    )


def names_agree(a: Column, b: Column, p: Profile) -> Column:
    """True, false, or null when either normal name is missing or they are too close to call."""
    known = settled_names(a, b, p)
    open_ = known.isNull() & a.isNotNull() & b.isNotNull()
    ratio = sequence_ratio(F.when(open_, a), F.when(open_, b))
    return F.coalesce(
        known,
        F.when(ratio >= p.limits.name_same, F.lit(True)).when(
            ratio < p.limits.name_different, F.lit(False)
        ),
    )


def name_rule(p: Profile):
    """``names_agree`` for two normal names in Python, for folds that carry a name from row to row."""
    lim = p.limits
    long_enough, same, different = lim.name_prefix_chars, lim.name_same, lim.name_different

    def verdict(a: str, b: str) -> bool | None:
        if min(len(a), len(b)) >= long_enough and (a.startswith(b) or b.startswith(a)):
            return True
        ratio = 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
        return True if ratio >= same else None if ratio >= different else False

    return verdict


def names_agree_by_edits(a: Column, b: Column, p: Profile) -> Column:
    """The same three answers from edit distance alone, for plans that must stay in the JVM."""
    bound = similarity_bound(a, b)
    return F.coalesce(
        settled_names(a, b, p), F.when(bound >= p.limits.name_same, F.lit(True))
    )


def is_our_value(part: str, value: Column, own: OwnParty) -> Column:
    """Is this one value ours?  A branch never tells."""
    if part == "TaxId" and own.tax_id:
        return F.coalesce(ids.digits_only(value) == own.tax_id, F.lit(False))
    if part == "Name":
        return contains_any(value, own.name_markers, ignore_case=True)
    if part == "Address":
        return contains_any(value, own.address_markers)
    return F.lit(False)


def _upper_packed(s: str) -> str:
    return "".join(s.split()).upper()


def payee_from_name(name: Column, p: Profile) -> Column:
    """individual / company / null from how the payee calls itself."""
    text = blank_to_null(F.upper(no_space(name)))

    def starts(prefixes):
        out = F.lit(False)
        for prefix in prefixes:
            out = out | text.startswith(_upper_packed(prefix))
        return out

    return (
        F.when(starts(p.person_prefixes), F.lit("individual"))
        .when(contains_any(text, [_upper_packed(m) for m in p.company_markers]), F.lit("company"))
        .when(starts(p.state_prefixes), F.lit("company"))
    )


def payee_from_id(tax_id: Column, p: Profile) -> Column:
    """company for a leading 0, individual for 1-8, of an id whose check digit holds."""
    digits = ids.digits_only(tax_id)
    lead = F.substring(digits, 1, 1)
    return F.when(
        ids.check_digit_valid(digits, p.id_scheme),
        F.when(lead == "0", F.lit("company")).when(lead != "9", F.lit("individual")),
    )
