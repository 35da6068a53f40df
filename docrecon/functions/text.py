"""Text scalars: cleaning, loop detection, markers, labelled values, page roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrecon.profile import Profile

# Java's \s is ASCII only; transcripts also carry no-break and ideographic spaces.
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BLANK_CELL = rf"<t[dh][^>]*>(?:{WS}|&nbsp;|&#160;|<br\s*/?>|[-\x{{2010}}-\x{{2015}}•.])*+</t[dh]>"
BLANK_ROW = rf"(?i)<tr[^>]*>\s*(?:{_BLANK_CELL}\s*)++</tr>"
EMPTY_TABLE = r"(?i)<table[^>]*>\s*(?:<t(?:body|head)>\s*</t(?:body|head)>\s*)*</table>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; both ends trimmed."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def no_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, for bodies that use it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "๐๑๒๓๔๕๖๗๘๙", "0123456789")


def collapse_empty_rows(html: Column) -> Column:
    """Delete table rows whose every cell is blank, then tables left empty."""
    return F.regexp_replace(F.regexp_replace(html, BLANK_ROW, ""), EMPTY_TABLE, "")


def segments(text: Column, min_chars: int = 8, delimiter: str = r"<[^>]+>|\n") -> Column:
    """Pieces between tags and line breaks, spaces squeezed, short scraps dropped."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), delimiter), squeeze)
    return F.filter(pieces, lambda s: F.length(s) >= min_chars)


def repeat_score(text: Column, min_chars: int = 8) -> Column:
    """``struct(ratio, n)``: share of distinct segments (1.0 when there are none), and their count."""
    return bind(
        segments(text, min_chars),
        lambda s: F.struct(
            F.when(F.size(s) == 0, F.lit(1.0))
            .otherwise(F.size(F.array_distinct(s)) / F.size(s))
            .alias("ratio"),
            F.size(s).alias("n"),
        ),
    )


def count_of(text: Column, needle: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))


def early_verdict(text: Column, profile: Profile) -> Column:
    """``empty`` or ``at_burst``, else null: the failures that need no segment count."""
    lim = profile.limits
    return (
        F.when(text.isNull() | (F.length(text) < lim.min_chars), F.lit("empty"))
        .when(count_of(text, "@") > lim.max_at_signs, F.lit("at_burst"))
    )


def looping(ratio: Column, n: Column, profile: Profile) -> Column:
    """The half of the loop test that needs no compression."""
    lim = profile.limits
    return (n >= lim.min_segments) & (ratio <= lim.max_repeat_ratio)


def loop_reason(ratio: Column, compression: Column, n: Column) -> Column:
    return F.format_string("loop(unique=%.2f compressed=%.2f segments=%d)", ratio, compression, n)


def worth_rereading(reason: Column) -> Column:
    return F.coalesce(reason.startswith("loop"), F.lit(False))


def looks_failed(text: Column, profile: Profile) -> Column:
    return early_verdict(text, profile).isNotNull()


def page_marker(text: Column, pattern: str, max_pages: int = 20) -> Column:
    """First plausible "page n of m" as ``struct(page, of)``, else null."""
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), 1),
        F.regexp_extract_all(text, F.lit(pattern), 2),
        lambda a, b: F.struct(a.cast("int").alias("page"), b.cast("int").alias("of")),
    )
    good = F.filter(
        pairs,
        lambda p: (p["of"] > 1) & (p["page"] >= 1) & (p["page"] <= p["of"]) & (p["of"] <= max_pages),
    )
    return F.get(good, F.lit(0))


def marker_count(text: Column, markers: Sequence[str], ignore_case: bool = False) -> Column:
    """How many different markers the text contains; 0 for a missing text."""
    hay = F.lower(text) if ignore_case else text
    hits = [
        F.contains(hay, F.lit(m.lower() if ignore_case else m)).cast("int") for m in markers
    ]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return F.coalesce(total, F.lit(0))


def contains_any(text: Column, markers: Sequence[str], ignore_case: bool = False) -> Column:
    if not markers:
        return F.lit(False)
    return marker_count(text, markers, ignore_case) > 0


def is_certificate(text: Column, p: Profile) -> Column:
    return marker_count(text, p.certificate_markers) >= p.limits.certificate_hits


def is_id_card(text: Column, p: Profile) -> Column:
    return marker_count(text, p.card_markers) >= p.limits.card_hits


def is_transfer_slip(text: Column, p: Profile) -> Column:
    """Slip wording counts per phrase; any number of bank names counts once."""
    hits = marker_count(text, p.slip_markers) + contains_any(text, p.bank_markers).cast("int")
    return hits >= p.limits.slip_hits


def is_toll_page(text: Column, p: Profile) -> Column:
    hits = marker_count(text, p.toll_markers)
    if p.toll_issuer_id:
        # Found where it stands; the page is not rebuilt without its white space.
        spaced = rf"{WS}*+".join(rf"\Q{c}\E" for c in p.toll_issuer_id)
        hits = hits + F.coalesce(text.rlike(spaced).cast("int"), F.lit(0))
    return hits >= p.limits.toll_hits


def labelled_value(text: Column, pattern: str, squeeze_result: bool = True) -> Column:
    """Group 1 of the first match of a label pattern, null when absent or blank."""
    found = F.regexp_extract(text, pattern, 1)
    return blank_to_null(squeeze(found) if squeeze_result else found)


def roles_for_page(text: Column, p: Profile) -> Column:
    """Roles the page's headings establish, in list order without repeats; citations do not count."""
    def found(clean):
        named = F.array_distinct(
            F.array_compact(
                F.array(*[F.when(F.contains(clean, F.lit(h)), F.lit(r)) for h, r in p.heading_roles])
            )
        )
        cash = (
            contains_any(clean, p.cash_headings)
            & ~contains_any(clean, p.cash_outranked_by)
            & ~F.array_contains(named, p.cash_role)
        )
        return F.when(cash, F.array_append(named, F.lit(p.cash_role))).otherwise(named)

    return bind(F.coalesce(F.regexp_replace(text, p.citation_forms, " "), F.lit("")), found)


def clean_document_number(value: Column, text: Column, p: Profile) -> Column:
    """Keep a number that has a digit and, when printed on the page, a number label before it.

    The text before each occurrence is rebuilt from the pieces between occurrences, so that the
    label test sees the last ``label_window`` characters before every occurrence.
    """
    window = p.limits.label_window
    seed = F.struct(F.lit("").alias("tail"), F.lit(False).alias("ok"))

    def check(val):
        def step(acc, piece):
            before = F.right(F.concat(acc["tail"], piece), F.lit(window))
            hit = before.rlike(p.number_label) & ~before.rlike(p.book_label)
            return F.struct(
                F.right(F.concat(before, val), F.lit(window)).alias("tail"),
                (acc["ok"] | hit).alias("ok"),
            )

        quoted = F.concat(
            F.lit(r"\Q"), F.replace(val, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
        )
        # The piece after the last occurrence precedes nothing, so it is not tested.
        tested = bind(
            F.split(text, quoted),
            lambda pieces: F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), seed, step)["ok"],
        )
        on_page = F.coalesce(F.contains(text, val) & (F.length(text) > 0), F.lit(False))
        return F.when(val.rlike(r"\p{Nd}"), F.when(~on_page, val).when(tested, val))

    return bind(strip(value), check)


def clean_payment_method(value: Column, account_like: str) -> Column:
    """Null when blank or when a masked account number shows through."""
    val = strip(value)
    return F.when((val != "") & ~val.rlike(account_like), val)


def category_key(value: Column) -> Column:
    """Leading account code without dashes, else the trimmed text; null counts as blank."""
    v = F.coalesce(value, F.lit(""))
    head = F.regexp_extract(v, rf"^{WS}*([0-9][0-9-]*)", 1)
    return F.when(head != "", F.replace(head, F.lit("-"), F.lit(""))).otherwise(strip(v))


def names_party(text: Column, fragments: Sequence[str]) -> Column:
    """Does the page name the party?  Any fragment, any case; a missing text names nobody."""
    return contains_any(text, fragments, ignore_case=True)
