"""Profiles for the shared tables, which hold no Thai receipts: same operators, other words."""

from __future__ import annotations

from dataclasses import replace

from docrecon.profile import LUHN_16, OwnParty, Profile, Thresholds

OWN = OwnParty(
    name="Example Holdings", address="1 Sample Street", tax_id="0000000000000", branch="Main",
    name_markers=("licensed",), address_markers=("Version",),
    evidence=("apache license", "@mail", "555-"),
)

# Function words of the invented prose stand in for printed headings.
PROSE = Profile(
    own=OWN,
    id_scheme=LUHN_16,
    certificate_markers=("the ", "and ", "that ", "with "),
    card_markers=("un ", "la ", "de ", "que ", "les ", "est ", "pour ", "dans "),
    slip_markers=("der ", "die ", "und ", "den "),
    bank_markers=("von ", "zu ", "mit "),
    toll_markers=("ciones ", "mente "),
    toll_issuer_id="theof",
    heading_roles=(
        ("Licensed", "receipt"), ("Version", "receipt"), ("token", "tax_invoice"),
        ("+1 (", "cash_bill"),
    ),
    cash_headings=("mail", "@"),
    cash_outranked_by=("Licensed", "token"),
    citation_forms=r"Apache\s*License,\s*Version",
    number_label=r"(?i)(\+1 \([0-9]{3}\)|of|and|de|die|le|en)[\s:.]*$",
    book_label=r"(?i)(by the|on the|of the)[\s:.]*$",
    branch_suffix=r"(?:[(\s]*(?:main office|branch\s*[0-9]+)[)\s]*)+$",
    page_marker=r"/([0-9]{1,2})\?page=([0-9]{1,2})",
    person_prefixes=("Supplier#00000000", "Customer#00000000", "Mr."),
    company_markers=("7 ", "55", "Co., Ltd"),
    state_prefixes=("Supplier#0000000", "Customer#0000001"),
)

# Reading choice without compression: short texts repeat little, so the thresholds are lower.
LOOSE = replace(PROSE, limits=Thresholds(min_segments=2, max_repeat_ratio=1.0, min_chars=120))

# Receipts written out of the event table use the Thai profile's own ticket patterns.
RECEIPTS = Profile()
