"""URL filters: pattern rules found through their rarest literal token.

Every rule is a regular expression with literal tokens that any matching URL must hold as whole
tokens.  The rule is filed under the one of them that is rarest in the URLs at hand, so a URL's own
tokens fetch the few rules that can match, and only those run.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import batch_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = re.compile("[a-z0-9]+")
LOWER = {c: c + 32 for c in range(65, 91)}


class Rule(NamedTuple):
    """``pattern`` must match from the start of ``host + path``; of fitting rules the one with the
    longest ``name`` wins, then the first in order.  ``literals`` are whole tokens of every match;
    a rule without any is tried on each URL."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    explicit: bool  # named in the result; others only give a verdict


def site_rule(verdict: str, host: str, path: str = "") -> Rule:
    """A host with all its subdomains, for paths that start with ``path``."""
    end = re.escape(path) if path else r"(?:/|\Z)"
    name = host + path
    # The last token of an open path may go on in the URL, so it is no whole token there.
    whole = name if not path or not TOKEN.match(path[-1].lower()) else re.sub("[a-zA-Z0-9]+$", "", name)
    return Rule(name, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{end}",
                tuple(dict.fromkeys(TOKEN.findall(whole.translate(LOWER)))), True)


def path_rule(verdict: str, segment: str) -> Rule:
    """A whole path segment, on any host."""
    return Rule(f"/{segment}/", verdict, rf"[^/]*/(?:.*/)?{re.escape(segment)}(?:/|\Z)",
                tuple(dict.fromkeys(TOKEN.findall(segment.translate(LOWER)))), False)


# Segments of pages that hold no text worth keeping.
GENERIC = tuple(path_rule("block", s) for s in ("cgi-bin", "wp-login.php", "wp-admin", "adserver"))


def parts(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``; A-Z lower-cased) and path; both empty without one."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host, path = re.compile("([^/?#]*)([^?#]*)").match(url, at + 3).groups()
    return host.translate(LOWER), path


def token_counts(urls: DataFrame, wanted: Sequence[str]) -> dict[str, int]:
    """How often each wanted token stands in the URLs; as many rows as there are wanted tokens."""
    words = F.explode(F.split(F.lower("url"), "[^a-z0-9]+"))
    counted = urls.select(words.alias("token")).where(F.col("token").isin(list(wanted)))
    return {r.token: r.n for r in counted.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge_urls(
    df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
    otherwise: str = "allow",
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row.

    ``rules`` are the caller's list and travel with the tasks: their size is that of the list.  A
    null URL, or one without ``://``, has an empty host and path, fits no rule and gets
    ``otherwise``, as do all URLs that no rule fits.  Rows are judged one by one, so repeated rows
    and null ids pass through; other columns are not read.  No shuffle but the token count.
    """
    urls = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"))
    literals = sorted({t for r in rules for t in r.literals})
    seen = token_counts(urls, literals) if literals else {}
    rules = list(rules)
    filed: dict[str | None, list[int]] = {}
    for k, r in enumerate(rules):
        rarest = min(r.literals, key=lambda t: (seen.get(t, 0), t), default=None)
        filed.setdefault(rarest, []).append(k)
    schema = pa.schema([("id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict"))])

    def work(batches):
        patterns = [re.compile(r.pattern, re.DOTALL) for r in rules]
        for b in batches:
            rows = []
            for url in b.column("url").to_pylist():
                host, path = parts(url)
                place = host + path
                tokens = set(TOKEN.findall(place.translate(LOWER)))
                near = [k for t in (None, *tokens) for k in filed.get(t, ())]
                fits = [k for k in near if patterns[k].match(place)] if host or path else []
                best = min(fits, key=lambda k: (not rules[k].explicit, -len(rules[k].name), k), default=None)
                named = rules[best].name if best is not None and rules[best].explicit else None
                rows.append((host, path, named, otherwise if best is None else rules[best].verdict))
            host, path, rule, verdict = zip(*rows) if rows else ((), (), (), ())
            yield batch_of(schema, b.column("id"), host, path, rule, verdict)

    out = urls.mapInArrow(work, "id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
