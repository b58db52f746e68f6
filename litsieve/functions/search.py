"""Boolean search queries (T21, T22): quoted phrases, AND of OR-groups, ``*`` as a wildcard."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'[“"]([^“”"]*)[”"]|(\()|(\))|([^\s()“”"]+)')


def parse(query: str) -> list[list[str]]:
    """The AND-groups of OR-ed terms, lowered; words side by side are separate terms."""
    groups: list[list[str]] = [[]]
    for m in _TOKEN.finditer(query):
        word = m[1] if m[1] is not None else m[4]
        if word is None or not word.strip():
            continue
        if m[4] and word.upper() == "AND":
            groups.append([])
        elif not (m[4] and word.upper() == "OR"):
            groups[-1].append(" ".join(word.lower().split()))
    return [g for g in groups if g]


def term_regex(term: str) -> str:
    """A term as a pattern on lowered text: whole words, ``*`` matches the rest of a word."""
    body = "".join("[a-z0-9]*" if c == "*" else r"[ \t\r\n]+" if c == " " else re.escape(c) if not c.isalnum() and c != "_" else c for c in term)
    return f"(^|[^a-z0-9]){body}([^a-z0-9]|$)"


def group_regex(terms: list[str]) -> str:
    return "|".join(f"({term_regex(t)})" for t in dict.fromkeys(terms))


def matches(c: Column, query: str) -> Column:
    """Whether a text meets every OR-group; an empty query meets all."""
    out = F.lit(True)
    low = F.lower(F.coalesce(c, F.lit("")))
    for g in parse(query):
        out = out & low.rlike(group_regex(g))
    return out


def literal_terms(query: str) -> list[str]:
    """The plain reading: words split at blanks, each a contained pattern."""
    out = []
    for w in re.split(r" OR | AND |\s+", query):
        w = w.strip().strip('"')
        if w:
            out.append(w.replace("*", ".*") if "*" in w else f".*{re.escape(w)}.*")
    return out
