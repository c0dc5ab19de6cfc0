"""Personal data (F23): what it is, and texts without it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds in the order of replacement, with patterns that Java and RE2 read alike.
PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("card", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"),
    ("phone", r"(?:\+\d{1,2} ?)?\(\d{3}\) ?\d{3}-\d{4}|\b\d{3}[-.]\d{3}[-.]\d{4}\b|\+\d{8,14}\b"),
    ("ipv4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
]


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(digits, "[ -]", ""))


def redacted(text: Column) -> Column:
    """Each kind in turn as its name in brackets; cards only with a valid check digit."""
    out = text
    for kind, pattern in PATTERNS:
        mark = f"[{kind.upper()}]"
        if kind == "card":
            cards = F.array_distinct(F.filter(_found(out, pattern), luhn))
            out = F.aggregate(cards, out, lambda t, c: F.replace(t, c, F.lit(mark)))
        else:
            out = F.regexp_replace(out, pattern, mark.replace("[", r"[").replace("$", r"\$"))
    return out


def counts(text: Column) -> dict[str, Column]:
    """Numbers of each kind, each on the text as it is; only cards are gathered, for their check digit."""
    signs = {"email": "@", "ipv6": ":"}  # without these there is none
    out = {}
    for kind, pattern in PATTERNS:
        n = F.size(F.filter(_found(text, pattern), luhn)) if kind == "card" else F.regexp_count(text, F.lit(pattern))
        out[kind] = (F.when(~text.contains(signs[kind]), 0).otherwise(n) if kind in signs else n).cast("bigint")
    return out
