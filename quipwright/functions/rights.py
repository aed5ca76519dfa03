"""Licence classes and source families as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of licence wording, the most restrictive class first; written so that RE2 reads them too.
LICENCE_RULES = (
    ("noncommercial", r"non-?commercial|\bnc\b|by-nc|personal use"),
    ("research_only", r"research|academic|not? (be )?redistribut|do not redistribut|no redistribution|unredistributable"),
    ("redistributable", r"public domain|\bcc0\b|\bcc[ -]?by\b|\bmit\b|apache|creative commons|gutenberg|wikiquote"),
)


def licence_class(c: Column) -> Column:
    """Deny-first: the first class whose wording occurs, else 'unclassified'; null is unclassified."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")
    out = F.lit("unclassified")
    for name, pattern in reversed(LICENCE_RULES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def source_family(c: Column) -> Column:
    """What stands before the first of ':', ' (' and '/', without a trailing number; 'unknown' where nothing does."""
    head = F.regexp_replace(F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^([^:/(]*)", 1), r"[ _.-]*[0-9]*$", "")
    return F.when(head == "", "unknown").otherwise(head)
