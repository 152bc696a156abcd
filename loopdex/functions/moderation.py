"""Moderation predicates (C11, C12) and display projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loopdex import config as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_removed(*cols) -> Column:
    """C11: any of the given text fields contains the removal phrase, case-insensitively."""
    cols = cols or ("literal", "description", "combined_text")
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.lower(_c(c)).contains(C.REMOVED_PHRASE), F.lit(False))
    return out


def has_blocked_tag(tags, blocked: tuple[str, ...]) -> Column:
    """Some tag, lower-cased, equals a blocked tag exactly; no tags -> false."""
    if not blocked:
        return F.lit(False)
    blocked_arr = F.array(*[F.lit(b.lower()) for b in blocked])
    return F.coalesce(F.exists(_c(tags), lambda t: F.array_contains(blocked_arr, F.lower(t))), F.lit(False))


def display_description(description="description", original="original_description", combined="combined_text") -> Column:
    """First non-null of description, original description, combined text, else ''."""
    return F.coalesce(_c(description), _c(original), _c(combined), F.lit(""))


def display_score(vec_score, score, default: float = 0.0) -> Column:
    """Vector score when present, else the list score, else the default."""
    return F.coalesce(_c(vec_score), _c(score), F.lit(float(default)))
