"""Arrays of names and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip


def _clean(c: Column | str) -> Column:
    names = F.transform(col(c), strip)
    return F.filter(names, lambda x: F.coalesce(x, F.lit("")) != "")


def tidy_names(c: Column | str) -> Column:
    """Trimmed, non-empty, distinct, sorted; a missing list becomes an empty one."""
    return F.coalesce(F.array_sort(F.array_distinct(_clean(c))), F.array().cast("array<string>"))


def name_list(c: Column | str) -> Column:
    """Trimmed non-empty names joined with ``"; "``; NULL when nothing remains."""
    return F.nullif(F.array_join(_clean(c), "; "), F.lit(""))


def has_any(c: Column | str) -> Column:
    return F.coalesce(F.size(col(c)) > 0, F.lit(False))


def is_empty(c: Column | str) -> Column:
    """True for an empty list only: NULL means "unknown", not "none"."""
    return F.coalesce(F.size(col(c)) == 0, F.lit(False)) & col(c).isNotNull()


def comma_joined(c: Column | str) -> Column:
    return F.array_join(col(c), ",")


def first_item(c: Column | str) -> Column:
    return F.get(col(c), F.lit(0))


def or_empty(c: Column | str, element_type: str) -> Column:
    return F.coalesce(col(c), F.array().cast(f"array<{element_type}>"))
