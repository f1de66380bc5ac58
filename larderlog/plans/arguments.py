"""Query arguments, cleaned before a plan is built."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

# Paging and kcal range of the catering page, preset kcal chips,
# junk limit, order lengths that are quoted, menu horizon.
PAGE_SIZE = 25
MAX_PAGE_SIZE = 200
KCAL_RANGE = (1000, 3000)
KCAL_PRESETS = (1200, 1500, 1800, 2000, 2500)
KCAL_CAP = 4000
ORDER_LENGTHS = (1, 5, 10, 20)
MENU_DAYS = 7
OFFER_DAYS = 5
OFFER_LIMIT = (1, 20, 50)
SUGGESTIONS = 5


@dataclass(frozen=True)
class PageArgs:
    kcal_min: int
    kcal_max: int
    days: int
    page: int
    size: int

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.size


def page_args(
    kcal_min: int | None = None,
    kcal_max: int | None = None,
    kcal: int | None = None,
    days: int = 10,
    page: int = 1,
    size: int = PAGE_SIZE,
    available_days: Sequence[int] | None = None,
) -> PageArgs:
    """Defaults, a single legacy kcal as range, swapped bounds, clamped paging.

    With ``available_days`` an order length that is not offered falls back to
    the first that is.
    """
    lo = next(v for v in (kcal_min, kcal, KCAL_RANGE[0]) if v is not None)
    hi = next(v for v in (kcal_max, kcal, KCAL_RANGE[1]) if v is not None)
    if available_days and days not in available_days:
        days = available_days[0]
    return PageArgs(
        min(lo, hi), max(lo, hi), days, max(1, page), min(MAX_PAGE_SIZE, max(1, size))
    )


def clamp_kcal(value: int, low: int, high: int) -> int:
    return min(high, max(low, value))


def offer_limit(n: int | None) -> int:
    low, default, high = OFFER_LIMIT
    return default if n is None else min(high, max(low, n))
