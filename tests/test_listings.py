"""Gaps of paged listings and stored serving days, against plain Python."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from larderlog.plans import listings, menus

from .conftest import ts

LISTING = "city_id long, captured_at timestamp, currentPage int, totalPages int, searchData array<struct<name string>>"


def pages(spark, *rows):
    return spark.createDataFrame([(c, ts("2026-05-01"), p, n, [(x,) for x in names]) for c, p, n, names in rows], LISTING)


def named(df):
    return sorted(((r["city_id"], r["kind"], r["from_page"], r["to_page"], r["companies"]) for r in df.collect()), key=str)


def test_each_kind_of_gap(spark):
    listing = pages(
        spark, (1, 0, 3, "ab"), (1, 1, 3, "cd"), (1, 2, 3, "e"),  # whole
        (2, 1, 5, "a"), (2, 4, 6, "b"),  # misses 0, 2 to 3 and 5
        (3, 0, 2, "ab"), (3, 0, 2, "ab"), (3, 1, 2, "bc"),  # answered twice; b moved
        (4, 0, None, "a"), (4, 2, None, "b"), (5, None, 2, "a"),
    )
    assert named(listings.listing_gaps(listing)) == sorted([
        (2, "missing", 0, 0, None), (2, "missing", 2, 3, None), (2, "missing", 5, 5, None), (3, "repeated", 0, 0, None),
        (3, "shifted", 1, 1, 1), (4, "missing", 1, 1, None), (5, "missing", 0, 1, None)], key=str)
    assert [r["city_id"] for r in listings.complete_captures(listing).collect()] == [1]
    assert listings.listing_gaps(listing.limit(0)).count() == 0


def test_missing_pages_against_brute_force(spark):
    rnd = random.Random(2)
    there = {c: {p for p in range(12) if rnd.random() < 0.6} for c in range(20)}
    got = named(listings.listing_gaps(pages(spark, *[(c, p, 12, f"{c}") for c, ps in there.items() for p in ps])))
    lost = {(c, p) for c, k, a, b, _ in got if k == "missing" for p in range(a, b + 1)}
    assert lost == {(c, p) for c, ps in there.items() if ps for p in range(12) if p not in ps}
    runs = [(c, a, b) for c, k, a, b, _ in got if k == "missing"]
    assert all((c, b + 1) not in lost for c, _, b in runs)  # intervals are as long as can be


@pytest.mark.parametrize("as_of, days", [("2026-03-10", 14), ("2026-03-31", 30), ("2026-03-15", 14), ("2026-01-02", 1)])
def test_serving_days_equal_the_count_over_rows(make, spark, as_of, days):
    rnd = random.Random(5)
    rows = [
        {"id": i, "company_id": "a", "diet_calories_id": rnd.randrange(3), "slot_name": rnd.choice(["Obiad", "Kolacja"]),
         "meal_name": rnd.choice(["x", "y", None]), "menu_date": date(2026, 1, 1) + timedelta(days=rnd.randrange(120))}
        for i in range(300)
    ]

    class Tables:
        daily_menu = make("daily_menu", *rows)
        meals = make("meals", *[{"company_id": "a", "name": n} for n in "xy"])
        diet_calories = make("diet_calories", *[{"company_id": "a", "diet_id": 1, "diet_option_id": k // 2, "diet_calories_id": k} for k in range(3)])

    parts = [menus.served_days(make("daily_menu", *rows[i::2])) for i in (0, 1, 0)]
    served = menus.merged_days(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    cols = ["diet_option_id", "slot_name", "name", "last_seen_date", "occurrences"]
    got = menus.option_meals_of_days(Tables, served, as_of, days).select(*cols)
    want = menus.option_meals(Tables, as_of, days).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 2
    assert served.where(F.bit_count("days") > 1).count() > 0
