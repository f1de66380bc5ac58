from __future__ import annotations

import pytest

from larderlog.plans import catering, offers, pricing, snapshots
from larderlog.plans.arguments import clamp_kcal, offer_limit, page_args
from larderlog.sources.tables import Tables, empty_tables

from .conftest import rows, ts


def price(i, company, leaf, total, at, tdo=None, days=10, city=1, codes=(), net=None):
    return {
        "id": i, "company_id": company, "diet_calories_id": leaf, "total_cost": total, "captured_at": ts(at),
        "tier_diet_option_id": tdo, "order_days": days, "city_id": city, "promo_codes": list(codes),
        "per_day_cost_with_discounts": net,
    }


@pytest.fixture
def tables(make):
    closed = ts("2026-01-01")
    leaf = lambda c, i, kcal, tier=None, opt=None, diet=1, end=None: {
        "company_id": c, "diet_id": diet, "diet_calories_id": i, "calories": kcal, "tier_id": tier,
        "diet_option_id": opt, "valid_to": end}
    return Tables(
        companies=make("companies", *[
            {"company_id": c, "name": c.upper(), "orders_enabled": e, "avg_score": s}
            for c, e, s in (("a", True, 90.0), ("b", True, None), ("c", None, 80.0))]),
        company_cities=make("company_cities", *[{"company_id": c, "city_id": 1} for c in "abc"]),
        cities=make("cities", {"city_id": 1, "name": "Wrocław"}, {"city_id": 2, "name": "Opole"}),
        diets=make(
            "diets",
            *[{"company_id": c, "diet_id": 1, "name": f"D{c}", "diet_tag": "KETO", "is_menu_configuration": c != "b"}
              for c in "abc"],
            {"company_id": "a", "diet_id": 2, "name": "closed", "valid_to": closed}),
        tiers=make("tiers", {"company_id": "a", "diet_id": 1, "tier_id": 6, "name": "T6"},
                   {"company_id": "c", "diet_id": 1, "tier_id": 6, "name": "T6"}),
        diet_options=make(
            "diet_options",
            {"company_id": "a", "diet_id": 1, "tier_id": 6, "diet_option_id": 15, "name": "O15", "tier_diet_option_id": "6-15"},
            {"company_id": "c", "diet_id": 1, "tier_id": 6, "diet_option_id": 15, "name": "O15", "tier_diet_option_id": "6-15"}),
        diet_calories=make(
            "diet_calories",
            leaf("a", 10, 1500, 6, 15), leaf("a", 10, 1800), leaf("a", 11, 2000, 6, None), leaf("a", 12, 1500, diet=2),
            leaf("b", 20, 1500), leaf("b", 21, 3999), leaf("b", 22, 4000), leaf("b", 23, 4001), leaf("b", 24, None),
            leaf("b", 25, 1600, end=closed), leaf("c", 30, 1500, 6, 15)),
        prices=make(
            "prices",
            # current day of a/10/6-15: two quotes, the later dearer; previous captured day two days before
            price(1, "a", 10, 500.0, "2026-04-03 06:00", "6-15"), price(2, "a", 10, 450.0, "2026-04-05 06:00", "6-15"),
            price(3, "a", 10, 470.0, "2026-04-05 07:00", "6-15", codes=["FIT"]),
            price(4, "a", 10, 300.0, "2026-04-01 06:00"), price(5, "a", 10, 1.0, "2026-04-09", ""),
            price(6, "a", 11, 2.0, "2026-04-05", "6-15"), price(7, "a", 11, 2.0, "2026-04-05"),
            price(8, "a", 12, 3.0, "2026-04-05"), price(9, "b", 20, None, "2026-04-05"),
            price(10, "b", 20, 600.0, "2026-04-04"), price(11, "b", 21, 700.0, "2026-04-05"),
            price(12, "b", 25, 4.0, "2026-04-05"), price(13, "c", 30, 450.0, "2026-04-05", "6-15"),
            price(14, "c", 30, 5.0, "2026-04-05", "6-15", city=2), price(15, "c", 30, 6.0, "2026-04-05", "6-15", days=5, net=9.5),
            price(16, "a", 10, 7.0, "2026-04-06", "6-15", days=5, net=8.5)),
        campaigns=make("campaigns", {"code": "FIT", "source": "s", "is_active": True, "discount_percent": 10.0}),
    )


ARGS = page_args(1000, 4500, days=10, size=2)


def test_page_and_prices(tables):
    page = {r.company_id: r for r in catering.catering_page(tables, ARGS, city_id=1).collect()}
    # '' belongs to the same combo as NULL, so it replaces a's ready price and then matches no leaf.
    assert set(page) == {"a", "c"}
    a = page["a"]
    assert (a["rank"], a.variants, a.total_companies, float(a.overall_min)) == (1, 1, 3, 45.0)
    leaf = a.leaves[0]
    assert (leaf.diet_name, leaf.tier_name, leaf.diet_option_name, leaf.calories) == ("Da", "T6", "O15", 1500)
    assert float(leaf.total_cost) == 450.0 and float(leaf.prev_per_day) == 50.0 and leaf.promo_codes == []
    second = catering.catering_page(tables, page_args(1000, 4500, days=10, page=2, size=2), city_id=1).collect()
    assert [(r.company_id, r["rank"], r.total_companies) for r in second] == [("b", 3, 3)]
    b = second[0]
    # the newest day of b/20 has no total, so that leaf comes last
    assert [(l.diet_calories_id, l.effective_per_day) for l in b.leaves][1] == (20, None)
    assert float(b.leaves[1].prev_per_day) == 60.0
    assert catering.catering_page(tables, page_args(1000, 4500, days=10, page=9, size=2), city_id=1).count() == 0


def test_all_cities_equal_one_city_at_a_time(tables):
    every = catering.catering_page(tables, ARGS).where("city_id = 1").drop("leaves")
    one = catering.catering_page(tables, ARGS, city_id=1).drop("leaves")
    assert rows(every) == rows(one)


def test_reduction_before_ranking_changes_nothing(tables):
    plain = catering.priced_leaves(tables, kcal_min=1000, kcal_max=1700)
    reduced = catering.priced_leaves(tables, kcal_min=1000, kcal_max=1700, reduce_first=True)
    assert sorted(rows(plain), key=str) == sorted(rows(reduced), key=str)


def test_half_null_leaf_matches_nothing(tables):
    assert catering.priced_leaves(tables).where("diet_calories_id = 11").count() == 0


def test_kcal_bounds(tables, make):
    assert catering.kcal_bounds(tables).collect()[0].asDict() == {
        "city_id": 1, "kcal_min": 1500, "kcal_max": 4000, "presets": [1500, 1800, 2000]}
    nothing = catering.kcal_bounds_of(tables, 99).first()
    assert nothing.asDict() == {
        "city_id": 99, "kcal_min": 1000, "kcal_max": 3000, "presets": [1200, 1500, 1800, 2000, 2500]}
    tables.diet_calories = make(
        "diet_calories", {"company_id": "a", "diet_id": 1, "diet_calories_id": 1, "calories": 1700})
    assert catering.kcal_bounds(tables).first().presets == [1200, 1500, 1800, 2000, 2500]


def test_cities_and_days(tables):
    assert rows(catering.cities_with_companies(tables)) == [(1, "Wrocław")]
    assert rows(catering.day_options(tables, 1), "order_days") == [(5,), (10,)]


def test_resolve_city(make):
    cities = make(
        "cities",
        {"city_id": 1, "name": "Opole", "sanitized_name": "opole", "largest_city_for_name": False, "number_of_companies": 9},
        {"city_id": 2, "name": "OPOLE", "sanitized_name": "x", "largest_city_for_name": True, "number_of_companies": 1},
        {"city_id": 3, "name": "y", "sanitized_name": "Opole", "largest_city_for_name": None, "number_of_companies": 99},
    )
    assert rows(catering.resolve_city(cities, "opole"), "city_id") == [(2,)]
    assert catering.resolve_city(cities, "Łódź").count() == 0


def test_arguments():
    a = page_args(3000, 1000, days=7, page=-3, size=1000, available_days=[5, 10])
    assert (a.kcal_min, a.kcal_max, a.days, a.page, a.size, a.offset) == (1000, 3000, 5, 1, 200, 0)
    assert (page_args(kcal=1500).kcal_min, page_args(kcal=1500).kcal_max) == (1500, 1500)
    assert (page_args().kcal_min, page_args().kcal_max, page_args(size=0).size) == (1000, 3000, 1)
    assert [offer_limit(n) for n in (None, 0, 99)] == [20, 1, 50]
    assert [clamp_kcal(n, 1000, 3000) for n in (1, 2000, 9000)] == [1000, 2000, 3000]


def test_find_offers(tables):
    found = offers.find_offers(tables, city_id=1, as_of="2026-04-06")
    got = {r.offer_id: r for r in found.collect()}
    # b is a ready diet, c has orders unknown
    assert set(got) == {"v1:a:10:6-15"}
    r = got["v1:a:10:6-15"]
    assert float(r.price_per_day) == 8.5 and r.promo.code == "FIT" and r.is_configurable
    assert offers.find_offers(tables, city_id=1, max_price=8.0, as_of="2026-04-06").count() == 0
    assert offers.find_offers(tables, city_id=1, diet_tag="VEGAN", as_of="2026-04-06").count() == 0
    assert offers.find_offers(tables, city_id=1, with_promo_only=True, as_of="2026-04-06").count() == 1
    own = offers.find_offers(tables, city_id=1, with_promo_only=True, promo_scope="company", as_of="2026-04-06")
    assert own.count() == 0


def test_find_offers_on_empty_tables(spark):
    empty = empty_tables(spark)
    assert offers.ranked_offers(offers.find_offers(empty, city_id=986283, as_of="2026-04-06")).collect() == []


def test_price_history_and_marks(tables):
    history = pricing.price_history(tables.prices, "a", 10, 1, 10)
    assert rows(history.orderBy("bucket"), "bucket") == [
        ("2026-04-01",), ("2026-04-03",), ("2026-04-05",), ("2026-04-09",)]
    assert rows(pricing.promo_marks(history), "bucket", "code") == [("2026-04-05", "FIT")]
    narrowed = pricing.price_history(tables.prices, "a", 10, 1, 10, tdo="6-15")
    assert rows(narrowed.orderBy("bucket"), "bucket") == [("2026-04-03",), ("2026-04-05",)]


def test_price_changes(make):
    steps = [(1, "06:00", 5.0), (2, "06:00", 6.0), (3, "07:00", 6.0), (4, "08:00", None), (5, "09:00", 7.0)]
    prices = make(
        "prices", *[price(i, "a", 1, None, f"2026-04-01 {t}", codes=[], net=v) for i, t, v in steps],
        {**price(9, "a", 1, None, "2026-04-01 10:00", net=1.0), "promo_codes": None})
    got = sorted(rows(pricing.price_changes(prices), "id", "prev_per_day", "delta"))
    # equal instants see nothing of each other; the higher id speaks for the instant
    assert got == [(4, 6.0, None), (5, None, None)]


def test_latest_prices_keep_code_lists_apart(tables):
    got = pricing.latest_prices(tables.prices.where("company_id = 'a' AND diet_calories_id = 10 AND order_days = 10"))
    assert sorted(r.id for r in got.collect()) == [3, 5]


def test_quote_breakdown_of_a_bad_key(spark, tables):
    keys = spark.createDataFrame([("v1:a:10:6-15",), ("v0:a:1",)], "offer_id string")
    got = pricing.quote_breakdown(tables, keys, city_id=1, days=5).collect()
    by_key = {r.offer_id: r for r in got}
    assert by_key["v0:a:1"].error == "invalid" and by_key["v0:a:1"].city_id is None
    assert float(by_key["v1:a:10:6-15"].totals.final_total) == 7.0


def test_cheapest_leaves(tables):
    got = rows(snapshots.cheapest_leaves(tables.prices.where("order_days = 10 AND city_id = 1"), 3), "id")
    assert got == [(5,), (7,), (6,)]
    assert snapshots.cheapest_leaves(tables.prices, n_days=0).first().per_day == 1.0
