from __future__ import annotations

import pytest

from larderlog.plans import menus, state
from larderlog.sources.sinks import settle
from larderlog.sources.tables import Tables, empty_table

from .conftest import day, rows, ts

AS_OF = "2026-05-15"


def entry(i, date, name="Owsianka", leaf=1, tier=6, slot="Śniadanie", at="2026-05-01", **more):
    return {
        "id": i, "captured_at": ts(at), "company_id": "a", "city_id": 1, "diet_calories_id": leaf, "tier_id": tier,
        "menu_date": day(date), "slot_name": slot, "meal_name": name, "api_meal_slot_id": more.pop("pick", i), **more}


@pytest.fixture
def tables(make):
    leaf = lambda i, kcal, tier=6, opt=15, diet=1, **m: {
        "company_id": "a", "diet_id": diet, "diet_calories_id": i, "calories": kcal, "tier_id": tier,
        "diet_option_id": opt, **m}
    return Tables(
        companies=make("companies", {"company_id": "a", "menu_days_ahead": 0}, {"company_id": "off", "menu_enabled": False}),
        diets=make("diets", {"company_id": "a", "diet_id": 1, "is_menu_configuration": True},
                   {"company_id": "a", "diet_id": 2}, {"company_id": "off", "diet_id": 1}),
        diet_calories=make(
            "diet_calories", leaf(1, 1500), leaf(2, 1200), leaf(3, 1000, opt=16), leaf(1, 1500, tier=7), leaf(5, None, None, None, 2),
            leaf(6, 900, None, None, 2), leaf(7, 900, None, None, 2), leaf(8, 100, valid_to=ts("2026-01-01")),
            {"company_id": "off", "diet_id": 1, "diet_calories_id": 9}),
        meals=make("meals", {"company_id": "a", "name": "Owsianka", "kcal": 300.0, "allergens": ["Gluten"]},
                   {"company_id": "a", "name": "Zupa"}),
        daily_menu=make(
            "daily_menu", entry(1, "2026-05-01"), entry(2, "2026-04-30"), entry(3, "2026-05-02", leaf=2),
            entry(4, "2026-05-02", leaf=2, at="2026-05-02"), entry(5, "2026-05-03", leaf=3), entry(6, "2026-05-03", None),
            entry(7, "2026-05-04", "Zupa", slot="Obiad")),
    )


def test_variant_meals(tables):
    got = rows(menus.variant_meals(tables, "a", 1, 6, AS_OF), "slot_name", "name", "last_seen_date", "occurrences")
    assert got == [("Obiad", "Zupa", "2026-05-04", 1), ("Śniadanie", "Owsianka", "2026-05-02", 2)]
    other = menus.target_option(tables.diet_calories, "a", 1, 7).first()
    assert other.tier_id == 7
    assert menus.target_option(tables.diet_calories, "a", 1, None).first().tier_id == 6


def test_option_meals_agree_with_one_variant(tables):
    every = menus.option_meals(tables, AS_OF).where("tier_id = 6 AND diet_option_id = 15")
    one = menus.variant_meals(tables, "a", 1, 6, AS_OF)
    cols = ["slot_name", "name", "last_seen_date", "occurrences", "allergens"]
    assert sorted(rows(every, *cols)) == sorted(rows(one, *cols))
    slots = menus.meals_by_slot(one).collect()
    assert [(s.slot_name, s.dishes, s.meals[0].name) for s in slots] == [("Śniadanie", 1, "Owsianka"), ("Obiad", 1, "Zupa")]


def test_current_menu(tables):
    assert sorted(r.id for r in menus.current_daily_menu(tables.daily_menu).collect()) == [1, 2, 4, 5, 6, 7]


def test_menu_targets_and_jobs(tables):
    got = sorted(rows(menus.menu_targets(tables), "company_id", "tier_id", "diet_calories_id"), key=str)
    assert got == [("a", 6, 2), ("a", 6, 3), ("a", 7, 1), ("a", None, 6), ("off", None, 9)]
    jobs = menus.menu_jobs(tables, AS_OF)
    assert jobs.count() == 4 * 7 and jobs.where("company_id = 'off'").count() == 0
    assert rows(jobs.where("diet_calories_id = 6").orderBy("menu_date"), "menu_date")[0] == (day(AS_OF),)
    assert menus.menu_jobs(tables, AS_OF, cap=0).count() == 4


def test_menu_calendar(spark, tables):
    offers = spark.createDataFrame([("v1:a:1:6-15",), ("v1:a:1",), ("nonsense",)], "offer_id string")
    got = {(r.offer_id, str(r.menu_date)): r for r in menus.menu_calendar(tables, offers, ["2026-05-03", "2026-05-04"]).collect()}
    assert len(got) == 6
    assert [s.slot_name for s in got["v1:a:1:6-15", "2026-05-04"].slots] == ["Obiad"]
    assert got["v1:a:1", "2026-05-04"].slots == [] and got["nonsense", "2026-05-03"].error == "invalid"
    assert got["v1:a:1:6-15", "2026-05-03"].slots[0].options[0].name is None


def dish(spark, *data):
    """(seq, name, fingerprint, captured_at)"""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [(i, "a", n, f, float(i), ts(t)) for i, n, f, t in data],
        "seq long, company_id string, name string, fingerprint string, kcal double, captured_at timestamp")
    return df.withColumns({c: F.lit(None) for c in state.DISH_ATTRIBUTES if c not in ("fingerprint", "kcal")})


def fold(spark, meals, batch, unit="day"):
    seen = state.dish_sightings(meals, batch, ["seq"], unit)
    return settle(state.fold_meals(meals, seen), "meals"), state.drift_events(seen)


SIGHTINGS = [
    (1, "X", "f1", "2026-05-01"), (2, "X", "f2", "2026-05-02"), (3, "X", "f2", "2026-05-03"), (4, "X", "f1", "2026-05-04"),
    (5, "Y", "g", "2026-05-01"), (6, None, "h", "2026-05-01")]


@pytest.mark.parametrize("unit", ["hour", "year"])
def test_dish_drift(spark, unit):
    meals, drift = fold(spark, empty_table(spark, "meals"), dish(spark, *SIGHTINGS), unit)
    assert sorted(rows(drift, "name", "fingerprint", "kcal")) == [("X", "f1", 4.0), ("X", "f2", 2.0)]
    got = {r.name: r for r in meals.collect()}
    assert set(got) == {"X", "Y"}
    x = got["X"]
    assert (x.fingerprint, x.first_seen_at, x.last_seen_at, x.updated_at) == (
        "f1", ts("2026-05-01"), ts("2026-05-04"), ts("2026-05-04"))


def test_dish_fold_is_batch_split_invariant(spark):
    none = empty_table(spark, "meals")
    whole, drift = fold(spark, none, dish(spark, *SIGHTINGS))
    first, d1 = fold(spark, none, dish(spark, *SIGHTINGS[:2], SIGHTINGS[4]))
    second, d2 = fold(spark, first, dish(spark, *SIGHTINGS[2:4]))
    assert sorted(rows(whole), key=str) == sorted(rows(second), key=str)
    assert sorted(rows(drift), key=str) == sorted(rows(d1.unionByName(d2)), key=str)
    same, none_new = fold(spark, second, dish(spark, (9, "X", "f1", "2026-05-09")))
    assert none_new.count() == 0 and {r.name: r.updated_at for r in same.collect()}["X"] == ts("2026-05-04")


def test_dish_fields_join_after_the_days_are_counted(make):
    from types import SimpleNamespace

    t = SimpleNamespace(
        daily_menu=make("daily_menu", entry(1, "2026-05-01", "x")),
        meals=make("meals", {"company_id": "a", "name": "x"}), diet_calories=make("diet_calories", {"company_id": "a", "diet_id": 1, "diet_calories_id": 1}),
    )
    found = menus.option_meals(t, as_of="2026-05-02")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    counts = [line for line in plan.splitlines() if "Aggregate" in line and "count(distinct" in line]
    assert counts and not any("allergens" in line for line in counts)
    assert [(r.name, r.occurrences) for r in found.collect()] == [("x", 1)]
