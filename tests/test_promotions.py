from __future__ import annotations

import pytest

from larderlog.plans import promotions, state, work
from larderlog.sources.normalise import known_companies
from larderlog.sources.tables import Tables, empty_table

from .conftest import day, rows, ts

AS_OF = "2026-05-10"


def campaign(code, company="a", **more):
    return {"code": code, "source": "s", "company_id": company, "is_active": True, **more}


def test_active_codes_one_spelling_each(make):
    campaigns = make(
        "campaigns", campaign("FIT "), campaign("Fit"), campaign(""), campaign(" "), campaign(None),
        campaign("OLD", deadline=day("2026-05-09")), campaign("TODAY", deadline=day("2026-05-10")),
        campaign("GONE", valid_to=ts("2026-05-09 23:00")), campaign("OFF", is_active=False), campaign("ALL", company=None))
    assert sorted(rows(promotions.active_promo_codes(campaigns, AS_OF))) == [("a", "FIT"), ("a", "TODAY")]
    assert promotions.active_promo_codes(campaigns, AS_OF, company="b").count() == 0
    targets = rows(promotions.promo_targets(campaigns, AS_OF))
    assert targets == [("a", ["", " ", "FIT ", "Fit", "TODAY"])]


def test_active_promotions_order(make):
    campaigns = make(
        "campaigns", campaign("LATE", ends_at=day("2026-07-01")), campaign("NONE"), campaign("SOON", ends_at=day("2026-06-01")),
        campaign("WORLD", company=None, is_active=False), campaign("OVER", valid_to=ts("2026-05-09 23:59")),
        campaign("LASTDAY", valid_to=ts("2026-05-10 00:00"), ends_at=day("2026-05-11")))
    assert [r.code for r in promotions.active_promotions(campaigns, AS_OF).collect()] == [
        "WORLD", "LASTDAY", "SOON", "LATE", "NONE"]
    assert [r.code for r in promotions.active_campaigns(campaigns, "2026-06-02").collect()] == ["LATE", "NONE", "OVER"]


def sighting(i, code, company, at, **more):
    return {"id": i, "code": code, "source": more.pop("source", "s"), "company_id": company, "captured_at": ts(at), **more}


def test_campaign_fold(make, spark):
    firms = make("companies", {"company_id": "a"})
    seen = make(
        "promo_observations",
        sighting(1, "X", "a", "2026-05-01", discount_percents=10.0, promo_text="t1"),
        sighting(2, "X", "a", "2026-05-02", promo_text="t2"),
        sighting(3, "X", None, "2026-05-02"), sighting(4, "X", "ghost", "2026-05-03", discount_percents=5.0),
        sighting(5, "X", "", "2026-05-04"))
    folded = state.fold_campaigns(empty_table(spark, "campaigns"), state.campaign_rows(seen, firms))
    got = {r.company_id: r for r in folded.collect()}
    assert set(got) == {"a", None}
    assert (float(got["a"].discount_percent), got["a"].title) == (10.0, "t2")
    assert (got["a"].first_seen_at, got["a"].last_seen_at) == (ts("2026-05-01"), ts("2026-05-02"))
    assert float(got[None].discount_percent) == 5.0 and got[None].last_seen_at == ts("2026-05-04")
    again = state.fold_campaigns(folded, state.campaign_rows(seen, firms))
    assert sorted(rows(again), key=str) == sorted(rows(folded), key=str)
    assert sorted(r.company_id or "-" for r in known_companies(seen, firms).collect()) == ["-", "-", "-", "a", "a"]


def test_expiry_needs_both_conditions(make, spark):
    seen = ts("2026-05-08 22:00")
    campaigns = make(
        "campaigns", campaign("GO", last_seen_at=seen, deadline=day("2026-05-09")),
        campaign("TODAY", last_seen_at=seen, deadline=day("2026-05-10")), campaign("NULL", last_seen_at=seen),
        campaign("FRESH", last_seen_at=ts("2026-05-10"), deadline=day("2026-05-09")))
    got = state.expire_campaigns(campaigns, AS_OF, "2026-05-10 00:00")
    assert {r.code: r.is_active for r in got.collect()} == {"GO": False, "TODAY": True, "NULL": True, "FRESH": True}
    back = state.fold_campaigns(
        got, state.campaign_rows(make("promo_observations", sighting(1, "GO", "a", "2026-05-11"))))
    assert {r.code: r.is_active for r in back.collect()}["GO"] is True


def test_rollup(make):
    seen = make(
        "promo_observations",
        {**sighting(1, "X", "a", "2026-05-01", discount_percents=1.0, source="constant"), "feed": 1},
        {**sighting(2, "X", "a", "2026-05-02", discount_percents=2.0, source="awarded-and-top"), "feed": 0},
        {**sighting(3, "X", None, "2026-05-02", source="banner"), "feed": 3},
        {**sighting(4, "", "a", "2026-05-02"), "feed": 0}, feed="int")
    assert rows(promotions.promo_rollup(seen), "company_id", "code", "discount_percents", "sources") == [
        ("a", "X", 2.0, ["awarded-and-top", "constant"])]


def test_chips_and_primary(make, spark):
    campaigns = make(
        "campaigns", campaign("ŻABA", discount_percent=20.0), campaign("ZEBRA", discount_percent=20.0), campaign("LOW"),
        campaign("LOW", source="t", discount_percent=99.0), campaign("W", company="", discount_percent=50.0), campaign(""))
    chips = promotions.promo_chips(campaigns)
    assert sorted(rows(chips, "code", "scope")) == [
        ("LOW", "company"), ("W", "global"), ("ZEBRA", "company"), ("ŻABA", "company")]
    tiles = spark.createDataFrame(
        [("a", None), ("a", "LOW"), ("a", "NEW"), ("a", ""), ("b", None)], "company_id string, applied_code string")
    got = [
        (r.company_id, r.applied_code, r.chip and r.chip.code, r.chip and r.chip.discount_percent)
        for r in promotions.primary_promo(tiles, chips).collect()]
    assert sorted(got, key=str) == sorted(
        [("a", None, "ZEBRA", 20), ("a", "LOW", "LOW", None), ("a", "NEW", "NEW", None), ("a", "", "ZEBRA", 20),
         ("b", None, None, None)], key=str)


def test_validity_and_coverage(make):
    prices = make(
        "prices",
        {"company_id": "a", "promo_codes": ["X"], "total_promo_code_discount": 0.0, "captured_at": ts("2026-05-10 05:00")},
        {"company_id": "a", "promo_codes": ["X", "Y"], "total_promo_code_discount": 3.0, "captured_at": ts("2026-05-10 05:00")},
        {"company_id": "a", "promo_codes": ["Z"], "captured_at": ts("2026-05-10 05:00")},
        {"company_id": "a", "promo_codes": [], "captured_at": ts("2026-05-10 05:00")},
        {"company_id": "a", "promo_codes": [], "captured_at": ts("2026-05-09 05:00")},
        {"company_id": "b", "promo_codes": None, "captured_at": ts("2026-05-10 05:00")})
    assert sorted(rows(promotions.promo_validity(prices), "code", "works", "quotes")) == [
        ("X", True, 2), ("Y", True, 1), ("Z", False, 1)]
    assert sorted(rows(promotions.no_code_coverage(prices, "2026-05-10 06:00"))) == [("a", 1), ("b", 0)]


@pytest.fixture
def catalogue(make):
    return Tables(
        companies=make("companies", {"company_id": "a", "delivery_on_saturday": True}, {"company_id": "b"}),
        diets=make("diets", {"company_id": "a", "diet_id": 1, "is_menu_configuration": True},
                   {"company_id": "b", "diet_id": 1, "is_menu_configuration": None}),
        diet_options=make(
            "diet_options", {"company_id": "a", "diet_id": 1, "tier_id": 6, "diet_option_id": 15, "tier_diet_option_id": "6-15"},
            {"company_id": "a", "diet_id": 1, "tier_id": 6, "diet_option_id": 16, "valid_to": ts("2026-01-01")}),
        diet_calories=make(
            "diet_calories", {"company_id": "a", "diet_id": 1, "tier_id": 6, "diet_option_id": 15, "diet_calories_id": 1},
            {"company_id": "a", "diet_id": 1, "tier_id": 6, "diet_option_id": 16, "diet_calories_id": 2},
            {"company_id": "b", "diet_id": 1, "diet_calories_id": 3}),
        campaigns=make("campaigns", campaign("X"), campaign("Y")),
    )


def test_quote_jobs(catalogue):
    jobs = work.quote_jobs(catalogue, as_of="2026-05-07")
    assert jobs.groupBy("company_id").count().collect() and sorted(
        rows(jobs.groupBy("company_id").count())) == [("a", 12), ("b", 4)]
    codes = sorted({tuple(r.promo_codes) for r in jobs.where("company_id = 'a'").collect()})
    assert codes == [(), ("X",), ("Y",)]
    five = jobs.where("company_id = 'a' AND order_days = 5").first()
    assert five.tier_diet_option_id == "6-15" and five.delivery_dates == [
        day(d) for d in ("2026-05-08", "2026-05-09", "2026-05-11", "2026-05-12", "2026-05-13")]
    assert work.quote_jobs(catalogue, as_of="2026-05-07", with_code_only=True).count() == 8


def test_accounting(spark, catalogue):
    jobs = work.quote_jobs(catalogue, as_of="2026-05-07")
    answers = spark.createDataFrame([("a",)] * 10, "company_id string")
    books = work.run_accounting(jobs, answers)
    assert sorted(rows(books)) == [("a", 12, 10, 2, False), ("b", 4, 0, 4, True)]
    assert rows(work.silent_companies(books), "company_id") == [("b",)]
