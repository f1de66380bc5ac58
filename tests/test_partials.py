"""Views from partials against the same view over all rows."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from larderlog.plans import pricing
from larderlog.functions.dates import bucket

from .conftest import rows, ts

COLUMNS = ["id", "company_id", "diet_calories_id", "total_cost"]


def quotes(n, seed=1):
    rnd = random.Random(seed)
    return [
        {"id": i, "company_id": rnd.choice(["a", "b", None]), "city_id": 1, "diet_calories_id": rnd.randrange(4), "order_days": 10,
         "tier_diet_option_id": rnd.choice([None, "1-1"]), "promo_codes": rnd.choice([[], ["X"]]), "total_cost": rnd.choice([None, 5.0, 6.0, 7.0]),
         "captured_at": None if rnd.random() < 0.03 else ts(f"2026-0{rnd.randint(1, 6)}-{rnd.randint(1, 28):02d} {rnd.randrange(3):02d}:00")}
        for i in range(n)
    ]


def listed(df):
    return sorted(rows(df, *COLUMNS), key=str)


@pytest.mark.parametrize("unit", ["day", "month"])
def test_views_equal_the_full_query_also_with_late_dates(make, spark, tmp_path, unit):
    seen = quotes(240)
    parts = [seen[i::4] for i in range(4)]  # every batch has captures of all dates
    latest = pricing.latest_view(spark, str(tmp_path / "latest"), unit)
    cheapest = pricing.cheapest_view(spark, str(tmp_path / "cheapest"), "month", unit)
    for n, part in enumerate(parts):
        for view in (latest, cheapest):
            view.add(make("prices", *part), n)
        so_far = make("prices", *[q for p in parts[:n + 1] for q in p])
        assert listed(latest.view()) == listed(pricing.latest_prices(so_far))
        assert listed(cheapest.view()) == listed(cheapest.best(so_far))
    cheapest.add(make("prices", *parts[1]), 1)  # run again
    assert listed(cheapest.view()) == listed(cheapest.best(make("prices", *seen)))


def test_a_batch_reads_itself_and_leaves_other_partials_alone(make, spark, tmp_path):
    latest = pricing.latest_view(spark, str(tmp_path))
    latest.add(make("prices", *quotes(100)), 0)
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    latest.add(make("prices", *quotes(20, 2)), 1)
    after = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    assert {p: after[p] for p in before} == before
    assert all("batch_id=1" in str(p) for p in after.keys() - before.keys())


def test_an_earlier_instant(make, spark, tmp_path):
    seen = quotes(200, 3)
    latest = pricing.latest_view(spark, str(tmp_path))
    latest.add(make("prices", *seen), 0)
    past = make("prices", *[q for q in seen if q["captured_at"] and q["captured_at"] < ts("2026-03-16")])
    assert listed(latest.view(until="2026-03-15")) == listed(pricing.latest_prices(past))
    plan = latest.view(until="2026-03-15")._jdf.queryExecution().executedPlan().toString()
    assert "capture_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_roll_up(make, spark, tmp_path):
    seen = quotes(200, 4)
    fine = pricing.cheapest_view(spark, str(tmp_path / "fine"), "month")
    coarse = pricing.cheapest_view(spark, str(tmp_path / "coarse"), "month", "year")
    assert fine.view().count() == 0
    for n in range(4):
        fine.add(make("prices", *seen[n::4]), n)
        if n == 1:
            fine.roll_up(coarse, -1, 1)
    want = listed(fine.best(make("prices", *seen)))
    assert listed(fine.view(rolled=coarse, through=1)) == want == listed(fine.view())
    fine.roll_up(coarse, 0, 3)  # batch 1 once more
    rolled = fine.view(rolled=coarse, through=3)
    assert listed(rolled) == want
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert any("batch_id" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    assert coarse.partials().select(bucket("captured_at", "year")).distinct().count() <= 2
    with pytest.raises(ValueError, match="finer"):
        fine.view(until="2026-02-01", rolled=coarse)


def test_a_batch_is_shuffled_once_for_choice_and_files(make, spark, tmp_path, monkeypatch):
    plans = []
    latest = pricing.latest_view(spark, str(tmp_path))
    keep = lambda self, df, batch_id: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(type(latest), "_write", keep)
    latest.add(make("prices", *quotes(60, 5)), 0)
    assert plans[0].count("Exchange") == 1 and "rebalance" not in plans[0].lower()
