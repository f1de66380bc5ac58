"""Physical plans: what is pushed down, what is limited before a shuffle, what must not appear."""

from __future__ import annotations

import pytest

from checks import ORACLES, QUERIES
from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import database, difference
from larderlog.plans import catering
from larderlog.plans.arguments import page_args
from larderlog.sources.sinks import append_observations
from larderlog.sources.tables import Tables, empty_tables, read_tables

SMALL = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


LIMITED = ["cheapest_per_bucket", "price_history", "latest_prices", "current_daily_menu", "menu_targets", "cheapest_offers"]
JOINED = ["company_tiles", "find_offers", "quote_jobs", "option_meals", "primary_promo", "price_changes", "meals_by_slot"]


@pytest.mark.parametrize("name", LIMITED + JOINED)
def test_plan_shape(spark, name):
    plan = physical(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan
    # Only the one global campaign of the offer search is found in a single task.
    assert "Exchange SinglePartition" not in plan or name in ("find_offers", "cheapest_offers")
    if name in LIMITED:
        # Partial limit below the shuffle, final one above it.
        assert plan.count("WindowGroupLimit") >= 2


def test_filters_and_columns_reach_the_scan(spark, make, tmp_path):
    t = empty_tables(spark)
    append_observations(t.prices, str(tmp_path / "prices"), "prices")
    make("prices", {"id": 1, "company_id": "a", "city_id": 1, "order_days": 10}).write.parquet(str(tmp_path / "p" / "prices"))
    t.prices = read_tables(spark, str(tmp_path / "p"), ["prices"]).prices
    tiles = catering.company_tiles(
        catering.priced_leaves(t, city_id=7, days=10, names=False), t.companies)
    scan = next(line for line in physical(tiles).splitlines() if "FileScan" in line)
    assert "EqualTo(city_id,7)" in scan and "EqualTo(order_days,10)" in scan
    read = scan[scan.index("FileScan") : scan.index("Batched")]
    assert "total_cost" in read and "total_delivery_cost" not in read and "per_day_cost" not in read


def test_no_side_is_forced_into_a_broadcast(spark, make):
    t = Tables(**vars(empty_tables(spark)))
    t.prices = make("prices", {"id": 1, "company_id": "a"})
    page = catering.catering_page(t, page_args(days=10), city_id=1)
    assert "strategy=broadcast" not in page._jdf.queryExecution().optimizedPlan().toString()


def test_every_query_has_sql():
    """Those of the library itself; some of the llm subpackage's cannot have any."""
    assert set(ORACLES) == set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "company_tiles", "kcal_bounds", "price_changes_hot_keys", "campaigns_folded", "quote_jobs", "meals_by_slot",
    "catalogue_leaves", "quoted_prices", "price_snapshot_diff", "offer_keys"])
def test_equals_sql(spark, name):
    result = difference(queries()[name](spark, SMALL), database(SMALL), oracle_sql()[name])
    assert result.startswith("= ") and result != "= 0 rows", result
