"""Price changes by keyed state against the batch query; timers; late captures."""

from __future__ import annotations

import random
from datetime import timedelta

from pyspark.sql import functions as F

from larderlog.plans import pricing
from larderlog.streaming import keyed

from .conftest import rows, ts

COLUMNS = ["id", "prev_per_day", "delta"]


def quote(i, leaf, at, value):
    return {"id": i, "company_id": "a", "city_id": 1, "diet_calories_id": leaf, "order_days": 10, "promo_codes": [],
            "per_day_cost_with_discounts": value, "captured_at": ts(at) if isinstance(at, str) else at}


def run(make, spark, tmp_path, groups, lateness="90 days", expiry="400 days"):
    """Every group is a file that arrives on a day of its own."""
    landed = str(tmp_path / "landed")
    for n, group in enumerate(groups):
        part = make("prices", *group).withColumn("landed_at", F.lit(ts("2026-08-01") + timedelta(days=n)))
        part.coalesce(1).write.mode("append").parquet(landed)
    quotes = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    out = str(tmp_path / "out")
    for _ in range(2):  # started again, it has nothing left to tell
        told = keyed.keyed_changes(quotes, "landed_at", lateness, expiry)
        keyed.write_keyed_changes(told, out, str(tmp_path / "check")).awaitTermination()
    return spark.read.parquet(out), keyed.read_keyed_changes(spark, out)


def test_equal_to_the_batch_query(make, spark, tmp_path):
    rnd = random.Random(4)
    seen = [quote(i, rnd.randrange(3), ts("2026-05-01") + timedelta(hours=12 * rnd.randrange(40)), rnd.choice([None, 1.0, 2.0])) for i in range(90)]
    seen.append({**quote(900, 1, "2026-05-02", 5.0), "city_id": None})
    told, stand = run(make, spark, tmp_path, [seen[i::4] for i in range(4)])
    assert sorted(rows(stand, *COLUMNS), key=str) == sorted(rows(pricing.price_changes(make("prices", *seen)), *COLUMNS), key=str)
    assert told.where("late").count() == 0


def test_late_captures_are_told_apart(make, spark, tmp_path):
    told, stand = run(make, spark, tmp_path, [
        [quote(1, 1, "2026-05-01", 5.0), quote(2, 1, "2026-05-20", 5.0)], [quote(3, 1, "2026-05-10", 9.0), quote(4, 2, "2026-05-10", 9.0)],
        [quote(5, 1, "2026-05-21", 6.0)]], lateness="2 days")
    assert rows(told.where("late"), "id") == [(3,)]
    assert rows(stand, *COLUMNS) == [(5, 5.0, 1.0)]


def test_state_expires_by_timer(make, spark, tmp_path):
    groups = [[quote(1, 1, "2026-05-01", 5.0)], [quote(2, 2, "2026-05-02", 5.0)], [quote(3, 2, "2026-05-03", 5.0)],
              [quote(4, 1, "2026-05-04", 6.0), quote(5, 2, "2026-05-04", 6.0)]]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert rows(run(make, spark, tmp_path / "a", groups, expiry="36 hours")[1], "id") == [(5,)]
    assert sorted(rows(run(make, spark, tmp_path / "b", groups)[1], "id")) == [(4,), (5,)]


def test_the_timer_removes_state(make, spark, tmp_path):
    groups = [[quote(1, 1, "2026-05-01", 5.0)], *[[quote(i, 2, "2026-05-02", 5.0)] for i in range(2, 6)]]
    run(make, spark, tmp_path, groups, expiry="12 hours")
    left = spark.read.format("statestore").load(str(tmp_path / "check"))
    assert [r["leaf"] for r in left.selectExpr("key.diet_calories_id AS leaf").collect()] == [2]


def test_state_keeps_the_lateness_and_one_instant_before_it():
    captures = [(t, i, p) for t, i, p in [(0, 1, 5), (3, 2, 6), (3, 9, 7), (10, 3, 8), (12, 4, 9)]]
    assert sorted(keyed.kept_captures(captures, 2)) == [(3, 9, 7), (10, 3, 8), (12, 4, 9)]
    assert keyed.kept_captures(captures[:1], 2) == captures[:1]
    told = keyed.told_changes(captures[:3], [(10, 3, None), (10, 4, 7)])
    assert told == [((10, 3, None), 7, True), ((10, 4, 7), 7, False)]


def test_combinations_of_a_leaf_share_one_state_and_expire_one_by_one(make, spark, tmp_path):
    def coded(i, at, value, days, codes):
        return {**quote(i, 1, at, value), "order_days": days, "promo_codes": codes}

    groups = [[coded(1, "2026-05-01", 5.0, 10, []), coded(2, "2026-05-01", 7.0, 10, ["ł\"A", "B"]), coded(3, "2026-05-01", 9.0, 5, [])],
              [coded(4, "2026-05-02", 6.0, 10, [])], [coded(5, "2026-05-03", None, 10, [])],
              [coded(6, "2026-05-04", 8.0, 10, ["ł\"A", "B"]), coded(7, "2026-05-04", 1.25, 10, [])]]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    # Nothing came of the coded one for three days, so it begins anew; the plain one goes on.
    assert sorted(rows(run(make, spark, tmp_path / "a", groups, expiry="36 hours")[1], "id", "prev_per_day")) == [(4, 5.0), (5, 6.0), (7, None)]
    left = spark.read.format("statestore").load(str(tmp_path / "a" / "check"))
    assert [len(r[0]) for r in left.selectExpr("inline(array(value))").selectExpr("groupState.combinations").collect()] == [2]
    told, stand = run(make, spark, tmp_path / "b", groups)
    assert sorted(rows(stand, "id", "promo_codes"))[2] == (6, ["ł\"A", "B"])
    left = spark.read.format("statestore").load(str(tmp_path / "b" / "check"))
    assert left.count() == 1
