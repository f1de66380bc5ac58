from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larderlog.functions.dates import bucket
from larderlog.operators.compare import snapshot_diff
from larderlog.operators.folding import Policy, first_known, replace_groups, retire, upsert
from larderlog.operators.joins import keep_known, same_key_join
from larderlog.operators.keyed import best_per_bucket, current_with_previous, latest_rows
from larderlog.operators import keyed, sequence
from larderlog.operators.ranks import ranked_between
from larderlog.operators.sequence import previous_values, strictly_earlier

from .conftest import rows, ts


def test_best_per_bucket_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [
            (1, "a", 5.0, ts("2026-01-01 08:00")), (2, "a", 4.0, ts("2026-01-01 09:00")),
            (3, "a", 4.0, ts("2026-01-01 07:00")), (4, "a", None, ts("2026-01-01 10:00")),
            (5, "a", None, ts("2026-01-02 10:00")), (6, None, 1.0, ts("2026-01-02 10:00")),
            (7, None, 1.0, ts("2026-01-02 10:00")),
        ],
        "id int, k string, total double, captured_at timestamp",
    )
    best = best_per_bucket(
        df, ["k"], bucket("captured_at"), [F.asc_nulls_last("total"), F.desc("captured_at"), F.desc("id")]
    )
    assert sorted(r.id for r in best.collect()) == [2, 5, 7]


def test_previous_bucket_is_the_previous_captured_one(spark):
    df = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 2, 20.0), ("a", 5, 50.0), ("b", 3, 7.0), (None, 1, 1.0), (None, 2, None)],
        "k string, d int, v double",
    )
    got = {r.k: (r.d, r.v, r.p) for r in current_with_previous(df, ["k"], "d", {"v": "p"}).collect()}
    assert got == {"a": (5, 50.0, 20.0), "b": (3, 7.0, None), None: (2, None, 1.0)}


def test_latest_rows(spark):
    df = spark.createDataFrame(
        [(1, ["A"], ts("2026-01-01")), (2, ["A"], ts("2026-01-01")), (3, [], ts("2026-01-01")), (4, None, None)],
        "id int, codes array<string>, captured_at timestamp",
    )
    assert sorted(r.id for r in latest_rows(df, ["codes"]).collect()) == [2, 3, 4]


def captures(seed=0, n=400):
    rng = random.Random(seed)
    t0 = datetime(2026, 1, 1)
    out = []
    for i in range(n):
        # One key holds most rows, many of them at the same instants.
        key = "hot" if rng.random() < 0.7 else rng.choice("abcde")
        value = rng.choice([None, 1.0, 2.0, 3.0])
        out.append((i, key, value, t0 + timedelta(minutes=rng.randrange(60 if key == "hot" else 500))))
    return out


@pytest.mark.parametrize("unit", ["minute", "hour", "year"])
def test_strictly_earlier_equals_brute_force(spark, unit):
    data = captures()
    # A third of all rows at one instant of one key.
    data += [(5000 + i, "hot", float(i % 3), data[0][3]) for i in range(len(data) // 2)]
    df = spark.createDataFrame(data, "id int, k string, v double, t timestamp")
    got = {
        r.id: None if r.previous is None else (r.previous.v,)
        for r in strictly_earlier(df, ["k"], "t", "id", ["v"], unit=unit).collect()
    }
    want = {}
    for i, k, _, t in data:
        before = [(u, j, w) for j, kk, w, u in data if kk == k and u < t]
        want[i] = (max(before, key=lambda x: (x[0], x[1]))[2],) if before else None
    assert got == want


def test_strictly_earlier_leaves_out_null_keys(spark):
    df = spark.createDataFrame(
        [(1, None, 1.0, ts("2026-01-01")), (2, None, 2.0, ts("2026-01-02")), (3, "a", 1.0, None)],
        "id int, k string, v double, t timestamp",
    )
    assert strictly_earlier(df, ["k"], "t", "id", ["v"]).count() == 0


@pytest.mark.parametrize("unit", ["minute", "hour", "year"])
def test_previous_values_equals_lag(spark, unit):
    data = captures(seed=3)
    data += [(1000 + i, None, float(i), datetime(2026, 1, 1)) for i in range(30)]
    df = spark.createDataFrame(data, "id int, k string, v double, t timestamp")
    got = {
        r.id: None if r.previous is None else (r.previous.v,)
        for r in previous_values(df, ["k"], ["t", "id"], ["v"], [F.date_trunc(unit, "t")]).collect()
    }
    want, last = {}, {}
    for i, k, v, _ in sorted(data, key=lambda x: (x[3], x[0])):
        want[i] = last.get(k)
        last[k] = (v,)
    assert got == want


def test_sequence_plans_stay_small(spark):
    df = spark.createDataFrame(captures(), "id int, k string, v double, t timestamp")
    for out in (strictly_earlier(df, ["k"], "t", "id", ["v"]), previous_values(df, ["k"], ["t", "id"], ["v"], [F.date_trunc("day", "t")])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan ") <= 3 and plan.count("Exchange hashpartitioning") <= 8


def test_joins_on_null_keys(spark):
    left = spark.createDataFrame([(1, None, "x"), (1, 2, "y"), (3, 3, "z")], "a int, b int, v string")
    right = spark.createDataFrame([(1, None, "r")], "a int, b int, w string")
    assert rows(same_key_join(left, right, ["a", "b"]), "v", "w") == [("x", "r")]
    assert sorted(rows(same_key_join(left, right, ["a", "b"], "left_anti"), "v")) == [("y",), ("z",)]
    known = spark.createDataFrame([("a",), ("a",)], "id string")
    kept = keep_known(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, c string"), "c", known, "id")
    assert sorted(rows(kept, "i", "c")) == [(1, "a"), (2, None), (3, None)]


POLICY_ARGS = dict(keys=["k", "n"], overwrite=["o"], keep=["p"])


def state(spark, *data):
    return spark.createDataFrame(list(data), "k string, n int, o int, p int, first int, closed int")


def batch(spark, *data):
    return spark.createDataFrame(list(data), "k string, n int, o int, p int, first int, closed int, seq int")


def test_upsert_policies(spark):
    policy = Policy(**POLICY_ARGS, fixed={"closed": F.lit(None)})
    current = state(spark, ("a", None, 1, 1, 1, 9), ("b", 2, 1, 1, 1, 9))
    incoming = batch(
        spark,
        ("a", None, 5, 7, 50, 0, 1), ("a", None, None, None, 60, 0, 2),
        ("c", None, 3, None, 70, 0, 5), ("c", None, 4, 8, 80, 0, 6), ("c", None, 4, None, 90, 0, 7),
    )
    got = sorted(rows(upsert(current, incoming, policy, ["seq"])), key=str)
    assert got == [("a", None, None, 7, 1, None), ("b", 2, 1, 1, 1, 9), ("c", None, 4, 8, 70, None)]


def test_upsert_laws(spark):
    policy = Policy(**POLICY_ARGS)
    rng = random.Random(5)
    data = [
        (rng.choice("abc"), rng.choice([None, 1]), rng.choice([None, 1, 2]), rng.choice([None, 3, 4]), i, None, i)
        for i in range(40)
    ]
    nothing = state(spark).limit(0)
    once = upsert(nothing, batch(spark, *data), policy, ["seq"])
    again = upsert(once, batch(spark, *data), policy, ["seq"])
    split = upsert(upsert(nothing, batch(spark, *data[:17]), policy, ["seq"]), batch(spark, *data[17:]), policy, ["seq"])
    assert sorted(rows(once), key=str) == sorted(rows(again), key=str) == sorted(rows(split), key=str)
    assert sorted(rows(upsert(once, batch(spark).limit(0), policy, ["seq"])), key=str) == sorted(rows(once), key=str)


def test_replace_groups(spark):
    current = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    new = spark.createDataFrame([(3, "n")], "k int, v string")
    touched = spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted(rows(replace_groups(current, new, touched, ["k"]))) == [(2, "z"), (3, "n")]


def test_retire_in_one_or_two_batches(spark):
    current = spark.createDataFrame(
        [("a", 1, None), ("a", 2, None), ("b", 1, None), ("a", 3, ts("2025-01-01"))],
        "c string, d int, valid_to timestamp",
    )
    seen = spark.createDataFrame(
        [("a", 1, ts("2026-01-01")), ("a", 2, ts("2026-01-02")), ("a", 2, ts("2026-01-03"))],
        "c string, d int, captured_at timestamp",
    )
    both = retire(current, seen, "c", ["c", "d"])
    want = {("a", 1): ts("2026-01-02"), ("a", 2): None, ("a", 3): ts("2025-01-01"), ("b", 1): None}
    assert {(r.c, r.d): r.valid_to for r in both.collect()} == want
    # The same payloads folded one at a time.
    day1, later = seen.where("captured_at < '2026-01-02'"), seen.where("captured_at >= '2026-01-02'")
    step = retire(current.where("d <> 2"), day1, "c", ["c", "d"])
    step = retire(step.unionByName(current.where("d = 2")), later, "c", ["c", "d"])
    assert {(r.c, r.d): r.valid_to for r in step.collect()} == want


def test_first_known(spark):
    df = spark.createDataFrame(
        [(1, None, 0), (1, 5, 1), (1, 6, 2), (2, None, 0), (2, None, 1)], "k int, v int, p int"
    )
    assert sorted(rows(first_known(df, ["k"], "v", ["p"])), key=str) == [(1, 5), (2, None)]


def test_snapshot_diff(spark):
    a = spark.createDataFrame([(1, None, 5), (1, 2, None), (2, 2, 1), (3, 3, None)], "k int, n int, v int")
    b = spark.createDataFrame([(1, None, 6), (1, 2, None), (4, 2, 1), (3, 3, 0)], "k int, n int, v int")
    assert sorted(rows(snapshot_diff(a, b, ["k", "n"], ["v"])), key=str) == [
        (1, None, "changed", 5, 6), (2, 2, "removed", 1, None), (3, 3, "changed", None, 0), (4, 2, "added", None, 1)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_as_of_join_against_brute_force(spark, strict, unit):
    rnd = random.Random(unit + str(strict))
    key = lambda: rnd.choice(["a", "a", "a", "b", None])
    when = lambda: None if rnd.random() < 0.05 else datetime(2026, 1, 1) + timedelta(hours=rnd.randrange(60))
    left = [(i, key(), when(), "left") for i in range(150)]
    right = [(i, key(), when(), rnd.choice([None, 1.0, 2.0])) for i in range(80)]
    df = spark.createDataFrame(left, "id long, k string, at timestamp, _value string")
    other = spark.createDataFrame(right, "rid long, k string, seen timestamp, price double")
    got = sequence.as_of_values(df, other, ["k"], "at", ["rid", "price"], "rid", "seen", strict, "m", unit).collect()
    assert len(got) == len(left)
    for r in got:
        fits = [(t, i, p) for i, k, t, p in right if k is not None and k == r["k"] and t and r["at"] and (t < r["at"] if strict else t <= r["at"])]
        want = max(fits, key=lambda x: x[:2])[1:] if fits else None
        assert (tuple(r["m"]) if r["m"] else None) == want
    assert sequence.as_of_values(df, other.limit(0), ["k"], "at", ["rid"], "rid", "seen").where("matched IS NOT NULL").count() == 0
    assert sequence.as_of_values(df.limit(0), other, ["k"], "at", ["rid"], "rid", "seen").count() == 0


@pytest.mark.parametrize("cells", [None, 1, 7])
def test_ranks_by_prefix_counts_against_brute_force(spark, cells):
    rnd = random.Random(8)
    seen = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 1, 2, 3]), i) for i in range(400)]
    df = spark.createDataFrame(seen, "k string, v int, id int").repartition(5)
    order = [F.asc_nulls_last("v"), F.desc("id")]
    for low, high in [(0, 3), (0, 1000), (100, 130), (239, 241), (5000, 6000)]:
        want = []
        for k in ("a", "b", None):
            own = sorted((r for r in seen if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, -r[2]))
            want += [(*r, n) for n, r in enumerate(own, 1) if low < n <= high]
        got = ranked_between(df, ["k"], order, low, high, cells).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert ranked_between(df.limit(0), ["k"], order, 0, 9, cells).count() == 0


def test_no_task_holds_a_key(spark):
    df = spark.range(4000).selectExpr("'hot' AS k", "id % 10 AS v", "id")
    plan = ranked_between(df, ["k"], [F.asc("v"), F.asc("id")], 1500, 1600, 16)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window [" in line]
    assert windows and all("_cell" in line for line in windows)


@pytest.mark.parametrize("busy", [10**9, 50, 0])
def test_previous_values_of_crowded_and_other_keys(spark, monkeypatch, busy):
    monkeypatch.setattr(keyed, "CROWDED", busy)
    data = captures(seed=8)
    data += [(1000 + i, None, float(i), datetime(2026, 1, 1)) for i in range(30)]
    df = spark.createDataFrame(data, "id int, k string, v double, t timestamp")
    out = previous_values(df, ["k"], ["t", "id"], ["v"], [F.date_trunc("hour", "t")])
    got = {r.id: None if r.previous is None else (r.previous.v,) for r in out.collect()}
    want, last = {}, {}
    for i, k, v, _ in sorted(data, key=lambda x: (x[3], x[0])):
        want[i] = last.get(k)
        last[k] = (v,)
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == (busy < len(data)) and plan.count("Window") >= 1 + 2 * ("Join" in plan)


@pytest.mark.parametrize("busy,size", [(10**9, 10**6), (50, 100), (0, 7)])
def test_dealt_rows_need_one_shuffle(spark, monkeypatch, busy, size):
    monkeypatch.setattr(keyed, "CROWDED", busy)
    monkeypatch.setattr(keyed, "ROWS_A_PART", size)
    df = spark.createDataFrame(captures(seed=9) + [(1000, None, None, None)], "id int, k string, v double, t timestamp")
    df = df.withColumn("day", F.to_date("t"))
    keys, order = ["day", "k"], [F.desc_nulls_last("v"), F.desc("id")]
    best = lambda some: keyed.top_rows(some, keys, order)
    spread = keyed.dealt(df, ["day"], keys, best)
    out = keyed.top_rows(spread, ["_part", *keys], order).drop("_part")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted(out.collect(), key=str) == sorted(best(df).collect(), key=str)
    assert plan.count("Exchange") == (1 if busy > 1000 else 2)  # the second is of crowded keys alone
    if busy < 1000:  # what is left of the hot key is shuffled, not its rows
        assert spread.where("k = 'hot'").count() < df.where("k = 'hot'").count() / 5


def test_dealing_no_rows(spark):
    df = spark.createDataFrame([], "k string, d int")
    assert keyed.dealt(df, ["d"], ["k"], lambda some: some).count() == 0
