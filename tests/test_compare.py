"""The pruned difference of snapshots against the plain one, and what it leaves unread."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from larderlog.operators import compare
from larderlog.operators.compare import differing_partitions, partition_digests, rolled_digests, snapshot_diff
from larderlog.plans.snapshots import stored_diff
from larderlog.sources.sinks import read_compared, write_compared

SCHEMA = "company string, day int, item string, price double, codes array<string>"
LEVELS, KEYS, VALUES = [["day"], ["day", "company"]], ["company", "day", "item"], ["price", "codes"]


def snapshot(seed=1):
    rnd = random.Random(seed)
    keys = {(rnd.choice(["a", "b", "c", None]), rnd.randrange(6), rnd.choice([None, *"klmnop"])) for _ in range(120)}
    return [(*k, rnd.choice([None, 1.0, 2.0]), rnd.choice([None, [], ["x"], ["x", "y"]])) for k in sorted(keys, key=str)]


def listed(df):
    return sorted(map(str, df.collect()))


def stored(spark, tmp_path, *sides):
    paths = []
    for i, side in enumerate(sides):
        paths.append(str(tmp_path / str(i)))
        write_compared(spark.createDataFrame(side, SCHEMA), paths[-1], LEVELS, KEYS, VALUES)
    return paths


def test_equal_to_the_plain_difference(spark, tmp_path):
    before = snapshot()
    after = [r for r in before if r[1:3] != (2, "k")]
    after = [(*r[:3], 9.0, r[4]) if r[:2] == ("a", 3) else r for r in after] + [("new", 4, "k", None, None), (None, 9, None, None, None)]
    frames = [spark.createDataFrame(x, SCHEMA) for x in (before, after)]
    paths = stored(spark, tmp_path, before, after)
    got = stored_diff(spark, *paths, frames[0].schema, LEVELS, KEYS, VALUES)
    assert got.columns == snapshot_diff(*frames, KEYS, VALUES).columns
    assert listed(got) == listed(snapshot_diff(*frames, KEYS, VALUES)) and got.count() > 5
    assert stored_diff(spark, paths[0], paths[0], frames[0].schema, LEVELS, KEYS, VALUES).count() == 0


def test_rows_of_equal_partitions_do_not_reach_the_row_stage(spark, tmp_path):
    before = snapshot(2)
    after = [(*r[:3], 7.0, r[4]) if r[:2] == ("b", 1) else r for r in before]
    paths = stored(spark, tmp_path, before, after)
    digests = [spark.read.parquet(f"{p}/digests") for p in paths]
    wanted = differing_partitions(*digests, LEVELS)
    assert [tuple(r) for r in wanted.collect()] == [(1, "b")]
    schema = spark.createDataFrame(before, SCHEMA).schema
    got = stored_diff(spark, *paths, schema, LEVELS, KEYS, VALUES)
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert sum("day" in f and "= 1" in f for f in filters) == 2  # days without a difference are not read
    assert {r["company"] for r in got.collect()} == {"b"} and {r["day"] for r in got.collect()} == {1}
    rows = read_compared(spark, paths[1], schema)
    touched = rows.join(F.broadcast(wanted), ["day", "company"], "left_semi").count()
    assert touched == sum(r[:2] == ("b", 1) for r in after) < len(after) / 5


def test_digests_see_order_free_content_and_nothing_else(spark):
    rows = snapshot(3)
    digest = lambda x: {r["day"]: tuple(r)[1:] for r in partition_digests(spark.createDataFrame(x, SCHEMA), ["day"], KEYS, VALUES).collect()}
    assert digest(rows) == digest(rows[::-1])
    moved = [(*r[:4], ["x y"]) if r[4] == ["x", "y"] else r for r in rows]
    assert digest(rows) != digest(moved)
    null = [(r[0], r[1], "" if r[2] is None else r[2], *r[3:]) for r in rows]
    assert digest(rows) != digest(null)
    df = spark.createDataFrame(rows, SCHEMA)
    assert listed(rolled_digests(partition_digests(df, ["day", "company"], KEYS, VALUES), ["day"])) == listed(
        rolled_digests(partition_digests(df, ["day"], KEYS, VALUES), ["day"]))


def test_repeated_keys_are_merged_while_they_are_written(spark, tmp_path):
    once = [(*r[:3], r[3] is None) for r in snapshot(6)]
    schema, values = "company string, day int, item string, v boolean", ["v"]
    twice = spark.createDataFrame([(*r[:3], False) for r in once] + once + once, schema)
    write_compared(twice, str(tmp_path / "a"), LEVELS, KEYS, values, merge={"v": F.bool_or("v")})
    write_compared(spark.createDataFrame(once, schema), str(tmp_path / "b"), LEVELS, KEYS, values)
    a, b = (read_compared(spark, str(tmp_path / x), twice.schema) for x in "ab")
    assert listed(a.select("company", "day", "item", "v")) == sorted(map(str, spark.createDataFrame(once, schema).collect()))
    assert stored_diff(spark, str(tmp_path / "a"), str(tmp_path / "b"), twice.schema, LEVELS, KEYS, values).count() == 0 and b.count() == a.count()


def test_few_differing_partitions_leave_the_digests_unshuffled(spark, tmp_path, monkeypatch):
    before = snapshot(2)
    after = [(*r[:3], 7.0, r[4]) if r[:2] == ("b", 1) else r for r in before]
    digests = [spark.read.parquet(f"{p}/digests") for p in stored(spark, tmp_path, before, after)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = differing_partitions(*digests, LEVELS)
        monkeypatch.setattr(compare, "MOST_TOLD", 0)
        joined = differing_partitions(*digests, LEVELS)
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (told, joined)]
        assert listed(told) == listed(joined) == ["Row(day=1, company='b')"]
        assert "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
