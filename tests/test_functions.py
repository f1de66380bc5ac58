from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larderlog.functions import dates, keys, lists, text

from .conftest import day


def one(spark, column, value=None, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("67.00 zł", 67.0),
        ("1234.50 zł", 1234.5),
        ("1 234,50 zł", 1234.5),
        ("1 234,50 zł", 1234.5),
        ("1 234,50 ZŁ", 1234.5),
        ("1.234,50", 1.234),
        ("-5,5", -5.5),
        (".5", 0.5),
        ("5-3", 5.0),
        ("--5", None),
        ("1,2,3", 1.23),
        ("", None),
        (None, None),
        ("not a price", None),
    ],
)
def test_money(spark, value, expected):
    assert one(spark, text.money("v"), value) == expected


def test_money_of_a_number(spark):
    assert one(spark, text.money("v"), 42, "int") == 42.0


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("300 kcal • B:19g • W:30g • T:11g", (300.0, 19.0, 30.0, 11.0)),
        ("300.5 kcal • B:19,5g", (300.5, 19.5, None, None)),
        ("300 kcal", (300.0, None, None, None)),
        ("300 KCAL b: 2 g", (300.0, 2.0, None, None)),
        ("", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_macros(spark, value, expected):
    r = one(spark, text.macros("v"), value)
    assert (r.kcal, r.protein_g, r.carbs_g, r.fat_g) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [("300.45 kcal / 1257 kJ", 300.45), ("18.87g", 18.87), ("18,87g", 18.87), ("abc", None), (None, None), ("5.", 5.0)],
)
def test_first_number(spark, value, expected):
    assert one(spark, text.first_number("v"), value) == expected


def test_lenient_number(spark):
    assert [one(spark, text.number("v"), v) for v in (" 1.5 ", "x", None)] == [1.5, None, None]


def test_strip_knows_unicode_blanks(spark):
    assert one(spark, text.strip("v"), "  a b ﻿\n") == "a b"
    assert one(spark, text.blank_to_null("v"), " \t") is None
    assert one(spark, text.is_blank("v"), None) is True


def test_lists(spark):
    names = [" Mleko", "Gluten", "", None, "Mleko ", " "]
    assert one(spark, lists.tidy_names("v"), names, "array<string>") == ["Gluten", "Mleko"]
    assert one(spark, lists.tidy_names("v"), None, "array<string>") == []
    assert one(spark, lists.name_list("v"), ["Sól ", " ", "Jajko"], "array<string>") == "Sól; Jajko"
    assert one(spark, lists.name_list("v"), [" "], "array<string>") is None
    assert one(spark, lists.name_list("v"), None, "array<string>") is None
    assert one(spark, lists.is_empty("v"), [], "array<string>") is True
    assert one(spark, lists.is_empty("v"), None, "array<string>") is False
    assert one(spark, lists.has_any("v"), None, "array<string>") is False
    assert one(spark, lists.first_item("v"), [], "array<string>") is None
    assert one(spark, lists.comma_joined("v"), ["A", "B"], "array<string>") == "A,B"


def test_delivery_dates(spark):
    friday = F.lit("2026-05-01").cast("date")
    plain = one(spark, dates.delivery_dates(friday, 20))
    assert len(plain) == 20 and all(d.weekday() < 5 for d in plain) and plain == sorted(set(plain))
    assert plain[0] == day("2026-05-01") and plain[1] == day("2026-05-04")
    saturdays = one(spark, dates.delivery_dates(friday, 20, saturday=True))
    assert any(d.weekday() == 5 for d in saturdays) and not any(d.weekday() == 6 for d in saturdays)
    both = one(spark, dates.delivery_dates(friday, 20, True, True))
    assert (both[-1] - both[0]).days == 19
    starts = spark.range(7).select(F.date_add(friday, F.col("id").cast("int")).alias("d"))
    for n in (1, 4, 5, 6, 29):
        assert {r.n for r in starts.select(F.size(dates.delivery_dates("d", n)).alias("n")).collect()} == {n}


def test_calendar_dates(spark):
    start = F.lit("2026-02-27").cast("date")
    assert one(spark, dates.calendar_dates(start, 3)) == [day("2026-02-27"), day("2026-02-28"), day("2026-03-01")]
    assert one(spark, dates.calendar_dates(start, 0)) == []


def test_per_day_rounds_half_up_and_guards_zero(spark):
    df = spark.createDataFrame([("100.05", 10), ("1.00", 0), (None, 5)], "t string, n int")
    got = [r[0] for r in df.select(keys.per_day(F.col("t").cast("decimal(10,2)"), "n")).collect()]
    assert [None if v is None else str(v) for v in got] == ["10.01", None, None]


def test_tier_option_id_needs_both_parts(spark):
    df = spark.createDataFrame([(6, 15), (6, None), (None, None)], "t int, o int")
    assert [r[0] for r in df.select(keys.tier_option_id("t", "o")).collect()] == ["6-15", None, None]


@pytest.mark.parametrize(
    ("current", "previous", "kind", "amount"),
    [
        (10.004, 10.0, "flat", None),
        (10.005, 10.0, "up", 0.005),
        (9.0, 10.0, "down", 1.0),
        (None, 10.0, "flat", None),
        (10.0, None, "flat", None),
    ],
)
def test_price_delta(spark, current, previous, kind, amount):
    df = spark.createDataFrame([(current, previous)], "c double, p double")
    r = df.select(keys.price_delta("c", "p").alias("d")).first()["d"]
    assert r.kind == kind and (r.amount is None if amount is None else abs(r.amount - amount) < 1e-9)


def test_offer_key_round_trip(spark):
    df = spark.createDataFrame(
        [("acme", 7, "6-15", True), ("acme", 7, "6-15", False), ("acme", 7, None, True), ("acme", 7, "", True)],
        "c string, l int, t string, m boolean",
    )
    made = df.select(keys.offer_key("c", "l", "t", "m").alias("k"))
    assert [r.k for r in made.collect()] == ["v1:acme:7:6-15", "v1:acme:7", "v1:acme:7", "v1:acme:7"]
    o = made.select(keys.parse_offer_key("k").alias("o")).select("o.*").collect()
    assert [(r.diet_calories_id, r.tier_diet_option_id, r.is_menu_configuration, r.error) for r in o] == [
        (7, "6-15", True, None), (7, None, False, None), (7, None, False, None), (7, None, False, None)]


@pytest.mark.parametrize(
    ("key", "error"),
    [("v2:a:1", "invalid"), ("v1:a", "invalid"), (None, "invalid"), ("v1::1", "malformed"), ("v1:a:0", "malformed"),
     ("v1:a:1.5", "malformed"), ("v1:a:x", "malformed"), ("v1:a:5d", "malformed"), ("v1:a:1:", None)],
)
def test_bad_offer_keys(spark, key, error):
    assert one(spark, keys.parse_offer_key("v"), key)["error"] == error


def test_fingerprint_separates_null_zero_and_neighbours(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None), ("a", None, 1.0), ("a", 0.0, None), (None, 1.0, None), ("", 1.0, None), ("a", 1.0, None)],
        "n string, x double, y double",
    )
    f = [r[0] for r in df.select(keys.fingerprint("n", "x", "y")).collect()]
    assert f[0] == f[5] and f[3] == f[4] and len(set(f)) == 4
    whole = spark.createDataFrame([("a", 300)], "n string, x int").select(keys.fingerprint("n", "x", F.lit(None)))
    real = spark.createDataFrame([("a", 300.0)], "n string, x double").select(keys.fingerprint("n", "x", F.lit(None)))
    assert whole.first()[0] == real.first()[0]


def test_slot_order(spark):
    names = ["Zupa", "Kolacja", "Śliwka", "II śniadanie", "Obiad - zupa", " ŚNIADANIE ", "obiad-deser", "Obiadowa"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    rank = {r.s: r.r for r in df.select("s", keys.slot_rank("s").alias("r")).collect()}
    assert rank == {"Zupa": 8, "Kolacja": 7, "Śliwka": 8, "II śniadanie": 2, "Obiad - zupa": 4, " ŚNIADANIE ": 0,
                    "obiad-deser": 4, "Obiadowa": 8}
    unknown = df.where(keys.slot_rank("s") == 8).orderBy(keys.polish_order("s"))
    assert [r.s for r in unknown.collect()] == ["Obiadowa", "Śliwka", "Zupa"]


def test_joined_line(spark):
    df = spark.createDataFrame([("Keto", None, "")], "a string, b string, c string")
    assert df.select(text.joined_line("a", "b", "c", "a")).first()[0] == "Keto · Keto"
