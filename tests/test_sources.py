from __future__ import annotations

import json

from pyspark.sql import functions as F

from larderlog.plans import state
from larderlog.schemas import table
from larderlog.sources import normalise as n
from larderlog.sources import payloads, sinks
from larderlog.sources.payloads import parse_payload, payload_kinds, read_payload, split_rejects
from larderlog.sources.tables import empty_table, read_tables

from .conftest import rows, ts

RUN = {"company_id": "a", "city_id": 1, "captured_at": "2026-05-01T06:00:00.000Z"}


def landed(tmp_path, *documents, name="landed"):
    folder = tmp_path / name
    folder.mkdir()
    lines = [d if isinstance(d, str) else json.dumps(d, ensure_ascii=False) for d in documents]
    (folder / "part.json").write_text("\n".join(lines), encoding="utf-8")
    return str(folder)


def test_every_payload_kind_reads_an_empty_object(spark, tmp_path):
    path = landed(tmp_path, {})
    for kind in payload_kinds():
        assert read_payload(spark, kind, path).count() == 1


def test_bad_quotes_do_not_touch_others(spark, tmp_path):
    good = {**RUN, "diet_calories_id": 1, "order_days": 5, "cart": {"totalCostToPay": 12.345}, "items": []}
    path = landed(tmp_path, good, '{"company_id": "a", "cart"', {**RUN, "cart": None}, {**good, "items": [
        {"perDayDietCost": 7.5}, {"perDayDietCost": 1.0}]})
    ok, bad = split_rejects(read_payload(spark, "quote", path).cache())
    assert bad.count() == 1 and ok.count() == 3
    got = sorted(rows(n.price_rows(ok), "total_cost", "per_day_cost", "promo_codes"), key=str)
    assert got == [(12.35, 7.5, []), (12.35, None, [])]


def test_menu_lists_of_the_wrong_shape_give_no_rows(spark):
    texts = [json.dumps({**RUN, "date": "2026-05-01", "meals": m}) for m in (
        None, 5, [], [{"name": "S", "options": None}], [{"name": "S", "options": 3}],
        [{"name": "S", "baseDietCaloriesMealId": 7, "options": [
            {"dietCaloriesMealId": 7, "name": None, "details": {"name": " X "}}, {"name": "no id"},
            {"dietCaloriesMealId": 8, "name": "  "}]}])]
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    dishes = n.dish_rows(parse_payload(df, "menu", "payload"))
    assert sorted(rows(dishes, "name", "api_meal_slot_id", "is_default"), key=str) == [("X", 7, True), (None, 8, False)]
    assert sorted(rows(n.daily_menu_rows(dishes), "meal_name"), key=str) == [("X",), (None,)]


DIET = {"dietId": 1, "name": "D", "isMenuConfiguration": False}
OPTION = {"dietOptionId": 4, "name": "O"}


def test_the_two_catalogue_walks_differ(spark, tmp_path):
    tier = {"tierId": 6, "name": "T", "minPrice": "67.00 zł", "dietOptions": [
        {**OPTION, "dietOptionId": 15, "dietCalories": [{"dietCaloriesId": 9, "calories": 1500}]}]}
    flat = {**OPTION, "dietCalories": [{"dietCaloriesId": 1, "calories": None}, {"dietCaloriesId": 2, "calories": 2000}]}
    more = {**OPTION, "dietOptionId": 5, "dietCalories": [{"dietCaloriesId": 1, "calories": 1200}, {"dietCaloriesId": 2, "calories": 9}]}
    catalogue = read_payload(spark, "catalogue", landed(tmp_path, {**RUN, "companyDiets": [
        {**DIET, "dietTiers": [tier]}, {**DIET, "dietId": 2, "dietTiers": [], "dietOptions": [flat, more]}]}, name="c"))
    card = read_payload(spark, "city_card", landed(tmp_path, {**RUN, "dietPriceInfo": [
        {"dietId": 2, "dietCaloriesIds": [99]}, {"dietId": 2, "dietCaloriesIds": [2, 3], "discountPrice": "1 zł"},
        {"dietId": 1, "dietCaloriesIds": [8]}]}, name="k"))
    stored = n.leaf_rows(catalogue, card)
    assert sorted(rows(stored, "diet_id", "tier_id", "diet_option_id", "diet_calories_id", "calories"), key=str) == [
        (1, 6, 15, 9, 1500), (2, None, None, 1, 1200), (2, None, None, 2, 2000), (2, None, None, 3, None)]
    # Not a menu configuration, so the snapshot ignores the tiers; options stay.
    walked = n.snapshot_leaves(catalogue)
    assert sorted(rows(walked, "diet_id", "tier_id", "diet_option_id", "diet_calories_id")) == [
        (2, None, 4, 1), (2, None, 4, 2), (2, None, 5, 1), (2, None, 5, 2)]
    priced = n.with_advertised(walked, card).where("advertised IS NOT NULL")
    assert {r.advertised.discount_price for r in priced.collect()} == {"1 zł"}
    assert rows(n.tier_rows(catalogue), "min_price") == [(67.0,)]


def test_company_defaults_and_tags(spark, tmp_path):
    catalogue = read_payload(spark, "catalogue", landed(tmp_path, {**RUN, "companyHeader": {"rateValue": 91.5}}, name="c"))
    card = read_payload(spark, "city_card", landed(tmp_path, {**RUN, "lowestPrice": {"standard": "45,90 zł"}}, name="k"))
    row = n.company_rows(catalogue, card).first()
    assert (row.name, row.awarded, float(row.avg_score), row.orders_enabled) == ("a", False, 91.5, None)
    assert n.company_snapshot_rows(n.company_rows(catalogue, card)).columns == table("company_snapshots").names
    assert rows(n.company_city_rows(card), "lowest_price_standard", "lowest_price_menu_config") == [(45.9, None)]
    tags = read_payload(spark, "tag_dictionary", landed(tmp_path, {"tags": {
        "KETO": {"dietTagId": "KETO", "name": "Keto"}, "X": {"dietTagId": "X"}}}, name="t"))
    assert sorted(rows(n.tag_rows(tags), "tag_code", "label"), key=str) == [("KETO", "Keto"), ("X", None)]


def test_pages_are_concatenated(spark, tmp_path):
    path = landed(tmp_path, {"city_id": 1, "currentPage": 0, "totalPages": 2, "searchData": [{"name": "a"}, {"name": "b"}]},
                  {"city_id": 1, "currentPage": 1, "searchData": [{"name": "c"}]}, {"city_id": 1, "searchData": None})
    assert sorted(rows(n.listing_companies(read_payload(spark, "listing", path)), "company_id")) == [("a",), ("b",), ("c",)]
    listing = read_payload(spark, "listing", path)
    assert rows(n.listing_companies(listing, first=2), "company_id") == [("a",), ("b",)]
    assert rows(n.listing_companies(listing, only=["c", "z"]), "company_id") == [("c",)]


def test_append_and_read_back(spark, make, tmp_path):
    prices = make("prices", *[{"id": i, "company_id": "a", "captured_at": ts(f"2026-05-0{i} 06:00")} for i in (1, 2, 3)])
    root = str(tmp_path / "store")
    sinks.append_observations(prices, f"{root}/prices", "prices")
    sinks.append_observations(prices.where("id = 3"), f"{root}/prices", "prices")
    back = read_tables(spark, root, ["prices"]).prices
    assert sorted(r.id for r in back.collect()) == [1, 2, 3, 3]
    day = spark.read.parquet(f"{root}/prices").where("capture_date = DATE '2026-05-03'")
    assert day.count() == 2
    assert "PartitionFilters: [isnotnull(capture_date" in day._jdf.queryExecution().toString()


def test_state_versions(spark, make, tmp_path):
    root = str(tmp_path / "state")
    schema = table("diet_tags")
    assert sinks.read_state(spark, root, schema).count() == 0
    for version, label in ((0, "a"), (1, "b"), (1, "c")):
        sinks.write_state(make("diet_tags", {"tag_code": "T", "label": label}), root, version)
    assert sinks.state_versions(spark, root) == [0, 1]
    assert sinks.read_state(spark, root, schema).first().label == "c"
    assert sinks.read_state(spark, root, schema, before=1).first().label == "a"


def test_snapshot_documents(spark, tmp_path):
    catalogue = read_payload(spark, "catalogue", landed(
        tmp_path, *[{**RUN, "company_id": c, "companyDiets": [{**DIET, "dietOptions": [
            {**OPTION, "dietCalories": [{"dietCaloriesId": 1, "calories": 5}]}]}]} for c in "ab"], name="c"))
    menus = read_payload(spark, "menu", landed(tmp_path, {**RUN, "date": "2026-05-01", "meals": [
        {"name": "S", "options": [{"dietCaloriesMealId": 7, "name": "X", "details": {"fat": "1g"}}]}]}, name="m"))
    promos = n.promo_rows(catalogue=catalogue).select("city_id", "company_id", "captured_at", "code")
    documents = sinks.snapshot_documents(catalogue, n.snapshot_leaves(catalogue), n.compact_menu_days(menus), promos)
    out = str(tmp_path / "out")
    for _ in range(2):
        sinks.write_snapshot(documents, out)
    back = spark.read.json(out)
    assert sorted(rows(back, "company_id")) == [("a",), ("b",)]
    a = back.where("company_id = 'a'").first()
    assert a.leaves[0].diet_calories_id == 1 and a.menus[0].meals[0].options[0].macros.fat == "1g"


def test_catalogue_fold_keeps_what_is_not_updatable(make, spark):
    def diet(i, at, **more):
        return {"diet_id": i, "company_id": "a", "captured_at": ts(at), "updated_at": ts(at), "pos": i, **more}

    extra = {"captured_at": "timestamp", "pos": "int"}
    none = empty_table(spark, "diets")
    first = state.fold_diets(none, make("diets", diet(1, "2026-05-01", name="x", diet_tag="KETO"), diet(2, "2026-05-01"), **extra))
    second = state.fold_diets(first, make("diets", diet(1, "2026-05-02", name="y", diet_tag="VEGAN"), **extra))
    got = {r.diet_id: r for r in second.collect()}
    assert (got[1].name, got[1].diet_tag, got[1].valid_to) == ("y", "KETO", None)
    assert got[2].valid_to == ts("2026-05-02")
    empty = state.fold_diets(second, make("diets", **extra))
    assert {r.diet_id: r.valid_to for r in empty.collect()} == {1: None, 2: ts("2026-05-02")}
    back = state.fold_diets(second, make("diets", diet(2, "2026-05-03"), diet(1, "2026-05-03"), **extra))
    assert {r.valid_to for r in back.collect()} == {None}


def test_unknown_fields_survive_beside_the_known_ones(spark):
    texts = [
        '{"company_id":"a","cart":{"totalCostToPay":2.0,"coupon":{"code":"A"}},"loyalty":7,"items":[{"new":1}]}',
        '{"company_id":"b","loyalty":null,"Company_Id":"c"}', '{"company_id":"c","cart":{"totalCostToPay":1.0}}', '{"broken', None, "[1]", "",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    got = payloads.parse_open_payload(df, "quote", "payload")
    good, bad = payloads.split_rejects(got)
    assert bad.count() == got.where(f"{payloads.REJECT_COLUMN} IS NOT NULL").count() >= 1
    extra = {r["company_id"]: r["e"] for r in good.where("company_id IS NOT NULL").select("company_id", F.to_json("extra").alias("e")).collect()}
    assert json.loads(extra["a"]) == {"loyalty": 7, "cart.coupon": {"code": "A"}}
    assert json.loads(extra["b"]) == {"loyalty": None, "Company_Id": "c"} and extra["c"] is None
    plain = payloads.parse_payload(df, "quote", "payload")
    assert sorted(map(str, got.drop("extra").collect())) == sorted(map(str, plain.collect()))
    told = {(r["field"], r["type"]): r["n"] for r in payloads.appeared_fields(df, "quote", "payload").collect()}
    assert told == {("loyalty", "BIGINT"): 1, ("loyalty", "VOID"): 1, ("Company_Id", "STRING"): 1, ("cart.coupon", "OBJECT<code: STRING>"): 1}


def test_accounting_comes_from_the_writes(make, spark, tmp_path):
    batch = lambda *totals: make("prices", *[{"company_id": c, "total_cost": v} for c, v in totals])
    root = str(tmp_path)
    assert sinks.write_accounted(batch(("a", 1.0), ("a", None), (None, 2.0)), root, 0) == {"rows": 3, "priced": 2}
    assert sinks.write_accounted(batch(("b", 1.0)), root, 1) == {"rows": 1, "priced": 1}
    assert sinks.write_accounted(batch(("a", 1.0), ("b", 1.0)), root, 1) == {"rows": 2, "priced": 2}  # run again
    assert sinks.write_accounted(batch().limit(0), root, 2) == {"rows": 0, "priced": 0}
    counts = sinks.accounted(spark, root).groupBy("company_id").agg(F.sum("rows").alias("r"), F.sum("priced").alias("p"))
    assert sorted(rows(counts), key=str) == sorted([("a", 3, 2), ("b", 1, 1), (None, 1, 1)], key=str)
    assert sorted(rows(sinks.accounted(spark, root, "totals"), "batch_id", "rows", "priced")) == [(0, 3, 2), (1, 2, 2), (2, 0, 0)]
