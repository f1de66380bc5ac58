from __future__ import annotations

import json

from pyspark.sql import functions as F

from larderlog.plans import pricing, state
from larderlog.schemas import REJECT_COLUMN, table
from larderlog.sources import normalise
from larderlog.sources.payloads import stream_payload
from larderlog.sources.sinks import read_state, state_versions
from larderlog.streaming import ingest, prices

from .conftest import rows, ts


def quote(i, leaf, at, value, total=None):
    return {"id": i, "company_id": "a", "city_id": 1, "diet_calories_id": leaf, "order_days": 10, "promo_codes": [],
            "per_day_cost_with_discounts": value, "total_cost": total, "captured_at": ts(at)}


QUOTES = [
    quote(1, 1, "2026-05-01 06:00", 5.0, 50.0), quote(2, 1, "2026-05-01 07:00", 5.0, 40.0),
    quote(3, 1, "2026-05-02 06:00", 6.0, 60.0), quote(4, 2, "2026-05-02 06:00", 1.0),
    quote(5, 1, "2026-05-02 06:00", 7.0, 70.0), quote(6, 1, "2026-05-03 06:00", None), quote(7, 2, "2026-05-03 06:00", 1.0, 3.0)]


def in_files(make, spark, tmp_path, *groups):
    """A stream that delivers each group of rows as one file and micro-batch."""
    source = tmp_path / "source"
    for g in groups:
        make("prices", *g).coalesce(1).write.mode("append").parquet(str(source))
    return spark.readStream.schema(table("prices")).option("maxFilesPerTrigger", 1).parquet(str(source))


def test_price_changes_in_batches_equal_batch_query(make, spark, tmp_path):
    stream = in_files(make, spark, tmp_path, QUOTES[:3], QUOTES[3:5], QUOTES[5:])
    prices.change_stream(
        stream, str(tmp_path / "events"), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    assert state_versions(spark, str(tmp_path / "state")) == [0, 1, 2]
    cols = ["id", "prev_per_day", "delta"]
    want = sorted(rows(pricing.price_changes(make("prices", *QUOTES)), *cols), key=str)
    assert sorted(rows(prices.read_changes(spark, str(tmp_path / "events")), *cols), key=str) == want
    assert [r[0] for r in want] == [3, 5, 6]


def test_a_capture_that_slips_in(make, spark, tmp_path):
    series = [quote(1, 1, "2026-05-01", 9.0), quote(3, 1, "2026-05-03", 5.0), quote(4, 1, "2026-05-04", 6.0), quote(2, 1, "2026-05-02", 5.0)]
    stream = in_files(make, spark, tmp_path, series[:3], series[3:])
    events = str(tmp_path / "events")
    prices.change_stream(stream, events, str(tmp_path / "state"), str(tmp_path / "check"), lateness="9 days").awaitTermination()
    cols = ["id", "prev_per_day", "delta"]
    got = sorted(rows(prices.read_changes(spark, events), *cols))
    assert got == sorted(rows(pricing.price_changes(make("prices", *series)), *cols)) == [(2, 9.0, -4.0), (4, 5.0, 1.0)]
    assert spark.read.parquet(f"{events}-late").count() == 0


def test_a_capture_beyond_the_lateness_is_set_aside(make, spark, tmp_path):
    stream = in_files(make, spark, tmp_path, [quote(2, 1, "2026-05-20", 5.0)], [quote(1, 1, "2026-05-01", 9.0)])
    events = str(tmp_path / "events")
    prices.change_stream(stream, events, str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    assert rows(spark.read.parquet(f"{events}-late"), "id") == [(1,)]
    assert prices.read_changes(spark, events).count() == 0


def test_daily_cheapest(make, spark, tmp_path):
    stream = in_files(make, spark, tmp_path, QUOTES[:1], QUOTES[1:4], QUOTES[4:])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    prices.write_updates(prices.daily_cheapest(stream), out, check).awaitTermination()
    got = prices.read_updates(spark, out, ["day", *prices.COMBO])
    assert sorted(rows(got.select(F.date_format("day", "dd").alias("d"), "diet_calories_id", "id"))) == [
        ("01", 1, 2), ("02", 1, 3), ("02", 2, 4), ("03", 1, 6), ("03", 2, 7)]


def test_quotes_are_ingested_once(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()

    def land(name, *documents):
        (landed / name).write_text("\n".join(documents))

    good = json.dumps({"company_id": "a", "captured_at": "2026-05-01T06:00:00Z", "cart": {"totalCostToPay": 1.5}})
    land("1.json", good, '{"broken')
    out, check = str(tmp_path / "prices"), str(tmp_path / "check")

    def run():
        ingest.append_stream(stream_payload(spark, "quote", str(landed)), normalise.price_rows, out, check).awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 1
    assert run() == 1
    land("2.json", good)
    assert run() == 2
    assert rows(spark.read.parquet(f"{out}-rejects"), REJECT_COLUMN) == [('{"broken',)]


def test_fold_stream_equals_one_fold(make, spark, tmp_path):
    extra = {"captured_at": "timestamp"}
    seen = [{"tag_code": c, "label": v, "captured_at": ts(f"2026-05-0{i}")} for i, (c, v) in enumerate(
        [("A", "1"), ("B", "1"), ("A", "2"), ("C", "1"), ("B", None)], 1)]
    source = tmp_path / "source"
    for g in (seen[:2], seen[2:4], seen[4:]):
        make("diet_tags", *g, **extra).coalesce(1).write.mode("append").parquet(str(source))
    schema = make("diet_tags", seen[0], **extra).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    root = str(tmp_path / "state")
    ingest.fold_stream(stream, state.fold_diet_tags, table("diet_tags"), root, str(tmp_path / "check")).awaitTermination()
    folded = read_state(spark, root, table("diet_tags"))
    assert sorted(rows(folded, "tag_code", "label"), key=str) == [("A", "2"), ("B", None), ("C", "1")]


def test_redelivered_rows_are_dropped(make, spark, tmp_path):
    stream = in_files(make, spark, tmp_path, QUOTES[:3], QUOTES[:4])
    once = ingest.without_redelivery(stream, ["company_id", "diet_calories_id", "id"])
    query = once.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]


def test_text_lands_compressed_in_small_files(spark, tmp_path):
    from checks.stream_checks import land_text

    land_text(spark.range(600_000).coalesce(1).selectExpr("concat('{\"id\": ', id, '}') AS value"), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*.txt.gz"))) == len(list((tmp_path / "t").glob("part-*"))) == 3
    assert spark.read.text(str(tmp_path / "t")).distinct().count() == 600_000


class Landed(Exception):
    pass


def landed_files(spark, monkeypatch, tmp_path, query, module, reader):
    """How many files a query's input lands in, before anything reads them."""
    from checks import stream_checks

    def stop(*args, **options):
        raise Landed

    monkeypatch.setattr(stream_checks, "work_folder", lambda *_: str(tmp_path))
    monkeypatch.setattr(getattr(stream_checks, module), reader, stop)
    try:
        getattr(stream_checks, query)(spark, "/root/testdata/sf0.001")
    except Landed:
        return len(list((tmp_path / "landed").glob("part-*")))


def test_a_micro_batch_of_price_changes_is_read_by_several_tasks(spark, monkeypatch, tmp_path):
    assert landed_files(spark, monkeypatch, tmp_path, "price_change_stream", "prices", "change_stream") == 24
