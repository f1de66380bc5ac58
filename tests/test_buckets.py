"""Bucketed state against one fold over everything, and what a fold touches on disk."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larderlog.operators.folding import replace_groups
from larderlog.plans import state
from larderlog.schemas import table
from larderlog.sources.buckets import BucketedState
from larderlog.sources.tables import empty_table
from larderlog.streaming import ingest

from .conftest import rows, ts

KEYS = ["code", "source", "company_id"]
COLUMNS = [*KEYS, "title", "discount_percent", "first_seen_at", "last_seen_at"]


def sighting(i, code, company, text=None, percent=None):
    return {"id": i, "captured_at": ts(f"2026-05-01 {i // 60:02d}:{i % 60:02d}"), "code": code, "source": "banner", "company_id": company,
            "promo_text": text, "discount_percents": percent}


def many(n, seed=1):
    rnd = random.Random(seed)
    return [sighting(i, rnd.choice("ABCDEFGH"), rnd.choice([None, "1", "2", ""]), rnd.choice([None, "x", "y"]), rnd.choice([None, 5.0, 7.5]))
            for i in range(n)]


def campaigns(spark, root, **options):
    return BucketedState(spark, str(root), table("campaigns"), KEYS, **options)


def listed(df):
    return sorted(rows(df, *COLUMNS), key=str)


def files(root, folder="data"):
    return {p: p.stat().st_mtime_ns for p in (Path(root) / folder).rglob("*.parquet")}


def test_folds_equal_one_fold_and_read_only_their_buckets(make, spark, tmp_path):
    seen = many(200)
    kept = campaigns(spark, tmp_path, buckets=8)
    read = []

    def fold(current, batch):
        read.append({p.split("bucket=")[1].split("/")[0] for p in current.inputFiles()} if current.inputFiles() else set())
        return state.fold_campaigns(current, batch)

    for v in range(4):
        part = state.campaign_rows(make("promo_observations", *seen[v * 50:(v + 1) * 50]))
        touched = kept.fold(part, fold, v)
        assert read[-1] <= set(map(str, touched))
    whole = state.fold_campaigns(empty_table(spark, "campaigns"), state.campaign_rows(make("promo_observations", *seen)))
    assert listed(kept.read()) == listed(whole)


def test_untouched_buckets_are_carried_by_the_manifest_alone(make, spark, tmp_path):
    kept = campaigns(spark, tmp_path, buckets=16)
    kept.fold(state.campaign_rows(make("promo_observations", *many(120))), state.fold_campaigns, 0)
    before, all_files = listed(kept.read()), files(tmp_path)
    seen = []

    def fold(current, batch):
        seen.extend(current.inputFiles())
        return state.fold_campaigns(current, batch)

    touched = kept.fold(state.campaign_rows(make("promo_observations", sighting(900, "A", "1", "new"))), fold, 1)
    assert len(touched) == 1
    assert seen and all(f"bucket={touched[0]}/" in p for p in seen)
    changed = {p for p, at in files(tmp_path).items() if all_files.get(p) != at}
    assert changed and all(f"bucket={touched[0]}/" in str(p) for p in changed)
    after = listed(kept.read())
    assert [r for r in after if r not in before] == [r for r in after if r[:3] == ("A", "banner", "1")]
    assert listed(kept.read(before=1)) == before


def test_a_retried_batch_gives_the_same_version(make, spark, tmp_path):
    kept = campaigns(spark, tmp_path, buckets=4, keep=2)
    parts = [state.campaign_rows(make("promo_observations", *many(30, seed))) for seed in range(5)]
    for v, part in enumerate(parts):
        kept.fold(part, state.fold_campaigns, 10 * v)
    once = listed(kept.read())
    kept.fold(parts[4], state.fold_campaigns, 40)
    assert listed(kept.read()) == once and kept.versions() == [30, 40]

    def breaks(current, batch):
        return state.fold_campaigns(current, batch).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        kept.fold(parts[0], breaks, 50)
    assert listed(kept.read()) == once and kept.versions() == [30, 40]
    with pytest.raises(ValueError, match="kept any more"):
        kept.fold(parts[1], state.fold_campaigns, 10)


def test_superseded_versions_go(make, spark, tmp_path):
    kept = campaigns(spark, tmp_path, buckets=2, keep=2)
    sizes = []
    for v in range(9):
        kept.fold(state.campaign_rows(make("promo_observations", *many(20, v))), state.fold_campaigns, v)
        sizes.append(len(files(tmp_path)))
    assert kept.versions() == [7, 8]
    assert max(sizes) <= 2 * 3 and len(files(tmp_path, "manifest")) <= 3


def test_hot_null_and_emptied_buckets(make, spark, tmp_path):
    one = BucketedState(spark, str(tmp_path), table("diet_discounts"), ["company_id"], buckets=4, keep=1)
    batch = make("diet_discounts", *[{"diet_id": i, "company_id": None if i % 3 else "a", "discount": 1.0} for i in range(300)])
    one.fold(batch, lambda current, rows_: current.unionByName(rows_), 0)
    assert one.read().count() == 300
    gone = make("diet_discounts", {"company_id": "a"})
    one.fold(gone, lambda current, rows_: replace_groups(current, rows_.limit(0), rows_, ["company_id"]), 1)
    assert one.read().count() == 200 and one.read().where("company_id IS NOT NULL").count() == 0
    one.fold(gone, lambda current, rows_: current.unionByName(rows_), 2)
    one.fold(gone.limit(0), lambda current, rows_: current, 3)
    assert one.read().count() == 201
    with pytest.raises(Exception, match="changed a column"):
        one.fold(gone, lambda current, rows_: rows_.withColumn("company_id", F.explode(F.array(*[F.lit(str(i)) for i in range(9)]))), 4)
    assert one.read().count() == 201


def test_an_empty_state(make, spark, tmp_path):
    kept = campaigns(spark, tmp_path)
    assert kept.read().count() == 0 and kept.versions() == []
    kept.fold(state.campaign_rows(make("promo_observations").limit(0)), state.fold_campaigns, 0)
    assert kept.read().count() == 0 and kept.versions() == [0]


def test_stream_of_many_batches(make, spark, tmp_path):
    seen, source = many(60, 7), tmp_path / "landed"
    for at in range(0, 60, 10):
        make("promo_observations", *seen[at:at + 10]).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(table("promo_observations")).option("maxFilesPerTrigger", 1).parquet(str(source))
    kept = campaigns(spark, tmp_path / "state", buckets=4, keep=2)
    for _ in range(2):  # started again, it has nothing left to do
        ingest.bucketed_fold_stream(stream, state.fold_campaigns, kept, str(tmp_path / "check"), state.campaign_rows).awaitTermination()
    whole = state.fold_campaigns(empty_table(spark, "campaigns"), state.campaign_rows(make("promo_observations", *seen)))
    assert listed(kept.read()) == listed(whole) and kept.versions() == [4, 5]
