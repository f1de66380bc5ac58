"""Price changes by state per leaf, with timers.

Each leaf keeps, of every combination (order length, codes) it is quoted for, the
captures of the last ``lateness`` and the instant before them, in Spark's own state
store; a micro-batch costs the leaves it brings.  Timers run on the arrival of
captures: a combination of which nothing arrived for ``expiry`` is forgotten, and its
next capture counts as the first.  A leaf is one call of the Python function with few
columns, as a call costs more than the rows of a leaf: quotes come and go as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.dates import as_time
from ..operators.keyed import top_rows
from ..plans.pricing import QUOTED

PRICE = "per_day_cost_with_discounts"
#: The parts of a combination's key that share a state.
LEAF = ["company_id", "city_id", "diet_calories_id"]
#: What a combination keeps of its captures; times are microseconds.
STATE = (
    "combinations ARRAY<STRUCT<order_days: INT, promo_codes: ARRAY<STRING>, seq: LONG, arrived_ms: LONG, "
    "times: ARRAY<LONG>, ids: ARRAY<LONG>, prices: ARRAY<DECIMAL(10,2)>>>"
)
CHANGE = (
    "company_id STRING, city_id LONG, diet_calories_id LONG, order_days INT, promo_codes ARRAY<STRING>, captured_us LONG, id LONG, "
    f"{PRICE} DECIMAL(10,2), prev_per_day DECIMAL(10,2), changed BOOLEAN, late BOOLEAN, seq LONG"
)
Capture = tuple[int, int, object]


def _instants(captures: list[Capture]) -> dict[int, Capture]:
    """The capture that speaks for each instant: the one with the highest id."""
    speakers: dict[int, Capture] = {}
    for c in captures:
        if c[0] not in speakers or c[1] > speakers[c[0]][1]:
            speakers[c[0]] = c
    return speakers


def told_changes(stored: list[Capture], new: list[Capture]) -> list[tuple[Capture, object, bool]]:
    """(capture, price before, changed) of the new captures, and again of those behind the first of them.

    A capture's price is compared with the newest strictly earlier instant; the
    first has none and is no change.
    """
    if not new:
        return []
    speakers = _instants(stored + new)
    times = sorted(speakers)
    before = dict(zip(times[1:], times))
    first = min(c[0] for c in new)
    out = []
    for c in sorted([*new, *(s for s in stored if s[0] > first)], key=lambda c: c[:2]):
        earlier = speakers[before[c[0]]][2] if c[0] in before else None
        out.append((c, earlier, c[0] in before and c[2] != earlier))
    return out


def kept_captures(captures: list[Capture], lateness_us: int) -> list[Capture]:
    """The captures of the last ``lateness`` and the one that speaks for the instant before them."""
    floor = max(c[0] for c in captures) - lateness_us
    older = [c for c in captures if c[0] < floor]
    return [c for c in captures if c[0] >= floor] + ([max(older, key=lambda c: c[:2])] if older else [])


def _told(lateness_us: int, expiry_ms: int):
    columns = [part.split()[0] for part in CHANGE.split(", ")]

    def told_of(combination: tuple, stored_state: tuple | None, arriving: list[dict]) -> tuple[tuple, list[tuple]]:
        """The next state of a combination and what is told of it."""
        seq, last, times, ids, prices = stored_state or (0, 0, [], [], [])
        stored: list[Capture] = []
        # Also where captures come in the very batch that would have fired the timer.
        if min(q["arrived_ms"] for q in arriving) <= last + expiry_ms:
            stored = list(zip(times, ids, prices))
        captures = [(q["captured_us"], q["id"], Decimal(q["price"]) if "price" in q else None) for q in arriving]
        floor = max(c[0] for c in stored) - lateness_us if stored else None
        late = [c for c in captures if floor is not None and c[0] < floor]
        new = [c for c in captures if floor is None or c[0] >= floor]
        kept = kept_captures(stored + new, lateness_us)
        arrived = max(last, *(q["arrived_ms"] for q in arriving))
        state = (*combination, seq + 1, arrived, [c[0] for c in kept], [c[1] for c in kept], [c[2] for c in kept])
        told = [(*c, before, changed, False) for c, before, changed in told_changes(stored, new)] + [(*c, None, False, True) for c in late]
        return state, [(*t, seq + 1) for t in told]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {(c[0], tuple(c[1])): tuple(c) for c in state.get[0]} if state.exists else {}
        arriving: dict[tuple, list[dict]] = {}
        if not state.hasTimedOut:
            for rows in batches:
                for q in map(json.loads, rows["quote"]):
                    arriving.setdefault((q["order_days"], tuple(q["promo_codes"])), []).append(q)
        leaf, out = [key[0], int(key[1]), int(key[2])], []
        for (days, codes), quotes in arriving.items():
            before = known.get((days, codes))
            known[days, codes], told = told_of((days, list(codes)), before[2:] if before else None, quotes)
            out += [json.dumps(dict(zip(columns, [*leaf, days, codes, *t])), default=str) for t in told]
        # The timer is that of the combination that expires first; the others outlive it.
        now = state.getCurrentWatermarkMs()
        kept = [c for k, c in known.items() if k in arriving or c[3] + expiry_ms > now]
        if kept:
            state.update((kept,))
            state.setTimeoutTimestamp(max(min(c[3] for c in kept), now) + expiry_ms if arriving else min(c[3] for c in kept) + expiry_ms)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"told": out})

    return run


def keyed_changes(quotes: DataFrame, arrived: str, lateness: str = "2 days", expiry: str = "400 days") -> DataFrame:
    """Changes, corrections and late captures of a stream of quotes, one row each time one is told.

    ``arrived`` is the time a capture landed, which only moves forward.  A
    capture that slips in between two others tells its successor once more.
    Captures older than ``lateness`` before the combination's newest are told as
    ``late`` and change nothing.  Rows without a key part or a time are left out.
    """
    usable = quotes.dropna(subset=[*QUOTED, "captured_at"])
    quote = F.struct(
        F.col("order_days").cast("int").alias("order_days"), "promo_codes", F.unix_micros("captured_at").alias("captured_us"), "id",
        F.col(PRICE).cast("decimal(10,2)").cast("string").alias("price"), F.unix_millis(arrived).alias("arrived_ms"),
    )
    rows = usable.select(*LEAF, F.to_json(quote).alias("quote"), F.col(arrived).alias("arrived")).withWatermark("arrived", "0 seconds")
    told = rows.groupBy(*LEAF).applyInPandasWithState(
        _told(_micros(lateness), _micros(expiry) // 1000), "told STRING", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    told = told.select(F.from_json("told", CHANGE, {"mode": "FAILFAST"}).alias("t")).select("t.*")
    return told.withColumn("captured_at", F.timestamp_micros("captured_us")).drop("captured_us")


def _micros(span: str) -> int:
    return pd.Timedelta(span) // pd.Timedelta(1, "us")


def write_keyed_changes(told: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is told to ``path``; the file sink counts every micro-batch once."""
    return (
        told.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_keyed_changes(spark, path: str, since=None) -> DataFrame:
    """The changes that stand: of each capture what was told last."""
    rows = spark.read.parquet(path).where("NOT late")
    if since is not None:
        rows = rows.where(F.col("captured_at") >= as_time(since))
    last = top_rows(rows, [*QUOTED, "captured_at", "id"], [F.desc("seq")])
    return last.where("changed").withColumn("delta", F.col(PRICE) - F.col("prev_per_day")).drop("changed", "late", "seq")
