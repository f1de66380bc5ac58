import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larderlog.llm import hard_negatives, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def clashing(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    for name in ("_vector", "n", "dim", "cell", "_anchor", "rank", "id", "score", "positive", "d", "deviation", "_id", "_n"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def vectors(seed=1, n=400, d=6):
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((n, d)) * np.arange(1, d + 1) / d + rnd.integers(0, 2, (n, 1))
    x[n // 2:n // 2 + n // 5] = x[0]  # a common vector
    rows = [(i, [float(np.float32(v)) for v in r], int(rnd.integers(0, 10))) for i, r in enumerate(x)]
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [NAN] * d, 1), (n + 3, [INF] + [0.0] * (d - 1), 2), (n + 4, [None] + [0.0] * (d - 1), 3),
           (n + 5, [1.0], 4), (n + 6, [1e38] * d, 4), (n + 7, [1.0] * d, None)]
    return rows, odd


def test_counts_of_pivots_are_counts_of_eigenvalues():
    rnd = np.random.default_rng(5)
    for d in (1, 2, 3, 9, 30):
        for rank in {1, d // 2 + 1, d}:
            b = rnd.standard_normal((d, rank))
            a = b @ b.T - 0.3 * np.eye(d)
            expected = np.linalg.eigvalsh(a)
            for shift in rnd.uniform(expected[0] - 1, expected[-1] + 1, 10):
                assert whitening.count_above(a, shift) == (expected > shift).sum()
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize("values", [[5.0, 4.0, 3.0, 1.0], [3.0, 3.0, 3.0, 1.0], [2.0, 2.0 - 1e-9, 1.0, 1.0], [4.0, 0.0, 0.0, 0.0], [0.0] * 4])
def test_leading_eigenpairs(values):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((4, 4)))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    for wanted in (1, 3, 9):
        e, v = whitening.leading_eigenpairs(a, wanted)
        assert len(e) == min(wanted, 4)
        assert e == pytest.approx(sorted(values, reverse=True)[:wanted], abs=1e-12)
        assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-12
        assert np.abs(a @ v - v * e).max() < 1e-12


def test_whitening_against_brute_force(spark):
    rows, odd = vectors()
    usable = rows + [rows[3], (None, rows[4][1], 1), (900, [1.0] * 6, None)]
    df = clashing(spark, usable + odd[:-1]).repartition(5)
    fitted = whitening.fit_whitening(df, components=4)
    got = whitening.whiten(df, fitted).collect()
    assert len(got) == len(usable)
    x = np.floor(64 * np.array([r[1] for r in usable], dtype=np.float32).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    assert fitted.n == n and fitted.eigenvalues == pytest.approx(e[:4], rel=1e-12) and fitted.trace == pytest.approx(e.sum())
    assert whitening.identity_error(df, fitted) < 1e-9
    want = {r[0]: (sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)), row) for r, row in zip(usable, x)}
    signs = np.sign((v[:, :4] * fitted.vectors).sum(0))
    for r in got:
        deviation, row = want[r["vec_id"]]
        assert r["deviation"] == deviation
        assert r["whitened"] == pytest.approx(signs * ((row - s / n) @ v[:, :4]) / np.sqrt(e[:4]), abs=1e-9)


def test_whitening_of_large_offsets_and_degenerate_tables(spark):
    far = [(i, [1e6 + i % 3, -1e6 + i % 5], 0) for i in range(40)]
    df = spark.createDataFrame(far, "vec_id long, embedding array<double>, label int")
    fitted = whitening.fit_whitening(df)
    assert whitening.identity_error(df, fitted) < 1e-9 and len(fitted.eigenvalues) == 2
    same = clashing(spark, [(i, [0.5, 0.25], 0) for i in range(5)])
    fitted = whitening.fit_whitening(same)
    assert len(fitted.eigenvalues) == 0 and whitening.identity_error(same, fitted) == 0.0
    assert [r["whitened"] for r in whitening.whiten(same, fitted).collect()] == [[]] * 5
    assert whitening.fit_whitening(same.limit(0)) is None
    huge = spark.createDataFrame([(i, [4e9 * i], 0) for i in range(3)], "vec_id long, embedding array<double>, label int")
    got = whitening.whiten(huge, whitening.fit_whitening(huge)).collect()
    assert [r["deviation"] for r in sorted(got)] == [None, 0, None]


def test_whitening_query(spark):
    got = whitening.op11_spectrum_slices(spark, "/root/testdata/sf0.001").toPandas()
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert len(got) == 32 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9
    assert (np.diff(got.groupby("component")["explained"].first()) <= 0).all()


def mined(rows, is_anchor):
    """Hard negatives by comparing all rows."""
    usable = {}
    for i, v, label in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2], r[1])):
        if len(v) == 6 and all(x is not None and math.isfinite(x) and abs(x) < 2**44 for x in v):
            usable.setdefault(i, ([math.floor(256 * x) for x in v], label))
    out = set()
    for a, (va, la) in usable.items():
        if is_anchor(a):
            scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (v, label) in usable.items() if i != a)
            for p, pos, _ in [s for s in scored if s[2] == la][:5]:
                fits = [s for s in scored if s[2] != la and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
                out |= {(a, pos, k + 1, neg, -p, -s) for k, (s, neg, _) in enumerate(fits)}
    return out


@pytest.mark.parametrize("at_once, seed_rows", [(20_000, 20_000), (12, 60), (12, 20_000)])
def test_hard_negatives_against_brute_force(spark, at_once, seed_rows):
    rows, odd = vectors(4)
    rows = rows + odd + [rows[7], (8, rows[9][1], 3), (None, rows[1][1], 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = clashing(spark, rows).repartition(6)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, anchors_at_once=at_once, seed_rows=seed_rows).collect()
    want = mined(rows, lambda i: i % 10 == 0)
    assert len(got) == len(want) > 200 and {tuple(r) for r in got} == want


def test_hard_negatives_of_small_tables(spark):
    df = clashing(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [-1.0, 0.0], 2)])
    got = hard_negatives.hard_negatives(df, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 230 * 256)]
    assert hard_negatives.hard_negatives(df, F.col("vec_id") == 77).count() == 0
    assert hard_negatives.hard_negatives(df.where("label = 1"), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0
    # Opposite vectors: a negative score has no share of itself below itself.
    assert hard_negatives.hard_negatives(df, F.col("vec_id") == 3).count() == 0


def test_walks_end_early():
    rnd = random.Random(3)
    near = [[1000.0, rnd.randint(-50, 50)] for _ in range(40)]
    far = [[float(rnd.randint(-900, 0)), 5.0] for _ in range(6000)]
    x = np.array(near + far)
    group = hard_negatives.clustered(np.arange(8), np.zeros(8, dtype=int), x[:8])
    unit, lengths = hard_negatives._unit(x)
    angles = hard_negatives._angles(unit, group.centres)
    bounds = lengths * np.cos(np.maximum(angles[:, 0] - group.radius[0], 0))
    order = np.argsort(-bounds, kind="stable")
    seen = []
    inf = np.full((8, 1), np.inf)
    for anchor, _, ids, _ in hard_negatives.walked(group, 0, 8, bounds, order, np.arange(len(x)), np.zeros(len(x), dtype=int), x, True, -inf, inf, 5, True, lengths.max()):
        seen.append(len(ids))
    assert len(seen) == 1  # one step of the list was enough
