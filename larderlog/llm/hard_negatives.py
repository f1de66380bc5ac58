"""Hard negatives by candidate lists that clusters of anchors share.

Anchors are taken in groups of bounded size and clustered by direction.  The
angle between an anchor and a candidate is at least the candidate's angle to the
cluster's centre less the cluster's radius, hence length times the cosine of that
difference bounds the candidate's inner product with every unit anchor of the cluster.
Each shard of candidates is sorted by this bound once per cluster; every anchor
walks the sorted list in steps and stops as soon as the next bound can no longer
enter its answer, which certifies the answer for the shard.  What shards find is
merged by Spark.  A first walk over a bounded sample of candidates gives every
anchor a floor that real rows have reached already, so that shards return little; floors
change the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import top_rows
from .common import settled, table
from .vectors import matrix, of_one_length, whole_entries

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Share of the positive's score, in hundredths, that a negative reaches at least.
LEAST_SHARE = 80
#: Anchors that travel to the tasks at once, clusters they form, rows whose scores give the floors.
ANCHORS_AT_ONCE, CLUSTERS, SEED_ROWS = 20_000, 32, 20_000
#: Candidates of a shard, and how many of its list an anchor takes at a step.
SHARD, STEP = 16_384, 1024
#: Inner products of integers are exact as doubles up to here.
EXACT = 2.0**53
FOUND = "anchor_id long, positive int, id long, score long"


@dataclass(frozen=True)
class Anchors:
    """A group of anchors, sorted by cluster; ``starts`` has the first of each cluster and the end."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    starts: np.ndarray


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.linalg.norm(x, axis=1)
    return x / np.maximum(lengths, 1e-300)[:, None], lengths


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))


def clustered(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, clusters: int = CLUSTERS, rounds: int = 8) -> Anchors:
    """The group's anchors by cluster of direction; the radius is the largest angle to the centre."""
    unit, lengths = _unit(vectors)
    clusters = max(1, min(clusters, len(ids) // 8))
    centres = unit[np.linspace(0, len(ids) - 1, clusters).astype(int)].copy()
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(1)
        for c in range(clusters):
            total = unit[nearest == c].sum(0)
            if np.linalg.norm(total) > 1e-9:
                centres[c] = total / np.linalg.norm(total)
    nearest = (unit @ centres.T).argmax(1)
    order = np.argsort(nearest, kind="stable")
    starts = np.searchsorted(nearest[order], np.arange(clusters + 1))
    radius = np.array([_angles(unit[nearest == c], centres[c:c + 1]).max(initial=0.0) for c in range(clusters)])
    return Anchors(ids[order], labels[order], vectors[order], lengths[order], centres, radius, starts)


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; 64-bit integers where doubles would round."""
    return a @ b.T if exact else a.astype(np.int64) @ b.astype(np.int64).T


def _kth_largest(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf where a row has fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def walked(
    group: Anchors, first: int, end: int, bounds: np.ndarray, order: np.ndarray, ids: np.ndarray, labels: np.ndarray,
    vectors: np.ndarray, same: bool, lows: np.ndarray, highs: np.ndarray, k: int, exact: bool, longest: float,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, question, id, score) of what anchors ``first`` to ``end`` find in one sorted list.

    An anchor asks ``lows.shape[1]`` questions: the k best rows with a score from
    low to high.  Lows rise as rows are found; an anchor leaves the walk when the
    next bound lies below all of its lows.  Nothing that belongs to an answer is
    lost; what is found may be more than k rows.  The slack covers the rounding of angles.
    """
    active = np.arange(first, end)
    best = np.full((end - first, lows.shape[1], k), -np.inf)
    lows = lows[first:end].copy()
    slack = 1e-7 * longest
    for at in range(0, len(order), STEP):
        reach = group.lengths[active] * (bounds[order[at]] + slack) + 1e-6
        active = active[reach >= lows[active - first].min(1)]
        if not len(active):
            break
        some = order[at:at + STEP]
        scores = _products(group.vectors[active], vectors[some], exact).astype(np.float64 if exact else np.int64)
        fits = (group.labels[active][:, None] == labels[some][None, :]) == same
        fits &= group.ids[active][:, None] != ids[some][None, :]
        for q in range(lows.shape[1]):
            low = lows[active - first, q]
            inside = fits & (scores >= low[:, None]) & (scores <= highs[active, q][:, None])
            if not inside.any():
                continue
            # The k best so far raise the low; rows equal to it stay, as smaller ids may follow.
            both = np.concatenate((best[active - first, q], np.where(inside, scores, -np.inf)), axis=1)
            kth = _kth_largest(both, k)
            best[active - first, q] = -np.partition(-both, k - 1, axis=1)[:, :k]
            lows[active - first, q] = np.maximum(low, kth)
            row, column = np.nonzero(inside & (scores >= lows[active - first, q][:, None]))
            yield active[row], np.full(len(row), q), ids[some[column]], scores[row, column].astype(np.int64)


def _best_of(found: list, k: int) -> pd.DataFrame:
    """The k best rows of each (anchor, question): higher scores, then smaller ids."""
    if not found:
        return pd.DataFrame({"anchor": [], "question": [], "id": [], "score": []}, dtype=np.int64)
    anchor, question, ids, scores = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids, -scores, question, anchor))
    out = pd.DataFrame({"anchor": anchor[order], "question": question[order], "id": ids[order], "score": scores[order]})
    return out[out.groupby(["anchor", "question"]).cumcount() < k]


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of at most SHARD rows and one batch."""
    held: list = []

    def out():
        return tuple(np.concatenate(c) for c in zip(*held))

    for batch in batches:
        held.append((
            batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False),
            np.floor(SCALE * matrix(batch.column("_vector"), length)),
        ))
        if sum(len(h[0]) for h in held) >= SHARD:
            yield out()
            held = []
    if held:
        yield out()


def _searched(shared, length: int, same: bool, k: int):
    """Rows of every shard that may be among the k best of a question, at most k per question and shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lows, highs = shared.value
        for ids, labels, vectors in _shards(batches, length):
            unit, lengths = _unit(vectors)
            angles = _angles(unit, group.centres)
            exact = bool(group.lengths.max() * lengths.max() < EXACT)
            found: list = []
            for c in range(len(group.centres)):
                bounds = lengths * np.cos(np.maximum(angles[:, c] - group.radius[c], 0.0))
                order = np.argsort(-bounds, kind="stable")
                found += walked(group, group.starts[c], group.starts[c + 1], bounds, order, ids, labels, vectors, same, lows, highs, k, exact, lengths.max())
            best = _best_of(found, k)
            yield pa.RecordBatch.from_pydict({
                "anchor_id": pa.array(group.ids[best["anchor"].to_numpy()], pa.int64()), "positive": pa.array(best["question"], pa.int32()),
                "id": pa.array(best["id"], pa.int64()), "score": pa.array(best["score"], pa.int64()),
            })

    return run


def _answers(rows: DataFrame, length: int, group: Anchors, lows, highs, same: bool, k: int) -> DataFrame:
    """The k best rows of all candidates for each question of the group, with their rank."""
    shared = rows.sparkSession.sparkContext.broadcast((group, lows, highs))
    found = rows.mapInArrow(_searched(shared, length, same, k), FOUND)
    return top_rows(found, ["anchor_id", "positive"], [F.desc("score"), F.asc("id")], k=k, rank="rank")


def _per_question(group: Anchors, answers: pd.DataFrame, rank: int, otherwise: np.ndarray) -> np.ndarray:
    """Score of the answer of that rank to each question."""
    out = otherwise.copy()
    at = answers[answers["rank"] == rank]
    place = pd.Series(np.arange(len(group.ids)), index=group.ids)
    out[place[at["anchor_id"]].to_numpy(), at["positive"].to_numpy()] = at["score"]
    return out


def _with_floors(rows, seed, length: int, group: Anchors, lows, highs, same: bool, k: int) -> DataFrame:
    """As ``_answers``; lows are first raised to what a bounded sample of the candidates reaches."""
    if seed is not None:
        lows = np.maximum(lows, _per_question(group, _answers(seed, length, group, lows, highs, same, k).toPandas(), k, lows))
    return _answers(rows, length, group, lows, highs, same, k)


def _group_negatives(rows: DataFrame, seed: DataFrame | None, length: int, anchors: pd.DataFrame) -> DataFrame:
    vectors = np.floor(SCALE * np.array(anchors["_vector"].tolist(), dtype=np.float64))
    group = clustered(anchors["vec_id"].to_numpy(dtype=np.int64), anchors["label"].to_numpy(dtype=np.int64), vectors)
    size, inf = len(group.ids), np.inf
    positives = settled(_with_floors(
        rows, seed, length, group, np.full((size, 1), -inf), np.full((size, 1), inf), True, POSITIVES
    ).withColumn("positive", F.col("rank") - 1), "positives")
    told = positives.toPandas()  # at most POSITIVES rows per anchor of the group
    scores = np.full((size, POSITIVES), np.nan)
    for rank in range(1, POSITIVES + 1):
        scores[:, rank - 1:rank] = _per_question(group, told.assign(positive=0), rank, scores[:, rank - 1:rank])
    # Lows are rounded down, the condition is applied below; a missing positive asks for nothing.
    lows = np.where(np.isnan(scores), inf, np.floor(LEAST_SHARE * scores / 100))
    highs = np.where(np.isnan(scores), -inf, scores)
    negatives = _with_floors(rows, seed, length, group, lows, highs, False, NEGATIVES)
    negatives = negatives.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    named = positives.select("anchor_id", "positive", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(negatives, ["anchor_id", "positive"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    ).where(F.col("negative_score") * 100 >= F.col("positive_score") * LEAST_SHARE)


def _taking_part(vectors: DataFrame, column: str) -> DataFrame:
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col(column).alias("_vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole_entries("_vector", SCALE, 2.0**52))
    # Only ids that repeat are moved.
    several = rows.groupBy(F.col("vec_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    several = settled(several, "repeated-vectors")
    if several.isEmpty():
        return rows
    same = F.col("vec_id") == F.col("_id")
    firsts = top_rows(rows.join(several, same, "left_semi"), ["vec_id"], [F.asc("label"), F.asc("_vector")])
    return rows.join(several, same, "left_anti").unionByName(firsts)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, column: str = "embedding", anchors_at_once: int = ANCHORS_AT_ONCE, seed_rows: int = SEED_ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, label, vector).

    Scores are inner products of the vectors' entries times SCALE, rounded down.
    An anchor's positives are its POSITIVES best other rows of its label; each
    gets the NEGATIVES best rows of other labels with at least LEAST_SHARE
    hundredths of the positive's score and at most that score.  Ties go to the smaller vec_id.

    Rows without vec_id or label, with a null or empty vector, with an entry that
    is null, NaN, infinite or beyond 2^52 when scaled, or with another length
    than most vectors take no part.  A vec_id that repeats counts once, by its
    smallest label and vector.  Without anchors, positives or negatives there are no
    rows; other columns are ignored.  Scores beyond 2^53 are compared as doubles.
    """
    spark = vectors.sparkSession
    rows, length = of_one_length(_taking_part(vectors, column), "_vector")
    out = spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    if not length:
        return out
    rows = settled(rows.withColumn("_anchor", is_anchor), "candidates")
    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("_anchor")).first()
    groups = max(1, -(-n_anchors // (anchors_at_once * 9 // 10)))  # a tenth of room for uneven hashes
    seed = None
    if n_rows > 2 * seed_rows:
        cut = int(2**32 * (seed_rows / n_rows))
        seed = settled(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(2**32)) < cut), "seed")
    dealt = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(groups))
    for g in range(groups):
        anchors = rows.where(F.col("_anchor") & (dealt == g)).select("vec_id", "label", "_vector").toPandas()
        if len(anchors):
            anchors = anchors.sort_values("vec_id")
            out = out.unionByName(settled(_group_negatives(rows, seed, length, anchors), "negatives"))
    return out


OP12_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


def op12_shared_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; labels of every seventh are wrong on purpose."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)
