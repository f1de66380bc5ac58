"""Near duplicates by a Chosen-Path similarity join.

Every set of word shingles gets minwise tokens.  A tree starts with one token
per set as its node; a node with too many members lets every member follow two
of its own tokens, chosen by the node alone, so sets meet again with a chance
that rises with their similarity.  Small nodes are compared exhaustively, by a
256-bit sketch, and candidates confirmed on the full sets.  Independent trees
are repeated until the stated recall at the threshold is reached.

Groups of any size stay linear: equal sets are one class before anything else;
in the first round each node only offers its members to its pivot, and members
that end up in one component are not compared with each other again.  Nodes
that will not shrink are compared in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, settled, spread_join, table
from .components import components
from .decontamination import shingle_sql
from .shingles import minwise, shingle_sets

TOKENS = 20
SKETCH_BITS = 256
#: Members of a node that are compared exhaustively.
NODE_MEMBERS = 1024
#: Levels of branching; nodes that are still large are compared in blocks.
LEVELS = 6
#: Chance to miss a pair at the threshold, by the trees and by the sketch.
MISSED = 1e-7
BROADCAST_IDS = 1_000_000
#: Stand-in ids for rows without doc_id begin here.
NO_ID = 1 << 62
#: Candidate pairs per member above which a node's candidates are confirmed together.
PAIRS_A_MEMBER, NO_MEMBER = 4, -(1 << 63)


def trees_for(similarity: float, missed: float = MISSED) -> int:
    """Trees that find a pair of ``similarity`` with all but a chance of ``missed``.

    A pair shares a tree's first node with chance J.  Of two tokens per level at
    least one is shared, at any depth, with chance s = (2 J - 1) / J^2, the fixed
    point of s = 1 - (1 - J s)^2 (above a half).
    """
    survives = similarity * (2 * similarity - 1) / similarity**2
    return math.ceil(math.log(missed) / math.log(1 - survives))


def most_differing_bits(similarity: float) -> int:
    """Differing sketch bits of a pair at the threshold: mean plus 5.5 standard deviations."""
    p = (1 - similarity) / 2
    return math.ceil(SKETCH_BITS * p + 5.5 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def _own_id() -> Column:
    stand_in = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    return F.coalesce("doc_id", stand_in)


def _signatures(trees: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                rows = whole.iloc[at:at + 500]
                sets = shingle_sets(rows["text"])
                full = [s for s in sets if len(s)]
                out = rows[["_id", "doc_id"]].copy()
                out["n"] = [len(s) for s in sets]
                out["digest"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                out["roots"], out["tokens"], words = None, None, np.zeros((len(sets), 4), dtype=np.int64)
                if full:
                    has = np.array([len(s) > 0 for s in sets])
                    least = minwise(full, trees + TOKENS + SKETCH_BITS)
                    bits = (least[:, trees + TOKENS:] * np.uint32(0x9E3779B1)) >> np.uint32(31)
                    words[has] = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
                    kept = least[:, :trees + TOKENS].view(np.int32)
                    roots, tokens = np.empty(len(sets), dtype=object), np.empty(len(sets), dtype=object)
                    for i, row in zip(np.nonzero(has)[0], kept.tolist()):
                        roots[i], tokens[i] = row[:trees], row[trees:]
                    out["roots"], out["tokens"] = roots, tokens
                for w in range(4):
                    out[f"s{w}"] = words[:, w]
                yield out

    return run


_SIGNED = ("_id long, doc_id long, n long, digest binary, roots array<int>, tokens array<int>, "
           "s0 long, s1 long, s2 long, s3 long")
_SKETCH = ["s0", "s1", "s2", "s3"]


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for at in range(0, len(whole), 500):
            rows = whole.iloc[at:at + 500]
            yield pd.DataFrame({"_id": rows["_id"], "shingles": [s.tobytes() for s in shingle_sets(rows["text"])]})


def _confirmed(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            good = []
            for x, y in zip(rows["set_a"], rows["set_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                place = np.searchsorted(y, x)
                shared = int((y[np.minimum(place, len(y) - 1)] == x).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield rows.loc[good, ["a", "b"]]

    return run


def _cluster_links(percent: int):
    """Links that join each cluster's similar members, by exact counts of shared shingles; rows come sorted by cluster."""
    def links_of(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        ids, first = np.unique(ids, return_index=True)
        sets = [sets[i] for i in first]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(np.concatenate(sets), kind="stable")
        flat, owner = np.concatenate(sets)[order], owner[order]
        starts = np.concatenate(([0], np.nonzero(flat[1:] != flat[:-1])[0] + 1, [len(flat)]))
        shared = np.zeros((len(sets), len(sets)), dtype=np.int32)
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s > 1:
                shared[np.ix_(owner[s:e], owner[s:e])] += 1
        linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
        # One link to reach each member from its component's first is enough.
        found, left = [], np.ones(len(sets), dtype=bool)
        for root in range(len(sets)):
            if left[root]:
                left[root], front = False, [root]
                while front:
                    i = front.pop()
                    near = np.nonzero(linked[i] & left)[0]
                    left[near] = False
                    front += near.tolist()
                    found += [(int(ids[i]), int(ids[j])) for j in near]
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, ids, sets = None, [], []
        for rows in batches:
            links = []
            for cluster, own, data in zip(rows["cluster"], rows["_id"], rows["shingles"]):
                if cluster != here:
                    links += links_of(np.array(ids), sets) if ids else []
                    here, ids, sets = cluster, [], []
                ids.append(own)
                sets.append(np.frombuffer(data, np.uint64))
            yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)
        if ids:
            yield pd.DataFrame(links_of(np.array(ids), sets), columns=["a", "b"], dtype=np.int64)

    return run


def _confirm(docs: DataFrame, pairs: DataFrame, percent: int, purpose: str, clusters: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, and links inside the clusters (cluster, _id)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_id"))
    ids = (ids if clusters is None else ids.unionByName(clusters.select("_id"))).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids, "_id", "left_semi").dropDuplicates(["_id", "_text"]).select("_id", "text")
    sets = settled(texts.mapInPandas(lean(_full_sets), "_id long, shingles binary"), f"{purpose}-sets")
    both = pairs.join(sets.select(F.col("_id").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("_id").alias("b"), F.col("shingles").alias("set_b")), "b"
    )
    links = both.mapInPandas(_confirmed(percent), "a long, b long")
    if clusters is not None:
        dealt = clusters.join(sets, "_id").repartition("cluster").sortWithinPartitions("cluster", "_id")
        links = links.unionByName(dealt.mapInPandas(_cluster_links(percent), "a long, b long"))
    return settled(links.distinct(), f"{purpose}-links")


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _node_pairs(percent: int, differing: int):
    """Candidates across labels inside each node; rows come sorted by node.

    A node with few candidate pairs gives the pairs; one with many gives the
    members that have any, as a cluster (with NO_MEMBER for ``b``), so that what
    leaves a node stays in proportion to its members.
    """
    def pairs_of(ids, labels, sizes, sketch):
        differ = np.zeros((len(ids), len(ids)), dtype=np.uint16)
        for w in range(4):
            differ += np.bitwise_count(sketch[:, None, w] ^ sketch[None, :, w])
        ok = np.triu(differ <= differing, 1) & (labels[:, None] != labels[None, :])
        i, j = np.nonzero(ok)
        fits = 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])
        i, j = i[fits & (ids[i] != ids[j])], j[fits & (ids[i] != ids[j])]
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rows["node"].iloc[-1] if len(rows) else None
            open_ = rows["node"] == last
            rest, rows = rows[open_], rows[~open_]
            yield found(rows)
        if rest is not None:
            yield found(rest)

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, cluster = [], [], []
        if len(rows):
            node = rows["node"].to_numpy()
            starts = np.concatenate(([0], np.nonzero(node[1:] != node[:-1])[0] + 1, [len(node)]))
            ids, labels, sizes = (rows[c].to_numpy() for c in ("_id", "label", "n"))
            sketch = rows[_SKETCH].to_numpy().view(np.uint64)
            for s, e in zip(starts[:-1], starts[1:]):
                if e - s > 1:
                    x, y = pairs_of(ids[s:e], labels[s:e], sizes[s:e], sketch[s:e])
                    crowd = np.unique(np.concatenate((x, y)))
                    if len(x) > PAIRS_A_MEMBER * len(crowd):
                        x, y, own = crowd, np.full(len(crowd), NO_MEMBER), np.full(len(crowd), node[s])
                    else:
                        own = np.zeros(len(x), dtype=np.int64)
                    a.append(x)
                    b.append(y)
                    cluster.append(own)
        none = np.empty(0, dtype=np.int64)
        whole = [np.concatenate([none, *part]) for part in (a, b, cluster)]
        return pd.DataFrame(dict(zip(("a", "b", "cluster"), whole)))

    return run


_MEMBER = ["node", "_id", "n", "label", *_SKETCH]


def _compare_nodes(rows: DataFrame, percent: int, differing: int) -> DataFrame:
    dealt = rows.select(*_MEMBER).repartition("node").sortWithinPartitions("node")
    return dealt.mapInPandas(lean(_node_pairs(percent, differing)), "a long, b long, cluster long")


def _sized(rows: DataFrame) -> DataFrame:
    """Members of nodes that span several labels, with the node's members and those outside its main label."""
    per_label = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("_k"))
    nodes = per_label.groupBy("node").agg(F.sum("_k").alias("m"), F.max(F.struct("_k", "label")).alias("_main")).where("m > _main._k")
    nodes = nodes.select("node", "m", (F.col("m") - F.col("_main._k")).alias("others"), F.col("_main.label").alias("main"))
    return spread_join(rows, nodes, ["node"], ["_id"], "inner")


def similar_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Component of every row of (doc_id, text) under Jaccard similarity >= percent / 100.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable over
    links), kept.  Sets are distinct 5-word shingles of the lower-cased (A-Z)
    text, the whole sequence if it is shorter; null and empty texts have none
    and stand alone.  Rows that repeat a doc_id count as one document, linked to
    what any of its texts is linked to.  Rows without doc_id take part, never
    name a component (component_id is null if it has no doc_id at all) and are
    kept only then.  An empty table gives no rows; other columns are ignored.
    """
    similarity = percent / 100
    trees, differing = trees_for(similarity), most_differing_bits(similarity)
    docs = docs.select(_own_id().alias("_id"), "doc_id", "text")
    rows = settled(docs.mapInPandas(lean(_signatures(trees)), _SIGNED), "signatures")
    classes = rows.where("n > 0").groupBy("digest").agg(
        F.min("_id").alias("_id"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("roots", "tokens", *_SKETCH)]
    )
    classes = settled(classes, "classes")
    texts = docs.withColumn("_text", F.xxhash64("text"))

    # First round: a node offers each member to its pivot.
    roots = classes.select("_id", "n", *_SKETCH, F.posexplode("roots").alias("_tree", "_token"))
    roots = roots.select(F.xxhash64("_tree", "_token").alias("node"), "_id", "n", *_SKETCH)
    pivots = roots.groupBy("node").agg(
        F.count(F.lit(1)).alias("_m"), F.min(F.struct("_id", "n", *_SKETCH)).alias("_pivot")
    ).where("_m > 1").drop("_m")
    members = settled(spread_join(roots, pivots, ["node"], ["_id"], "inner"), "members")
    bits = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"_pivot.{s}"))) for s in _SKETCH), F.lit(0))
    star = members.where((F.col("_id") > F.col("_pivot._id")) & (bits <= differing) & _alike(F.col("n"), F.col("_pivot.n"), percent))
    star = settled(star.select(F.col("_pivot._id").alias("a"), F.col("_id").alias("b")).distinct(), "star-pairs")
    labels = settled(components(_confirm(texts, star, percent, "star")), "labels")

    # Then all pairs inside small nodes, except those already joined or tried.
    level = members.select("node", "_id", "n", *_SKETCH).join(labels.withColumnRenamed("id", "_id"), "_id", "left")
    level = level.withColumn("label", F.coalesce("label", "_id")).select(*_MEMBER)
    candidates = []
    for depth in range(LEVELS + 1):
        sized = settled(_sized(level), "nodes")
        small, large = sized.where(F.col("m") <= NODE_MEMBERS), sized.where(F.col("m") > NODE_MEMBERS)
        pieces = F.ceil(F.col("m") / NODE_MEMBERS).cast("int")
        own = F.pmod(F.xxhash64("_id"), pieces).cast("int")
        every = F.sequence(F.lit(0), pieces - 1)
        # Few outside the main label: they meet the main label in blocks.
        lopsided = large.where(F.col("others") <= NODE_MEMBERS).withColumn(
            "_block", F.explode(F.when(F.col("label") == F.col("main"), F.array(own)).otherwise(every))
        ).withColumn("node", F.xxhash64("node", "_block"))
        ready = small.select(*_MEMBER).unionByName(lopsided.select(*_MEMBER))
        stubborn = large.where(F.col("others") > NODE_MEMBERS)
        more = not stubborn.isEmpty()
        if more and depth == LEVELS:
            blocks = stubborn.withColumn("_own", own).withColumn("_block", F.explode(every))
            blocks = blocks.withColumn("node", F.xxhash64("node", F.least("_own", "_block"), F.greatest("_own", "_block")))
            ready, more = ready.unionByName(blocks.select(*_MEMBER)), False
        candidates.append(_compare_nodes(ready, percent, differing))
        if not more:
            break
        first = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(TOKENS)).cast("int")
        second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(1)), F.lit(TOKENS - 1)).cast("int"), F.lit(TOKENS))
        level = (
            stubborn.select(*_MEMBER).join(classes.select("_id", "tokens"), "_id")
            .withColumn("_at", F.explode(F.array(first, second)))
            .withColumn("node", F.xxhash64("node", "_at", F.get("tokens", F.col("_at")))).select(*_MEMBER)
        )
    pairs = candidates[0]
    for more_pairs in candidates[1:]:
        pairs = pairs.unionByName(more_pairs)
    found = settled(pairs.distinct(), "node-candidates")
    pairs = found.where(F.col("b") != NO_MEMBER).select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    clusters = found.where(F.col("b") == NO_MEMBER).select("cluster", F.col("a").alias("_id"))
    links = _confirm(texts, pairs, percent, "node", clusters)

    all_links = labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(links)
    final = components(all_links)
    named = classes.select("digest", "_id").join(final.withColumnRenamed("id", "_id"), "_id", "left").select(
        "digest", F.coalesce("label", "_id").alias("_label")
    )
    named = named.groupBy("digest").agg(F.min("_label").alias("_label"))
    out = spread_join(rows.select("_id", "doc_id", "n", "digest"), named, ["digest"], ["_id"])
    label = F.coalesce("_label", "_id")
    component = F.when(label < NO_ID, label)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 85 %."""
    return similar_groups(table(spark, sf_dir, "documents"), 85)


OP2_SQL = f"""
WITH RECURSIVE s AS ({shingle_sql('documents', 'doc_id')}),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
          FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
          WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""
