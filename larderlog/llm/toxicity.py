"""Toxicity by weak supervision.

Many weak voters (groups of mined terms, a small insult lexicon, patterns) vote
on every document.  A generative label model, in which each voter depends on the
hidden label and on one other voter, estimates their accuracies and
correlations by EM over the vote patterns of all documents; documents with a
training label keep it.  Terms are mined from distinct labelled texts; every term with
enough support and significance is dealt to a voter.  A linear classifier learns the model's posterior from a
bounded sample and gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows, lean, settled, table, text_key, text_of

#: Bounds: distinct labelled texts that terms are mined from, documents that the linear classifier is fitted on.
LABELLED_TEXTS, FITTED_ROWS = 200_000, 20_000
#: Voters that terms are dealt to, and the least toxic texts and share of them a term needs.
TERM_VOTERS, LEAST_DOCS, LEAST_SHARE = 8, 3, 0.6
#: Least log-likelihood ratio of a term against the share of toxic texts (chi-squared of one degree, 0.1 %).
SIGNIFICANT = 10.83
PREFIXES = (4, 6)
#: Terms a task counts before it hands them on, and documents it judges at a time.
HELD_TERMS, ROWS_AT_ONCE = 100_000, 500
THRESHOLD = 0.3

#: Insults of everyday English.
INSULTS = frozenset("idiot moron stupid loser pathetic scum worthless trash clown disgusting dumb jerk".split())
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b\w[*@#$%]{2,}\w*\b")
VOTERS = TERM_VOTERS + 4


def held_out() -> Column:
    """Rows whose labels are never learned from; a null doc_id is not held out."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def terms_of(text: str) -> set[str]:
    """Distinct lower-cased words, and their beginnings with a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per term and label, summed up within the task; HELD_TERMS are handed on."""
    seen = {0: Counter(), 1: Counter()}

    def out() -> pd.DataFrame:
        terms = list(seen[0].keys() | seen[1].keys())
        return pd.DataFrame({"term": terms, "clean": [seen[0][t] for t in terms], "toxic": [seen[1][t] for t in terms]})

    for rows in batches:
        for text, toxic in zip(rows["text"], rows["toxic"]):
            seen[int(toxic)].update(terms_of(text or ""))
            seen[int(toxic)][""] += 1
            if len(seen[0]) + len(seen[1]) >= HELD_TERMS:
                yield out()
                seen = {0: Counter(), 1: Counter()}
    yield out()


def distinct_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): each labelled text once, at most LABELLED_TEXTS; of copies the largest label counts."""
    sha = text_key()
    named = docs.select("doc_id", sha.alias("_sha")).join(labels, "doc_id")
    chosen = named.groupBy("_sha").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    # At most LABELLED_TEXTS rows of 44 bytes are broadcast.
    chosen = chosen.orderBy("_sha").limit(LABELLED_TEXTS)
    texts = docs.select("doc_id", text_of().alias("text"), sha.alias("_sha"))
    return texts.join(F.broadcast(chosen), ["doc_id", "_sha"]).groupBy("_sha").agg(
        F.first("text").alias("text"), F.first("toxic").alias("toxic")
    ).select("text", "toxic")


def mine_terms(labelled: DataFrame) -> list[str]:
    """All terms of (text, toxic) that mark toxic documents with enough support and significance, the best first."""
    counts = labelled.select("text", "toxic").mapInPandas(lean(_term_counts), "term string, clean long, toxic long")
    counts = settled(counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "term-counts")
    every = counts.where("term = ''").first()
    if every is None or not every["clean"] or not every["toxic"]:
        base = 0.5
    else:
        base = every["toxic"] / (every["toxic"] + every["clean"])
    n = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / n
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), base) + part(F.col("clean"), 1 - base))
    good = counts.where((F.col("term") != "") & (F.col("toxic") >= LEAST_DOCS) & (share >= LEAST_SHARE) & (share > base) & (ratio >= SIGNIFICANT))
    weight = F.col("toxic") * F.log((F.col("toxic") + 1) / (F.col("clean") + 1))
    return [r["term"] for r in good.orderBy(weight.desc(), "term").collect()]


def _observed(terms: list[str]):
    """votes (a bit per voter) and the mined terms of every text."""
    place = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in few_rows(batches, ROWS_AT_ONCE):
            votes, found = [], []
            for text in rows["text"]:
                text = text or ""
                own = terms_of(text)
                hits = sorted(place[t] for t in own & place.keys())
                v = 0
                for h in hits:
                    v |= 1 << (h % TERM_VOTERS)
                v |= bool(own & INSULTS) << TERM_VOTERS
                v |= (len(hits) >= 4) << (TERM_VOTERS + 1)
                v |= bool(_MASKED.search(text)) << (TERM_VOTERS + 2)
                v |= (text.count("!") >= 3) << (TERM_VOTERS + 3)
                votes.append(v)
                found.append(hits)
            out = rows[["doc_id", "held_out", "text_sha"]].copy()
            out["votes"], out["hits"] = votes, found
            yield out

    return run


class LabelModel:
    """P(label) and P(vote | label, parent vote); parents form a tree of strongest dependence."""

    def __init__(self, voters: int = VOTERS):
        self.voters, self.parent = voters, [-1] * voters
        self.prior = 0.1
        self.table = np.zeros((voters, 2, 2))  # [voter, label, parent vote] -> P(vote = 1)

    def _bits(self, patterns: np.ndarray) -> np.ndarray:
        return (patterns[:, None] >> np.arange(self.voters)) & 1

    def _tree(self, bits, weight, q) -> None:
        """Parents by maximal mutual information given the label (zero-weight links are left out)."""
        info = np.zeros((self.voters, self.voters))
        for y in (q, 1 - q):
            w = weight * y
            total = max(w.sum(), 1e-9)
            one = (bits * w[:, None]).sum(0) / total
            both = (bits.T * w) @ bits / total
            for i in range(self.voters):
                for j in range(i):
                    p11 = both[i, j]
                    cells = [(p11, one[i] * one[j]), (one[i] - p11, one[i] * (1 - one[j])),
                             (one[j] - p11, (1 - one[i]) * one[j]), (1 - one[i] - one[j] + p11, (1 - one[i]) * (1 - one[j]))]
                    info[i, j] += total * sum(p * math.log(p / e) for p, e in cells if p > 1e-12 and e > 1e-12)
        info += info.T
        joined, self.parent = {0}, [-1] * self.voters
        while len(joined) < self.voters:
            i, j = max(((i, j) for i in range(self.voters) if i not in joined for j in joined), key=lambda p: info[p])
            self.parent[i] = j if info[i, j] > 1e-6 else -1
            joined.add(i)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(label = 1 | votes) of each pattern."""
        bits = self._bits(np.asarray(patterns))
        log = np.zeros((len(bits), 2))
        for y, p in ((0, 1 - self.prior), (1, self.prior)):
            log[:, y] = math.log(p)
            for v in range(self.voters):
                at = self.table[v, y, bits[:, self.parent[v]] if self.parent[v] >= 0 else 0]
                log[:, y] += np.log(np.where(bits[:, v] == 1, at, 1 - at))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))

    def fit(self, patterns, counts, labels, steps: int = 25) -> LabelModel:
        """EM over patterns with counts; ``labels`` 0 or 1 are kept, -1 is hidden."""
        patterns, weight, labels = np.asarray(patterns), np.asarray(counts, dtype=float), np.asarray(labels)
        if not len(patterns):
            return self
        bits, known = self._bits(patterns), labels >= 0
        # Start: a labelled row says its label, any other what a majority of voters suggests.
        q = np.where(known, labels, np.where(bits.sum(1) >= 2, 0.9, 0.03)).astype(float)
        for _ in range(steps):
            self._tree(bits, weight, q)
            self.prior = float(np.clip((weight * q).sum() / weight.sum(), 1e-4, 0.5))
            for y, mass in ((0, weight * (1 - q)), (1, weight * q)):
                for v in range(self.voters):
                    above = bits[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(bits), dtype=int)
                    alone = (mass * bits[:, v]).sum() / max(mass.sum(), 1e-9)
                    for u in (0, 1):
                        m = mass * (above == u)
                        self.table[v, y, u] = np.clip(((m * bits[:, v]).sum() + 2 * alone + 1e-3) / (m.sum() + 2 + 2e-3), 1e-4, 1 - 1e-4)
            q = np.where(known, labels, self.posterior(patterns))
        return self


def _design(votes: np.ndarray, hits, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the linear classifier as (row, column, value): terms, voters, number of terms."""
    every, none = np.arange(len(votes)), np.empty(0, dtype=np.int64)
    size = np.array([len(h) for h in hits], dtype=np.int64)
    voted, voter = np.nonzero((votes[:, None] >> np.arange(VOTERS)) & 1)
    row = np.concatenate((np.repeat(every, size), voted, every))
    column = np.concatenate([none, *hits, voter + terms, np.full(len(votes), terms + VOTERS)]).astype(np.int64)
    value = np.concatenate((np.ones(size.sum() + len(voted)), np.minimum(size, 8)))
    return row, column, value


def _dot(x, w: np.ndarray, rows: int) -> np.ndarray:
    row, column, value = x
    return np.bincount(row, weights=value * w[column], minlength=rows)


def fit_linear(x, columns: int, q: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    w, b = np.zeros(columns), math.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3)) if len(q) else -3.0
    if not len(q):
        return w, b
    row, column, value = x
    rate = 4 / (np.bincount(row, weights=np.square(value)).max() + 1)
    vw, vb = w.copy(), b
    for k in range(steps):
        err = 1 / (1 + np.exp(-np.clip(_dot(x, vw, len(q)) + vb, -40, 40))) - q
        slope = np.bincount(column, weights=value * err[row], minlength=columns)
        nw, nb = vw - rate * (slope / len(q) + ridge * vw), vb - rate * err.mean()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``toxicity_of_texts`` without the text's hash."""
    return toxicity_of_texts(docs, labels).drop("text_sha")


def toxicity_of_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, votes, text_sha (SHA-256) of every row of (doc_id, text).

    ``labels``: (doc_id, toxic); the largest label of a doc_id counts, null ones
    don't.  Labels of held-out rows are never read into the model; without any
    label the fixed lexicon and patterns alone inform it.  Null and empty texts
    get the score of a text without votes; repeated rows are scored alike; an
    empty table gives no rows; other columns are ignored.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    usable = usable.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    terms = mine_terms(distinct_texts(docs, usable))

    seen = docs.select("doc_id", held_out().alias("held_out"), text_key().alias("text_sha"), "text")
    schema = "doc_id long, held_out boolean, text_sha binary, votes int, hits array<int>"
    seen = settled(seen.mapInPandas(lean(_observed(terms)), schema), "votes")
    marked = seen.join(usable, "doc_id", "left").withColumn("label", F.when(~F.col("held_out"), F.col("toxic")))
    patterns = marked.groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 * 2 ** VOTERS rows
    model = LabelModel().fit([r["votes"] for r in patterns], [r["n"] for r in patterns],
                             [-1 if r["label"] is None else r["label"] for r in patterns])

    fitted = marked.where(~F.col("held_out")).orderBy(F.xxhash64("doc_id", "votes")).limit(FITTED_ROWS).select("votes", "hits", "label").toPandas()
    votes = fitted["votes"].to_numpy(dtype=np.int64)
    target = model.posterior(votes) if len(votes) else np.zeros(0)
    known = fitted["label"].notna().to_numpy()
    target[known] = fitted["label"][known].to_numpy(dtype=float)
    w, b = fit_linear(_design(votes, fitted["hits"], len(terms)), len(terms) + VOTERS + 1, target)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = _design(rows["votes"].to_numpy(dtype=np.int64), rows["hits"], len(terms))
            out = rows[["doc_id", "held_out", "votes", "text_sha"]].copy()
            out["score"] = 1 / (1 + np.exp(-np.clip(_dot(x, w, len(rows)) + b, -40, 40)))
            yield out

    scores = seen.mapInPandas(lean(scored), "doc_id long, held_out boolean, votes int, text_sha binary, score double")
    return scores.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "votes", "text_sha")


def op9_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
