"""Language identification by a string kernel.

The kernel of two texts is the number of letter n-grams of one to three
characters that occur in both (a blended spectrum of presences), over the root of
the product of their own numbers.  Nyström landmarks, some texts of every
language, stand for the whole kernel matrix; one-versus-rest ridge regression
gives a weight per landmark and language.  Its normal equations are sums over the training sample,
taken by Spark.

A text's kernel with all landmarks is its row of n-gram presences times the
landmarks' matrix of presences; as that is then multiplied by the weights, both
matrices are multiplied once beforehand, and a batch of texts is scored by one
product of its presences with a table of n-grams by languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_rows, settled, table, text_key

#: n-grams have one to three characters: three code points of 21 bits are an exact key of 64 bits.
LONGEST, BITS = 3, 21
#: Bounds of the fit: distinct labelled texts and landmarks of all languages together.
SAMPLE, LANDMARKS = 12_000, 240
RIDGE = 1e-3
#: Sharpness of the score: margins of the regression, between -1 and 1, become shares.
SHARPNESS = 6.0
#: Characters of a text that are turned into n-grams at a time, and texts that a task holds at once.
PIECE, TEXTS_AT_ONCE = 1_000_000, 200
#: Cells of a block of presences (texts by known n-grams).
CELLS = 2_000_000
UNKNOWN = "und"


def held_out() -> Column:
    """Rows that are never learned from; a null doc_id is not held out."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class _Table:
    """The table of letters, built once per Python worker."""

    letters: np.ndarray | None = None


def _spelled(text: str) -> np.ndarray:
    """Code points of the lower-cased text; a run of anything but letters is one space."""
    if _Table.letters is None:
        _Table.letters = _letters()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _Table.letters[points]
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1]
    return points[keep]


def ngrams_of(text: str | None, piece: int = PIECE) -> np.ndarray:
    """Sorted keys of the distinct n-grams of a text; a space stands before and behind it. Empty without letters."""
    found = np.empty(0, dtype=np.uint64)
    text = text or ""
    before = np.array([32], dtype=np.uint32)
    some = False
    for at in range(0, len(text) + 1, piece):
        last = at + piece > len(text)
        spelled = _spelled(text[at:at + piece])
        some = some or bool((spelled != 32).any())
        points = np.concatenate((before, spelled, [np.uint32(32)] if last else np.empty(0, dtype=np.uint32)))
        # Runs of spaces may meet at the seam.
        space = points == 32
        points = points[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint64)
        keys, parts = points, [_distinct(points)]
        for n in range(2, LONGEST + 1):
            if len(points) < n:
                break
            keys = (keys[:-1] << np.uint64(BITS)) | points[n - 1:]
            parts.append(_distinct(keys))
        found = _distinct(np.concatenate((found, *parts)))
        before = points[-(LONGEST - 1):].astype(np.uint32)
    return found if some else np.empty(0, dtype=np.uint64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _matches(texts: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in ``known``) of every n-gram of the texts that is known."""
    flat = np.concatenate([np.empty(0, dtype=np.uint64), *texts])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if not len(known):
        return owner[:0], owner[:0]
    place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    hit = known[place] == flat
    return owner[hit], place[hit]


def summed(texts: list[np.ndarray], known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Product of the texts' presences with ``values`` (a row per known n-gram), over the root of their numbers of n-grams."""
    out = np.zeros((len(texts), values.shape[1]))
    at_once = max(1, CELLS // max(len(known), 1))
    for at in range(0, len(texts), at_once):
        some = texts[at:at + at_once]
        present = np.zeros((len(some), len(known)), dtype=np.float32)
        present[_matches(some, known)] = 1.0
        out[at:at + at_once] = present @ values
    return out / np.sqrt(np.maximum([len(t) for t in texts], 1))[:, None]


def landmark_table(landmarks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(known n-grams, presences over the root of the landmark's number of n-grams: a row per n-gram, a column per landmark)."""
    known = _distinct(np.concatenate([np.empty(0, dtype=np.uint64), *landmarks]))
    values = np.zeros((len(known), len(landmarks)), dtype=np.float32)
    for j, keys in enumerate(landmarks):
        values[np.searchsorted(known, keys), j] = 1 / np.sqrt(max(len(keys), 1))
    return known, values


def _sample_rows(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, _sha, _place): distinct labelled training texts by their place in hash order within the language, at most SAMPLE of all."""
    # A null doc_id is part of the training fold; a text counts once per language.
    rows = docs.where(~held_out() & F.col("lang").isNotNull()).select("lang", "doc_id", text_key().alias("_sha"))
    rows = rows.groupBy("lang", "_sha").agg(F.min("doc_id").alias("doc_id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(SAMPLE // max(len(sizes), 1), 20)
    # Few more rows than wanted pass the hash, so no task ranks a whole language.
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, 1.2 * each / n)) for k, n in sizes.items()], "_lang string, _share double")
    hashed = F.pmod(F.xxhash64("_sha"), F.lit(2**32)) / float(2**32)
    rows = rows.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(hashed < F.col("_share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("_sha"), "_sha"))
    return rows.select("lang", "doc_id", "_sha", place.alias("_place")).where(F.col("_place") <= each)


def _grams_of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in few_rows(batches, TEXTS_AT_ONCE):
        grams = [ngrams_of(t) for t in rows["text"]]
        out = rows[["lang", "_place"]].copy()
        out["grams"] = [g.view(np.int64) for g in grams]
        yield out[[len(g) > 0 for g in grams]]


def _normal_parts(known: np.ndarray, values: np.ndarray, langs: list[str]):
    """Sums of k kᵀ and k yᵀ over the task's texts: a row per landmark."""
    code = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = values.shape[1]
        total = np.zeros((m, m + len(langs)))
        for rows in few_rows(batches, TEXTS_AT_ONCE):
            k = summed([np.asarray(g, dtype=np.int64).view(np.uint64) for g in rows["grams"]], known, values)
            y = np.full((len(rows), len(langs)), -1.0)
            y[np.arange(len(rows)), [code[x] for x in rows["lang"]]] = 1.0
            total += k.T @ np.column_stack((k, y))
        yield pd.DataFrame({"landmark": np.arange(m), "row": list(total)})

    return run


class Languages:
    """Learned languages and, per known n-gram, their weights."""

    def __init__(self, langs: list[str], known: np.ndarray, weights: np.ndarray):
        self.langs, self.known, self.weights = langs, known, weights

    def judged(self, texts: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """Best language of each set of n-grams and the share it gets; UNKNOWN and 0 for an empty set."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margin = SHARPNESS * summed(texts, self.known, self.weights)
        share = np.exp(margin - margin.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        empty = np.array([not len(t) for t in texts], dtype=bool)
        names = [UNKNOWN if e else self.langs[b] for e, b in zip(empty, best)]
        return names, np.where(empty, 0.0, share[np.arange(len(texts)), best])


def fit_languages(docs: DataFrame) -> Languages:
    """Learn from (doc_id, text, lang) outside the held-out fold; without any usable row nothing is learned.

    At most SAMPLE distinct texts, the same number of each language (20 at
    least), are learned from; LANDMARKS of them, again the same number of each
    language (4 at least), are landmarks.  Languages are few: their names and
    landmarks reach the driver.
    """
    chosen = settled(_sample_rows(docs), "language-sample")
    # At most SAMPLE keys (or 20 per language) are broadcast; the texts stay where they are.
    keys = F.broadcast(chosen.select("_sha", "lang", F.col("doc_id").alias("_doc"), "_place"))
    texts = docs.where(~held_out()).select("doc_id", "text", "lang", text_key().alias("_sha"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc"))
    texts = texts.join(keys, ["_sha", "lang"]).where(same).select("lang", "_place", "text").dropDuplicates(["lang", "_place"])
    grams = settled(texts.mapInPandas(_grams_of_texts, "lang string, _place int, grams array<long>"), "language-grams")
    langs = [r["lang"] for r in grams.select("lang").distinct().orderBy("lang").collect()]
    each = max(LANDMARKS // max(len(langs), 1), 4)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_place"))
    picked = grams.withColumn("_rank", first).where(F.col("_rank") <= each).orderBy("lang", "_rank").toPandas()
    landmarks = [np.asarray(g, dtype=np.int64).view(np.uint64) for g in picked["grams"]]
    known, values = landmark_table(landmarks)
    if not langs:
        return Languages([], known, values)
    parts = grams.mapInPandas(_normal_parts(known, values, langs), "landmark int, row array<double>")
    cells = parts.select("landmark", F.posexplode("row").alias("other", "cell")).groupBy("landmark", "other").agg(F.sum("cell").alias("cell"))
    got, m = cells.toPandas(), len(landmarks)
    sums = np.zeros((m, m + len(langs)))
    sums[got["landmark"], got["other"]] = got["cell"]
    n = max(float(len(picked)), float(grams.count()))
    # Ridge in the space that the landmarks span: (KᵀK + ridge n K_mm) w = Kᵀ y.
    among = summed(landmarks, known, values)
    solved = np.linalg.lstsq(sums[:, :m] + RIDGE * n * (among + among.T) / 2 + 1e-9 * n * np.eye(m), sums[:, m:], rcond=None)[0]
    return Languages(langs, known, (values @ solved).astype(np.float32))


def _predicted(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in few_rows(batches, TEXTS_AT_ONCE):
            names, score = shared.value.judged([ngrams_of(t) for t in rows["text"]])
            yield pd.DataFrame({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": names, "score": score})

    return run


def languages_of(docs: DataFrame, fitted: Languages) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of (doc_id, text).

    Null texts and texts without a letter are ``und`` with score 0, and so is
    every text if nothing was learned; ties go to the language that sorts first.
    Very long texts are read whole, in pieces; repeated rows are judged alike; an empty
    table gives no rows; other columns are ignored.
    """
    # Known n-grams are those of the landmarks, whose number is bounded.
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInPandas(_predicted(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def op13_kernel_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, sf_dir, "documents")
    return languages_of(docs, fit_languages(docs))
