"""Cleaning a corpus: toxicity, exact and near duplicates, benchmark leaks, encoding.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; its rows are
written to the shared folder and read again as the next stage's documents.  A
document is a pair of doc_id and text: each is judged by its own text, also if
its doc_id is null or repeats with other texts.  Of equal pairs the duplicate
stages keep one row.  Null and empty texts are one text without words: not
toxic, exact duplicates of each other, near duplicates of nothing.  Texts are read whole,
however long.  An empty table stays empty.  Every other column is handed on
as it is, whatever its name.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderlog.llm.common import settled, spread_join, table, text_key
from larderlog.llm.decontamination import contaminated
from larderlog.llm.exact_dedup import exact_groups
from larderlog.llm.near_dedup import similar_groups
from larderlog.llm.sentencepieces import encode_pieces
from larderlog.llm.toxicity import toxicity_of_texts
from larderlog.session import configure

#: Keys of at most so many documents (16 to 50 MB) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
PIECE_MODEL = "piece_bpe_32k.model"
#: Segments a Python worker of the encoding remembers: it lives on beside the other stages.
REMEMBERED_SEGMENTS = 50_000
#: Bytes of texts that Python workers get at a time, in stages that run one behind the other in the same executors.
BATCH_BYTES = 2 << 20


#: Stand-in ids of rows whose doc_id does not tell them apart begin here, below those of near_dedup.
STAND_IN = 1 << 61


def _small(rows: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if it is proven small; else Spark joins it by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _packed(docs: DataFrame) -> DataFrame:
    """Each document as one struct ``kept`` beside its doc_id, text and key: no column's name can clash."""
    return docs.select(F.struct("*").alias("kept"), "doc_id", "text", text_key().alias("sha"))


def _told_apart(docs: DataFrame) -> DataFrame:
    """``_packed`` rows with ``row``: the doc_id, or a stand-in where it is null or has an earlier text too."""
    keyed = _packed(docs)
    texts = keyed.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc"))
    repeated = texts.agg(F.min("sha").alias("first"), F.max("sha").alias("last")).where("first <> last")
    repeated = settled(repeated.select("doc", "first"), "repeated-ids")
    stand_in = F.lit(STAND_IN) + F.shiftrightunsigned(F.xxhash64("doc_id", "sha"), 3)
    own = F.col("doc_id").isNotNull() & F.coalesce(F.col("first") == F.col("sha"), F.lit(True))
    if repeated.count() <= BROADCAST_IDS:
        joined = keyed.join(F.broadcast(repeated), F.col("doc_id") == F.col("doc"), "left")
    else:
        joined = spread_join(keyed, repeated.withColumnRenamed("doc", "doc_id"), ["doc_id"], ["sha"])
    return joined.select("kept", "text", F.when(own, F.col("doc_id")).otherwise(stand_in).alias("row"))


def _judged_apart(rows: DataFrame) -> DataFrame:
    """(doc_id, text) for an operator that takes each document's ``row`` as its doc_id."""
    return rows.select(F.col("row").alias("doc_id"), "text")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose ``row`` is not among ``gone`` (doc_id)."""
    gone = _small(settled(gone.select(F.col("doc_id").alias("gone")).distinct(), "dropped-rows"))
    return rows.join(gone, F.col("row") == F.col("gone"), "left_anti")


def _once(rows: DataFrame) -> DataFrame:
    """One of the rows that agree on ``row``; only those that repeat are moved."""
    several = rows.groupBy(F.col("row").alias("several")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("several")
    several = settled(several, "repeated-rows")
    if several.isEmpty():
        return rows
    several, same = _small(several), F.col("row") == F.col("several")
    return rows.join(several, same, "left_anti").unionByName(rows.join(several, same, "left_semi").dropDuplicates(["row"]))


def _without_duplicates(docs: DataFrame, groups) -> DataFrame:
    rows = _told_apart(docs)
    return _once(_without(rows, groups(_judged_apart(rows)).where("NOT kept"))).select("kept.*")


def _stage(run):
    """``run`` with the session's settings, which nobody else applies to a stage on its own, and with small batches."""
    @functools.wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return run(spark, docs, sf_dir)

    return stage


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic.

    The score depends on the text alone, so equal texts share their decision,
    whatever their doc_id.
    """
    scores = toxicity_of_texts(docs, table(spark, sf_dir, "labels"))
    toxic = _small(settled(scores.where("predicted = 1").select("text_sha").distinct(), "toxic-texts"))
    return _packed(docs).join(toxic, F.col("sha") == F.col("text_sha"), "left_anti").select("kept.*")


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest, then the one with the smallest doc_id."""
    return _without_duplicates(docs, exact_groups)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked directly or through others, the one with the smallest doc_id."""
    return _without_duplicates(docs, similar_groups)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    rows = _told_apart(docs)
    return _without(rows, contaminated(_judged_apart(rows), table(spark, sf_dir, "benchmark"))).select("kept.*")


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, ids and the text decoded from them."""
    import public_tokenizers

    file = public_tokenizers.path(PIECE_MODEL)
    return encode_pieces(docs, file, decode=True, most=REMEMBERED_SEGMENTS)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Toxicity scores and near-duplicate groups come from fitted and hashed models that SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
