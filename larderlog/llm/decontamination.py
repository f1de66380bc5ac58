"""Benchmark decontamination: size-partitioned MinHash containment search.

Benchmark items are short, documents long, so similarity of whole sets says
nothing and containment counts: the share of an item's shingles that a document
has.  Items are partitioned by size; an item of a partition with at most u
shingles is represented by its floor((1 - t) u) + 1 smallest shingle hashes.  A
document that holds a share t of the item misses at most floor((1 - t) u) of its
shingles, so it has one of these: no item is missed.  Document shingles that meet
a sketch and documents long enough for the item's partition give the candidate
pairs, which are verified by exact containment on the shingles themselves.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS_PER_SHINGLE, lowered, settled, table, text_of, words

CONTAINED = 0.8
#: Sketches and candidates of at most so many rows (16 MB) are broadcast.
BROADCAST_ROWS = 1_000_000


def shingles_of(ws: Column, k: int = WORDS_PER_SHINGLE) -> Column:
    """Shingles in order, as strings; the whole sequence as one if it is shorter, none without words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(1)))
    return F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda i: F.array_join(F.slice(ws, i, k), " "))
    )


def _hashes(ws: Column, k: int = WORDS_PER_SHINGLE) -> Column:
    """Hashes of ``shingles_of`` without building the strings."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(1)))
    return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, k)))
    )


def item_sketches(items: DataFrame, contained: float) -> DataFrame:
    """(item_id, item_shingles, size, partition, sketch): the smallest hashes of each item."""
    ws = items.select("item_id", words(lowered(text_of())).alias("_words"))
    sets = ws.select(
        "item_id", F.array_distinct(shingles_of(F.col("_words"))).alias("item_shingles"),
        F.array_sort(F.array_distinct(_hashes(F.col("_words")))).alias("_hashes"),
    ).where(F.size("item_shingles") > 0)
    size = F.size("item_shingles")
    partition = F.floor(F.log2(size)).cast("int")
    upper = F.pow(F.lit(2), partition + 1) - 1
    need = (F.floor(F.lit(1 - contained) * upper + 1e-9) + 1).cast("int")
    return sets.select("item_id", "item_shingles", size.alias("size"), partition.alias("partition"),
                       F.slice("_hashes", 1, need).alias("sketch"))


def _small(df: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if it is proven small; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """Pairs (doc_id, item_id) of a document and an item of which it holds the share ``contained`` or more.

    Words are lower-cased (A-Z) and split at white space.  An item of fewer than
    five words is one shingle, which only a document of the same words has;
    null and empty texts hold and are held by nothing.  Repeated rows of a
    doc_id, or items of an item_id, give one pair each with the largest share.
    Empty tables give no pairs; other columns are ignored.
    """
    sketches = settled(item_sketches(items, contained), "item-sketches")
    sketched = sketches.select("item_id", "size", F.explode("sketch").alias("hash"))
    cut = docs.select("doc_id", words(lowered(text_of())).alias("_words"))
    content = F.xxhash64("_words").alias("_content")
    hashed = cut.select("doc_id", content, F.size("_words").alias("_n"), F.explode(_hashes(F.col("_words"))).alias("hash"))
    long_enough = F.greatest(F.col("_n") - (WORDS_PER_SHINGLE - 1), F.lit(1)) >= F.lit(contained) * F.col("size") - 1e-9
    pairs = settled(
        hashed.join(_small(sketched), "hash").where(long_enough).select("doc_id", "_content", "item_id").distinct(),
        "leak-candidates",
    )
    held = pairs.select(F.col("doc_id").alias("_doc"), F.col("_content").alias("_its_content")).distinct()
    whole = cut.select("doc_id", content, "_words").join(
        _small(held), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_content") == F.col("_its_content")), "left_semi"
    ).dropDuplicates(["doc_id", "_content"])
    whole = (
        pairs.select(F.col("doc_id").alias("_doc"), F.col("_content").alias("_its_content"), "item_id")
        .join(whole, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_content") == F.col("_its_content")))
        .join(sketches.select("item_id", "item_shingles", "size"), "item_id")
    )
    shared = F.size(F.array_intersect("item_shingles", shingles_of(F.col("_words"))))
    found = whole.select("doc_id", "item_id", "size", shared.alias("shared")).where(
        F.col("shared") >= F.lit(contained) * F.col("size") - 1e-9
    )
    best = F.max(F.struct((F.col("shared") / F.col("size")).alias("share"), "shared", "size")).alias("_best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("_best.size").cast("long").alias("item_shingles"),
        F.col("_best.shared").cast("long").alias("shared_shingles"), F.col("_best.share").alias("containment"),
    )


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_sql(source: str, key: str) -> str:
    """DuckDB: (key, shingle), distinct, of the texts of ``source``."""
    return f"""
SELECT DISTINCT {key}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
       ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS shingle
FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i
      FROM (SELECT {key}, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM {source}) WHERE len(w) > 0)"""


OP8_SQL = f"""
WITH d AS ({shingle_sql('documents', 'doc_id')}), b AS ({shingle_sql('benchmark', 'item_id')}),
sizes AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
hits AS (SELECT d.doc_id, b.item_id, count(*) AS shared FROM d JOIN b USING (shingle) GROUP BY d.doc_id, b.item_id)
SELECT doc_id, item_id, n AS item_shingles, shared AS shared_shingles, shared / n::DOUBLE AS containment
FROM hits JOIN sizes USING (item_id) WHERE shared >= 0.8 * n - 1e-9
"""
