"""Exact duplicates by content-defined chunk recipes.

A text without its white space is cut where its own characters say so, hence
equal texts are cut alike and a long document becomes a short ordered list of
chunk keys (hash and length).  A dictionary holds each distinct chunk once and
verifies the keys by content: if two different chunks share a key, they get
numbers that tell them apart.  Documents are then compared by their lists; no
document is moved as a whole.  Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import same_key_join
from .common import WHITE, settled, spread_join, table, text_of

#: Least and greatest characters of a chunk.
LEAST, MOST = 192, 4096


def _every_fourth(offset: int, others: str) -> str:
    """A class of about a quarter of the characters: code points 4 k + offset up to U+00FF, and one block of ``others``."""
    return "[" + "".join(f"\\u{c:04x}" for c in range(0x20 + offset, 0x100, 4)) + others + "]"


#: A chunk ends with three characters of given classes (one place in 64), or at MOST characters.
ENDING = _every_fourth(0, r"\u4e00-\u5fff") + _every_fourth(2, r"\u4e00-\u5fff") + _every_fourth(1, r"\u6000-\u6fff")
CHUNK = f"(?s).{{{LEAST - 3},{MOST - 3}}}?{ENDING}|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    """The text without its white space; six plain searches cost less than one pattern."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def chunks_of(norm: Column) -> Column:
    """Chunks of a normalised text, in order; concatenated they give it back."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _keys(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: F.struct(chunk_hash(c).alias("h"), F.length(c).alias("n")))


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, points, sha, recipe, shared_keys): the ordered chunk keys of every row.

    ``shared_keys`` is null unless a chunk of the row shares its key with a different chunk;
    then it lists place and number of such chunks, so that recipes differ where texts do.
    """
    norm = docs.select("doc_id", F.length(text_of()).alias("points"), normalised(text_of()).alias("_norm"))
    sha = F.unhex(F.sha2("_norm", 256))
    cut = norm.select("doc_id", "points", sha.alias("sha"), chunks_of(F.col("_norm")).alias("_chunks"))
    rows = cut.select("doc_id", "points", "sha", _keys(F.col("_chunks")).alias("recipe"))

    placed = cut.select("doc_id", "sha", F.posexplode("_chunks").alias("_at", "_chunk"))
    placed = placed.withColumns({"_h": chunk_hash(F.col("_chunk")), "_n": F.length("_chunk")})
    # Each distinct chunk once; of these only keys with several texts are of further use.
    dictionary = placed.groupBy("_h", "_n", "_chunk").agg(F.count(F.lit(1)).alias("_uses"))
    clashing = settled(dictionary.groupBy("_h", "_n").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1"), "clashing-keys")
    if clashing.isEmpty():
        none = F.lit(None).cast("array<struct<_at:int,_number:int>>")
        return settled(rows.withColumn("shared_keys", none), "recipes")
    sharing = placed.join(clashing.select("_h", "_n"), ["_h", "_n"])
    numbered = sharing.select("_h", "_n", "_chunk").distinct().withColumn(
        "_number", F.dense_rank().over(Window.partitionBy("_h", "_n").orderBy("_chunk"))
    )
    marks = (
        sharing.join(numbered, ["_h", "_n", "_chunk"])
        .groupBy("doc_id", "sha").agg(F.sort_array(F.collect_set(F.struct("_at", "_number"))).alias("shared_keys"))
    )
    return settled(spread_join(rows, marks, ["doc_id", "sha"], ["doc_id", "points"]), "recipes")


def exact_groups(docs: DataFrame, salts: int = 64) -> DataFrame:
    """Group of every row of (doc_id, text): keep_id, group_size, kept, text_sha256.

    The row with the most code points stays, then the smallest doc_id; a null
    doc_id comes last.  Null and empty texts are one group.  Rows that repeat a
    doc_id with an equal text are counted one by one and share their decision.
    An empty table gives no rows; other columns are ignored.  A group may hold
    any share of the rows: it is aggregated in ``salts`` parts first.
    """
    rows = recipes(docs)
    key = ["recipe", "shared_keys"]
    salted = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("id")))
    parts = salted.groupBy(*key, "_part").agg(best.alias("_best"), F.count(F.lit(1)).alias("_rows"))
    groups = parts.groupBy(*key).agg(F.min("_best").alias("_best"), F.sum("_rows").alias("group_size"))
    groups = groups.select(*key, F.col("_best.id").alias("keep_id"), "group_size")
    # Back by the parts that exist, at most ``salts`` of a group.
    judged = same_key_join(salted, same_key_join(parts.select(*key, "_part"), groups, key), [*key, "_part"])
    return judged.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op6_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents, white space aside."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
