"""URL filter: a blocked Bloom filter of listed URLs in front of an exact hash join.

A list entry is a host and a path prefix; it fits the host, its subdomains and
every path that starts with the prefix.  A URL is looked up by the keys it could
be listed under: its host suffixes times its path prefixes of the lengths that
occur in the list, and the canonical URL as a whole.  Each key asks one block of
the filter; only possible hits go to the exact join, which removes the false
positives.  Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowered, spread_join, table

#: Bits of a key in its 256-bit block, and listed keys per block (about 10 bits a key).
PROBES, KEYS_PER_BLOCK = 6, 24
#: A filter of at most this many blocks (32 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 1_000_000

#: The rules of the query: host, path prefix, verdict.
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
#: The query lists the canonical URLs of pages whose id this divides.
LISTED_EVERY = 50


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for a null."""
    start = F.instr(url, "://")
    rest = F.coalesce(F.when(start > 0, F.substring(url, start + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lowered(host), path


def canonical(host: Column, path: Column) -> Column:
    """``host/path`` without a closing slash, query and fragment; null without a host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", "")))


def _key_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "_kind", "_key")


def _mask(word: int) -> Column:
    """The bits of a key that lie in 64-bit word ``word`` of its block."""
    bits = F.lit(0).cast("long")
    for probe in range(PROBES):
        place = F.shiftrightunsigned(_key_hash(2), 8 * probe).bitwiseAND(F.lit(255))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
        bits = bits.bitwiseOR(F.when(F.shiftright(place, 6) == word, bit).otherwise(F.lit(0).cast("long")))
    return bits


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, four words of bits) of the keys in ``_kind``, ``_key``."""
    placed = keys.select(F.pmod(_key_hash(1), F.lit(blocks)).alias("_block"), *[_mask(w).alias(f"_w{w}") for w in range(4)])
    return placed.groupBy("_block").agg(*[F.bit_or(f"_w{w}").alias(f"_w{w}") for w in range(4)])


def possible_hits(probes: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Probes whose bits are all set: every listed key, and few others."""
    bloom = bloom.withColumnRenamed("_block", "_its_block")
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    asked = probes.withColumn("_block", F.pmod(_key_hash(1), F.lit(blocks)))
    for w in range(4):
        asked = asked.withColumn(f"_m{w}", _mask(w))
    hit = asked.join(bloom, F.col("_block") == F.col("_its_block"))
    for w in range(4):
        hit = hit.where(F.col(f"_w{w}").bitwiseAND(F.col(f"_m{w}")) == F.col(f"_m{w}"))
    return hit.select(*probes.columns)


def judge_urls(urls: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Verdict of each row of (page_id, url).

    ``rules``: (host, path, verdict) prefixes, the longest that fits wins, block
    before allow among equals.  ``listed``: (canonical) URLs that are blocked
    where no rule fits; everything else is allowed.  A null URL has empty host
    and path and is allowed; repeated rows are judged alike; other columns are
    ignored; an empty table or list gives no hits.
    """
    host, path = host_and_path(F.col("url"))
    parsed = urls.select("url").where("url IS NOT NULL").distinct().select("url", host.alias("host"), path.alias("path"))
    prefixes = rules.where("host <> ''").select(
        F.lit("rule").alias("_kind"), F.concat("host", "path").alias("_key"), F.col("verdict"),
        F.size(F.split("host", "[.]")).alias("_labels"), F.length("path").alias("_chars"),
    )
    exact = listed.where("canonical IS NOT NULL").select(
        F.lit("url").alias("_kind"), F.col("canonical").alias("_key"), F.lit("block").alias("verdict")
    )
    listing = prefixes.drop("_labels", "_chars").unionByName(exact).groupBy("_kind", "_key").agg(F.max("verdict").alias("verdict"))
    blocks = max(1, -(-listing.count() // KEYS_PER_BLOCK))
    bloom = bloom_filter(listing.select("_kind", "_key"), blocks)

    # Distinct shapes of the rules: few, whatever the number of rules.
    shapes = [(r["_labels"], r["_chars"]) for r in prefixes.select("_labels", "_chars").distinct().collect()]
    labels = F.split("host", "[.]")
    keys = [F.struct(F.lit("url").alias("_kind"), canonical(F.col("host"), F.col("path")).alias("_key"))]
    for n, chars in sorted(shapes):
        suffix = F.array_join(F.slice(labels, -n, n), ".")
        fits = (F.size(labels) >= n) & (F.length("path") >= chars) & (F.col("host") != "")
        key = F.when(fits, F.concat(suffix, F.substring("path", 1, chars)))
        keys.append(F.struct(F.lit("rule").alias("_kind"), key.alias("_key")))
    probes = parsed.select("url", F.inline(F.array(*keys))).where("_key IS NOT NULL")

    hits = possible_hits(probes, bloom, blocks).join(listing, ["_kind", "_key"])
    rank = F.struct(F.length("_key"), F.col("verdict"))
    found = hits.groupBy("url").agg(
        F.max_by(F.when(F.col("_kind") == "rule", F.struct("_key", "verdict")),
                 F.when(F.col("_kind") == "rule", rank)).alias("_rule"),
        F.bool_or(F.col("_kind") == "url").alias("_listed"),
    )
    judged = spread_join(urls.select("page_id", "url"), found, ["url"], ["page_id"])
    return judged.select(
        "page_id", "url", host.alias("host"), path.alias("path"), F.col("_rule._key").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("_listed"), "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("_listed", F.lit(False)).alias("listed"),
    )


def op7_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules and the listed canonical URLs, those of every fiftieth page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    listed = pages.where(F.col("page_id") % LISTED_EVERY == 0).select(canonical(host, path).alias("canonical")).distinct()
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules, listed).drop("url")


_HOST = """translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
OP7_SQL = f"""
WITH split AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages
), parsed AS (
  SELECT page_id, {_HOST} AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM split
), rules(rhost, rpath, verdict) AS (
  VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}
), named AS (
  SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS canonical FROM parsed
), listing AS (
  SELECT DISTINCT canonical AS listed_url FROM named WHERE page_id % {LISTED_EVERY} = 0 AND canonical IS NOT NULL
), best AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS place
  FROM named p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN listed_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       listed_url IS NOT NULL AS listed
FROM best LEFT JOIN listing ON canonical = listed_url WHERE place = 1
"""
