"""URL filter: a blocked Bloom filter before an exact hash join.

The listed canonical URLs are host suffixes with a path prefix, each with a verdict. A page's
url gives a candidate for each suffix of its host and each listed path length. A candidate
whose bits are all set in its block of the filter may be listed; the hash join with the list
removes those that aren't, and the longest listed match decides. A page without one gets the
default verdict.

The filter is one row of eight 64-bit words for each block, built by a distributed bit_or. It
is broadcast if its size, known from the count of the list, stays under a bound; beyond it the
candidates are joined to the blocks by an ordinary exchange. The verdicts of the few urls that
match are stored and, if few, broadcast to the pages.

Defined results: a null url or one without `://` has an empty host and path and matches nothing;
repeated rows are judged each; an empty list lets everything default; a listed entry with a null
host, path or verdict is left out, and of entries for one host and path a block wins; columns
other than id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sized, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # of 64 bits, in a block
BITS_A_KEY = 16
BROADCAST_BYTES = 64 << 20
#: Fixed value: host, path and verdict of the production rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substr(__url, instr(__url, '://') + 3)"), "#", 1)).otherwise("")
    rest = F.substring_index(rest, "?", 1)
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substring_index(rest, "/", 1)).otherwise(rest)
    return F.translate(host, UPPER, LOWER), F.when(slash > 0, rest.substr(slash, F.length(rest))).otherwise("")


def _block(key: Column, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks) if isinstance(blocks, int) else blocks)


def _masks(key: Column) -> list[Column]:
    """A bit in each word of the block, from six bits of a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(WORDS)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of the column `key`: block, w0 to w7."""
    marked = keys.select(_block(F.col("key"), blocks).alias("block"), *(m.alias(f"w{k}") for k, m in enumerate(_masks(F.col("key")))))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))


def may_be_listed(candidates: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The candidates (with a column `key`) whose bits are all set."""
    small = blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES
    found = candidates.withColumn("block", _block(F.col("key"), blocks))
    hit = F.lit(True)
    for k, m in enumerate(_masks(F.col("key"))):
        hit &= F.col(f"w{k}").bitwiseAND(m) != 0
    return found.join(F.broadcast(filter_) if small else filter_, "block").filter(hit).drop("block", *(f"w{k}" for k in range(WORDS)))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict. rules: host, path, verdict."""
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna()
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block after allow
    listed = listed.select(F.concat("host", "path").alias("rule"), F.concat_ws("\x00", "host", "path").alias("key"), "verdict", F.length("path").alias("n"))
    sizes = listed.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("n")).alias("lengths")).first()
    blocks = max(1, -(-sizes.n * BITS_A_KEY // (64 * WORDS)))
    filter_ = bloom_blocks(listed.select("key"), blocks)

    host, path = split_url(F.col("__url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url")).select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.lit(sizes.lengths).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat_ws("\x00", s, p)))))
    # the filter is tried where the candidates are made; what passes is exchanged once for each url
    made = urls.filter(F.col("host") != "").select("host", "path", F.explode(keys).alias("key"))
    hits = may_be_listed(made, filter_, blocks).distinct()
    best = hits.join(sized(listed, sizes.n), "key").groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), -F.col("n"), "rule", "verdict")).alias("best"))
    best = stored(best.select(_url_key().alias("key"), F.col("host").alias("h"), F.col("path").alias("p"), "best"), "url-verdicts")
    # urls without a host, which nothing matches, are spread by their rows
    rows = urls.withColumn("k", F.when(F.col("host") != "", _url_key()).otherwise(F.col("row")))
    found = rows.join(sized(best), (F.col("k") == F.col("key")) & (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _url_key() -> Column:
    return F.xxhash64("host", "path")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), p AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM s
), r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, host, path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
