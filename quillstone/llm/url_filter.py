"""URL filter: a blocked Bloom filter of listed keys in front of an exact hash join, in DataFrame functions only.

A listed key is a host and the beginning of a path (``example.com`` + ``/en/7``); it fits the host, all its subdomains
and every path that starts so.  A url's candidate keys are the suffixes of its host, label by label, times the
beginnings of its path in the lengths that the list holds.  Each candidate is tested in a split-block Bloom filter
(blocks of eight 64-bit words, one bit in each word); only possible hits reach the exact join, which removes the false
positives.  The longest fitting key decides.

Keys come from two lists: rules (with their own verdict, named in the result) and listed canonical urls (always
``block``), which count where no rule fits.

The filter's size is ``bits_per_key`` bits a key.  Up to ``max_filter_bytes`` it is a scalar subquery, sent to every
executor; a list that needs more keeps false positives a little more often, as the filter doesn't grow beyond it.  The
exact join leaves the choice of broadcast or shuffle to Spark's size statistics.

Cases: a null url or one without ``://`` has an empty host and path and fits nothing; empty lists allow all; ties of
length go to the longer host, then to the smaller key; repeated rows give one result row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: The rules of the standard query (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Listed canonical urls of the standard query; a url without a path lists the whole host.
LISTED = [f"http://{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org")]
WORDS = 8


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def listed_keys(spark: SparkSession, urls: list[str] | DataFrame) -> DataFrame:
    """Canonical keys (host, path) of listed urls: host lower-cased, ``www.`` and query gone, no trailing slash."""
    df = urls.select("url") if isinstance(urls, DataFrame) else spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = F.regexp_replace(host_of(F.col("url")), r"^www\.", ""), F.regexp_replace(path_of(F.col("url")), "/+$", "")
    return df.select(host.alias("host"), path.alias("path")).where("host <> ''").distinct()


def keys_table(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct keys: host, path, verdict, is_rule.  Of repeated rules of different verdicts, ``block`` holds."""
    r = rules.groupBy(lower_ascii(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict")).withColumn("is_rule", F.lit(True))
    u = listed.select("host", "path", F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"))
    return r.unionByName(u)


def _key_hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _bit(h: Column, word: int) -> Column:
    """The bit that a key sets in one word of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(h, F.lit(word)), F.lit(64)).cast("int"))


def bloom(keys: DataFrame, bits_per_key: int = 16, max_filter_bytes: int = 16 << 20) -> tuple[DataFrame, int]:
    """One row ``words`` (array of longs, ``WORDS`` a block) and the number of blocks."""
    n = keys.count()
    blocks = max(1, min(-(-n * bits_per_key // (64 * WORDS)), max_filter_bytes // (8 * WORDS)))
    h = keys.select(_key_hash(F.col("host"), F.col("path")).alias("h"))
    masks = h.groupBy(F.pmod("h", F.lit(blocks)).alias("block")).agg(*[F.bit_or(_bit(F.col("h"), w)).alias(f"w{w}") for w in range(WORDS)])
    every = keys.sparkSession.range(blocks).select(F.col("id").alias("block")).join(masks, "block", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("block", F.array(*[F.coalesce(f"w{w}", F.lit(0)) for w in range(WORDS)]).alias("w")))).alias("b"))
    return row.select(F.flatten(F.transform("b", lambda x: x["w"])).alias("words")), blocks


def possible(h: Column, words: Column, blocks: int) -> Column:
    first = F.pmod(h, F.lit(blocks)).cast("int") * WORDS
    tests = [F.get(words, first + w).bitwiseAND(_bit(h, w)) != 0 for w in range(WORDS)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame, **filter_options) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, listed."""
    spark = pages.sparkSession
    keys = keys_table(rules, listed)
    sizes = keys.agg(F.collect_set(F.length("path")).alias("lengths")).first()["lengths"]  # at most as many as path lengths
    if not sizes:
        sizes = [0]
    words, blocks = bloom(keys, **filter_options)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_distinct(F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(sizes)]), lambda x: x.isNotNull()))
    distinct = urls.select("host", "path").distinct().where("host <> ''")
    tried = distinct.select("host", "path", F.explode(suffixes).alias("k_host"), starts.alias("starts")).select("host", "path", "k_host", F.explode("starts").alias("k_path"))
    tried = tried.select("*", _key_hash(F.col("k_host"), F.col("k_path")).alias("h"))
    passed = tried.where(possible(F.col("h"), words.scalar(), blocks)).drop("h")
    hits = passed.join(keys.select(F.col("host").alias("k_host"), F.col("path").alias("k_path"), "verdict", "is_rule"), ["k_host", "k_path"])
    name = F.concat("k_host", "k_path")
    order = F.struct(F.length(name), F.length("k_host"))
    best = hits.withColumn("name", name).groupBy("host", "path").agg(
        F.max(F.when(F.col("is_rule"), F.struct(order.alias("o"), "name", "verdict"))).alias("r"),
        F.max(F.when(~F.col("is_rule"), order)).isNotNull().alias("listed"),
    )
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("r.name").alias("rule"), F.col("r.verdict").alias("rv"), "listed")
    out = urls.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    verdict = F.coalesce("rv", F.when(F.col("listed"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def result(pages: DataFrame) -> DataFrame:
    """The columns of query op4."""
    spark = pages.sparkSession
    return judged(pages, default_rules(spark), listed_keys(spark, LISTED))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}', true)" for h, p, v in RULES)
_LISTED = ", ".join(f"('{u.split('://')[1]}', '', 'block', false)" for u in LISTED)
ORACLE_SQL = rf"""
WITH k(k_host, k_path, verdict, is_rule) AS (VALUES {_VALUES}, {_LISTED}),
u AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
f AS (SELECT r, k.* FROM u JOIN k ON (host = k_host OR ends_with(host, '.' || k_host)) AND starts_with(path, k_path) WHERE host <> ''),
b AS (SELECT r, arg_max(k_host || k_path, length(k_host || k_path)) FILTER (WHERE is_rule) AS rule, arg_max(verdict, length(k_host || k_path)) FILTER (WHERE is_rule) AS rv, bool_or(NOT is_rule) AS listed FROM f GROUP BY r)
SELECT page_id, host, path, rule, CASE WHEN rv IS NOT NULL THEN rv WHEN listed THEN 'block' ELSE 'allow' END AS verdict, coalesce(listed, false) AS listed
FROM u LEFT JOIN b USING (r)
"""
