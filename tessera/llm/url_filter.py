"""URL filter: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

DataFrame functions only. The filter is a table of 256-bit blocks, four longs each; a URL's hash names one
block and eight bits in it, two a word. A page is a possible hit if its block has all eight. Only possible
hits go on to an exact equality join with the list, which removes false positives. The block table is joined by
broadcast while its computed size is below `BROADCAST_BYTES` (two million listed URLs), and other pages than possible
hits are then never shuffled; a longer list costs one shuffle of all pages on the block number. A URL that many pages share is a skewed join key, which the adaptive
skew join splits.

Null urls, and urls without ://, have an empty host and path; they fit no rule and no listed URL is empty.
Repeated rows and repeated listed URLs are allowed. An empty list blocks nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_URL, BLOCK_BITS, BROADCAST_BYTES = 16, 256, 32 << 20
WORDS = 4
#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Without scheme, www., fragment, final slashes and tracking parameters; host in lower case."""
    query = F.filter(F.split(F.coalesce(F.regexp_extract(url, _SPLIT, 3), F.lit("")), "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref)="))
    kept = F.array_join(query, "&")
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def rule_of(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null: none), and its verdict."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _bits(url: Column, word: int) -> Column:
    h = F.xxhash64(url, F.lit(1))
    one = F.lit(1).cast("long")
    at = [F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63).cast("long")).cast("int") for j in (word, word + WORDS)]
    return F.call_function("shiftleft", one, at[0]).bitwiseOR(F.call_function("shiftleft", one, at[1]))


def blocks_for(n: int) -> int:
    return max(1, -(-n * BITS_PER_URL // BLOCK_BITS))


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """listed: url. block, w0..w3."""
    keyed = listed.select(F.pmod(F.xxhash64("url"), F.lit(n_blocks)).alias("block"), *[_bits(F.col("url"), i).alias(f"w{i}") for i in range(WORDS)])
    return keyed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(pages: DataFrame, filter_: DataFrame, n_blocks: int, key: str) -> DataFrame:
    """pages with a boolean maybe: the filter has all bits of `key`."""
    small = n_blocks * (8 * (WORDS + 1) + 16) <= BROADCAST_BYTES
    keyed = pages.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n_blocks)))
    probed = keyed.join(F.broadcast(filter_) if small else filter_, "block", "left")
    has = [F.col(f"w{i}").bitwiseAND(_bits(F.col(key), i)) == _bits(F.col(key), i) for i in range(WORDS)]
    all_ = has[0] & has[1] & has[2] & has[3]
    return probed.withColumn("maybe", F.coalesce(all_, F.lit(False))).drop("block", *[f"w{i}" for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, canonical, rule, listed and verdict. listed: canonical URLs in column url."""
    listed = listed.select("url").where("url <> ''").distinct()
    n_blocks = blocks_for(listed.count())
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url)), "canonical": canonical(F.col(url))})
    probed = possible_hits(parts.withColumn("rule", name).withColumn("__said", verdict), bloom(listed, n_blocks), n_blocks, "canonical")
    exact = listed.select(F.col("url").alias("canonical"), F.lit(True).alias("listed"))
    hits = probed.where("maybe").join(exact, "canonical", "left")
    rest = probed.where("not maybe").withColumn("listed", F.lit(False))
    both = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(rest)
    return both.withColumn("verdict", F.coalesce("__said", F.when(F.col("listed"), "block").otherwise("allow"))).drop("__said", "maybe")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: every page. The list stands in for a bought one: the pages' canonical URLs whose MD5 starts
    with a 0, about one in sixteen."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.select(canonical(F.col("url")).alias("url")).where(F.md5("url").startswith("0"))
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


_HOST = r"translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)\??([^#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)\??([^#]*)', 2), '')"
_QUERY = r"array_to_string(list_filter(string_split(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)\??([^#]*)', 3), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)=')), '&')"


def _sql_rule(value: int) -> str:
    cases = [f"WHEN (host = '{r[0]}' OR host LIKE '%.{r[0]}') AND starts_with(path, '{r[1]}') THEN '{r[0] + r[1] if value == 0 else r[2]}'" for r in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    return "CASE " + " ".join(cases) + " END"


OP4_SQL = f"""
WITH parts AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS kept FROM pages),
named AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM named WHERE starts_with(md5(canonical), '0') AND canonical <> '')
SELECT page_id, host, path, {_sql_rule(0)} AS rule, coalesce({_sql_rule(1)}, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
  canonical IN (SELECT canonical FROM listed) AS listed
FROM named"""
