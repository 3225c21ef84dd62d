"""URL filters: a blocked Bloom filter over listed keys, then an exact hash join.

A key is ``host/path``: a listed URL in canonical form (without scheme, query, fragment and trailing slashes, A-Z of the host lower-cased), or a rule. A rule fits
its host and all subdomains, on paths that start with the rule's. So the keys under which a URL can be listed are its host
and the parents of that, each with its whole path and with the path's prefixes of the lengths that rules have. All
of them are looked up in the filter: a table of 256-bit blocks, one bit in each of eight 32-bit words. Possible hits go to
an exact join on the key, which removes false positives; there a listed URL must be the whole URL, host and path, and holds for no subdomain. Of the rules that fit, the longest host
wins, then the longest path; a listed URL decides only where no rule fits, and a URL that nothing fits is allowed.

Each distinct URL is judged once, so a URL with a third of all rows costs as much as another; its verdict joins the pages by URL.

Defined cases: a null URL or one without ``://`` has empty host and path and is allowed; repeated pages give repeated results; empty
tables give empty results; null or empty listed URLs are ignored; of equal rules with different verdicts, ``block`` wins; a very long URL has as many keys as its host has
parents; input columns named host, path, rule or verdict are replaced, others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidyne.llm.common import BROADCAST_ROWS, cut, own_prefix, small_enough

#: The rules of the query, as (verdict, host/path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BITS_PER_KEY = 16
WORDS = 8


def host_of(url):
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: str):
    """``host/path`` of a URL column, without trailing slashes."""
    host, path = host_of(url), F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(F.length(host) > 0, F.concat(host, F.when(path == "", F.lit("/")).otherwise(path)))


def _block(key, blocks: int):
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks))


def _bits(key):
    """One bit in each of the words of a block, from eight times five bits of a second hash."""
    h = F.xxhash64(F.lit(2), key)
    return [F.expr("1L") * F.pow(F.lit(2), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31))).cast("long") for i in range(WORDS)]


def bloom_filter(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(block, w0 ... w7) for the blocks with bits set, and how many blocks there are. ``keys`` has one column, key."""
    blocks = max(1, count * BITS_PER_KEY // (32 * WORDS) + 1)
    marks = keys.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return marks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def possible(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``candidates`` whose key may be listed."""
    probe = candidates.withColumn("block", _block(F.col("key"), blocks))
    probe = probe.join(bloom, "block")
    for i, bit in enumerate(_bits(F.col("key"))):
        probe = probe.where(F.col(f"w{i}").bitwiseAND(bit) != 0)
    return probe.drop("block", *[f"w{i}" for i in range(WORDS)])


def listed_keys(rules, listed: DataFrame | None, spark) -> DataFrame:
    """(key, rule, verdict): the rules, and listed URLs (column url) with a null rule."""
    table = spark.createDataFrame([(r, r, v) for v, r in rules] or [("", "", "")], "key string, rule string, verdict string").where("key != ''")
    if listed is not None:
        table = table.unionByName(listed.select(canonical("url").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")).where("key is not null"))
    return table.groupBy("key", "rule").agg(F.max("verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules=RULES, listed: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    spark = pages.sparkSession
    added = ["host", "path", "rule", "verdict"]
    table = cut(listed_keys(rules, listed, spark))
    count = table.count()
    # a rule counts as listed under its own key, a URL under its canonical key
    bloom, blocks = bloom_filter(table.select("key"), count)
    if blocks <= BROADCAST_ROWS // 4:
        bloom = F.broadcast(bloom)
    urls = pages.select("url").where("url is not null").distinct().withColumn("host", host_of("url")).withColumn("path", path_of("url"))
    lengths = sorted({len(r) - r.index("/") for _, r in rules if "/" in r})
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    whole = F.regexp_replace("path", r"/+$", "")
    prefixes = F.array_distinct(F.concat(F.array(F.when(whole == "", F.lit("/")).otherwise(whole)), *[F.when(F.length("path") >= n, F.array(F.substring("path", 1, n))).otherwise(F.array().cast("array<string>")) for n in lengths]))
    keys = F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: F.struct(F.concat(h, p).alias("key"), F.length(h).alias("h"), F.length(p).alias("p")))))
    candidates = urls.select("url", "host", "path", F.explode(keys).alias("k")).select("url", "host", "path", "k.*")
    hits = possible(candidates, bloom, blocks)
    exact = hits.join(small_enough(table) if count <= BROADCAST_ROWS else table, "key")
    # a rule must be a prefix of the path, which the '/' made for an empty path is not; a listed URL must be the whole of host and path
    bare = F.regexp_replace("path", r"/+$", "")
    complete = (F.col("h") == F.length("host")) & (F.col("p") == F.length(F.when(bare == "", F.lit("/")).otherwise(bare)))
    exact = exact.where(F.when(F.col("rule").isNotNull(), F.length("path") >= F.col("p")).otherwise(complete))
    own = own_prefix(pages)
    best = exact.groupBy(F.col("url").alias(f"{own}url")).agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.col("rule").isNotNull(), "h", "p")).alias(f"{own}best"))
    joined = pages.join(best, F.col("url") == F.col(f"{own}url"), "left")
    kept = [c for c in pages.columns if c not in added]
    return joined.select(*kept, F.coalesce(host_of("url"), F.lit("")).alias("host"), F.coalesce(path_of("url"), F.lit("")).alias("path"), F.col(f"{own}best.rule").alias("rule"), F.coalesce(F.col(f"{own}best.verdict"), F.lit("allow")).alias("verdict"))


def production_list(spark) -> DataFrame:
    """A list made by rule: on example.org, the English pages with numbers divisible by 7, up to 70,000."""
    return spark.range(1, 10_001).select(F.concat(F.lit("https://example.org/en/"), F.col("id") * 7).alias("url"))


#: A URL listed for example.org holds for that host alone.
ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, '.' || host AS h, regexp_replace(path, '/+$', '') AS whole FROM p),
x AS (SELECT *, CASE
    WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    host = 'example.org' AND regexp_full_match(whole, '/en/[1-9][0-9]{0,4}') AND coalesce(try_cast(substr(whole, 5) AS BIGINT), 1) % 7 = 0 AND coalesce(try_cast(substr(whole, 5) AS BIGINT), 1) BETWEEN 7 AND 70000 AS listed
  FROM q)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM x
"""


def op1(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES, production_list(spark)).select("page_id", "host", "path", "rule", "verdict")
