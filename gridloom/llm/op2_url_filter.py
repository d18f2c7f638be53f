"""URL filters: a blocked Bloom filter before an exact hash join.

A list holds canonical keys: `host/path` prefixes of rules, and whole canonical URLs.
Each distinct URL gives its candidate keys: its own canonical form, and every suffix of
its host, of at most as many labels as a rule's host has, with every prefix of its path
as long as some rule's. A key's hash names one
64-byte block of the filter and one bit in each of the block's eight words. Candidates
whose block lacks a bit can't be listed; the rest are looked up by their keys, which
removes false positives. Of the rules that are found the longest decides, else a listed
URL is blocked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common

#: (rule, verdict): fixed values of the query's contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Labels whose hosts' URLs the query lists.
LISTED_LABELS = ("casino-win", "cheap-pills", "spam-farm")
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
KEYS_A_BLOCK = 32
WORDS = 8
#: The filter goes to all tasks up to this many blocks of 64 bytes; a larger one is joined by block number. Likewise the list.
BROADCAST_BLOCKS, BROADCAST_KEYS = 1 << 18, 1 << 17


def host(url: Column) -> Column:
    r"""After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(url: Column) -> Column:
    """host without www., path without a final /, and the query without tracking parameters; null or no ://: null."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(?:^|(?<=&)){TRACKING}(?:&|$)", ""), "&$", "")
    whole = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.instr(url, "://") > 0, whole)


def _bits(key: Column, blocks: int) -> list[Column]:
    """The block of a key, and a mask of one bit for each of its words."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    return [F.pmod(h, F.lit(blocks)).alias("block"), *(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(63).cast("int")).alias(f"b{i}") for i in range(WORDS))]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the blocks that hold some key."""
    return keys.select(*_bits(F.col("key"), blocks)).groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)))


def listed(rules: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """The list (key, rule, verdict) of rules (rule, verdict), and of whole URLs (url) to block, in canonical form."""
    keys = rules.select(F.concat(F.lit("r:"), "rule").alias("key"), "rule", "verdict")
    if urls is not None:
        whole = urls.select(F.concat(F.lit("u:"), canonical(F.col("url"))).alias("key")).where("key is not null").distinct()
        keys = keys.unionByName(whole.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")))
    return keys


def candidates(urls: DataFrame, lengths: list[int], most_labels: int) -> DataFrame:
    """(url, key) for rows (url, host, path): the keys that could be listed. lengths: of the rules' paths, in characters; most_labels: of a rule's host."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - most_labels + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("r:"), s, p))))
    return urls.where(F.col("host") != "").select("url", F.explode(F.array_distinct(F.concat(keys, F.array(F.concat(F.lit("u:"), canonical(F.col("url"))))))).alias("key"))


def judge(pages: DataFrame, keys: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (key, host, path, rule, verdict, listed), one for each row of pages.

    keys: a list as listed() makes it. verdict: the longest rule's (of equal rules the
    one that sorts first), else block for listed URLs, else allow. Null URLs and those
    without :// have empty host and path, no rule, and are allowed. Repeated rows are
    judged once and get equal results; a URL has at most as many candidates as rules
    have path lengths times the labels of the longest rule's host, and one more, however
    long it is; other columns of pages are ignored; an empty table gives an empty one.
    """
    rows = pages.select(F.col(key), F.col(url).alias("url"))
    keys = common.spool(keys.where("key is not null").distinct(), "url-list")
    n = keys.count()
    blocks = max(1, n // KEYS_A_BLOCK)
    filters = common.spool(bloom(keys, blocks), "url-bloom")
    lengths = [r[0] for r in keys.where("rule is not null").select(F.length("rule") - F.instr("rule", "/") + 1).distinct().collect()]  # the distinct lengths of rule paths: a few numbers
    most_labels = keys.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\.")))).first()[0] or 0
    urls = rows.select("url").distinct().withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    asked = candidates(urls, sorted(lengths), max(1, most_labels)).select("url", "key", *_bits(F.col("key"), blocks))
    possible = asked.join(F.broadcast(filters) if blocks <= BROADCAST_BLOCKS else filters, "block")
    hit = reduce(Column.__and__, (F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) == F.col(f"b{i}") for i in range(WORDS)))
    possible = possible.where(hit).select("url", "key")
    exact = possible.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys.hint("shuffle_hash"), "key")
    best = F.max_by(F.struct("rule", "verdict"), F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").cast("int").alias("v"))))
    found = exact.groupBy("url").agg(best.alias("best"), F.bool_or(F.col("rule").isNull()).alias("listed"))
    out = rows.join(common.spool(found, "url-found"), "url", "left")
    listed_ = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("best.verdict", F.when(listed_, "block").otherwise("allow"))
    return out.select(key, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"), listed_.alias("listed"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the contract's rules, and the canonical URLs of pages whose host has a label of LISTED_LABELS."""
    pages = common.table(spark, sf_dir, "pages")
    spam = pages.where(F.arrays_overlap(F.split(host(F.col("url")), r"\."), F.array(*map(F.lit, LISTED_LABELS)))).select("url")
    return judge(pages, listed(spark.createDataFrame(list(RULES), "rule string, verdict string"), spam))


_RULES = ", ".join(f"('{r}', '{v}')" for r, v in RULES)
_LABELS = ", ".join(f"'{x}'" for x in LISTED_LABELS)
ORACLE = rf"""
WITH rules(rule, rule_verdict) AS (VALUES {_RULES}),
u AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, rest, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical
      FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: NOT regexp_full_match(x, '(utm_[a-z]+|ref|fbclid|gclid)=.*')), '&') AS query FROM p)),
spam AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), [{_LABELS}])),
best AS (SELECT p.page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
         FROM p JOIN rules ON (p.host = split_part(rule, '/', 1) OR ends_with(p.host, '.' || split_part(rule, '/', 1))) AND starts_with(p.path, substr(rule, instr(rule, '/')))
         GROUP BY p.page_id)
SELECT c.page_id, c.host, c.path, best.rule, coalesce(best.rule_verdict, CASE WHEN spam.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict, spam.canonical IS NOT NULL AS listed
FROM c LEFT JOIN best USING (page_id) LEFT JOIN spam USING (canonical)
"""
QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES = {"op2_url_filter": ORACLE}
