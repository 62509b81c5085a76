"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

A URL's canonical form is its host without user, port, ``www.`` and closing dot, and its path with escapes decoded,
repeated slashes as one, and without a default file name and closing slashes; scheme, query and fragment are left out. A
listed entry is a URL in any form, with or without a scheme: one with a path blocks that page, one without blocks its host
and all hosts below it. Each URL is looked up under its own canonical form and under each domain it lies in, as far as
the list's hosts have labels. The Bloom filter has KEY_BITS for each entry, in 64-bit blocks, up to MOST_BLOCKS: one block
per key, four bits in it. A small filter is a constant of the plan; a larger one is a table of its blocks, which the pairs of
host and path meet by block. Keys that it passes meet the list in an exact hash join, so false positives go.

Only DataFrame functions run here. A null url, and one without ``://``, has an empty host and path, no rule, and is
allowed. Repeated rows each get their verdict. Null and empty entries list nothing. No pages give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): fixed values of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Listed URLs by default, made by a rule: hosts that serve spam, and doorway pages.
_KINDS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = (
    *(f"{name}.example.{top}" for name in _KINDS for top in ("com", "net", "org")),
    *(f"https://www.{name}.test/doorway/{k}/?ref={k}" for name in _KINDS for k in range(3)),
)
#: Bits of the filter for each entry, and bounds of its number of 64-bit blocks: 32 MB at most, for 16 million entries.
KEY_BITS = 16
LEAST_BLOCKS, MOST_BLOCKS = 64, 1 << 22
#: Blocks of a filter that is a constant of the plan, 1 MB; a larger one is a table.
PLAN_BLOCKS = 1 << 17

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for given, at, below in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(below)
        name = F.when(fits, at + below).otherwise(name)
        verdict = F.when(fits, given).otherwise(verdict)
    return name, verdict


def canonical_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^.*@|:\d*$", ""), r"^www\.|\.$", "")


def canonical_path(path: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(decoded, r"/{2,}", "/"), r"/(index|default)\.(html?|php|aspx?)$", "/"), r"/+$", "")


def canonical_list(listed: DataFrame) -> DataFrame:
    """entry, in canonical form, and labels, how many its host has if it is a host alone."""
    url = F.col("entry")
    host, path = host_and_path(F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("://"), url)))
    parts = listed.select(canonical_host(host).alias("host"), canonical_path(path).alias("path")).filter("host <> ''")
    return parts.select(F.concat("host", "path").alias("entry"), F.when(F.col("path") == "", _labels(F.col("host"))).alias("labels")).distinct()


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def lookup_keys(host: Column, path: Column, most: int) -> Column:
    """The canonical URL and each domain of at most so many labels that the host lies in, itself included."""
    name = canonical_host(host)
    domains = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), _labels(name))), lambda k: F.call_function("substring_index", name, F.lit("."), -k))
    page = F.array(F.concat(name, canonical_path(path)))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_union(page, domains) if most else page)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    bits = F.xxhash64(key, F.lit(17))
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return one[0].bitwiseOR(one[1]).bitwiseOR(one[2]).bitwiseOR(one[3])


def filter_blocks(entries: int) -> int:
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (entries * KEY_BITS // 64).bit_length()))


def bloom_filter(listed: DataFrame, blocks: int) -> Column:
    """The filter as a constant array of blocks; their number is bounded, and so is what is collected."""
    rows = listed.groupBy(_block(F.col("entry"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("entry"))).alias("word")).collect()
    words = dict.fromkeys(range(blocks), 0) | {r.block: r.word for r in rows}
    return F.split(F.lit(",".join(map(str, words.values()))), ",").cast("array<bigint>")


def block_table(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as rows of block and word, at most MOST_BLOCKS of two numbers, 64 MB, and broadcast for that bound."""
    return F.broadcast(listed.groupBy(_block(F.col("entry"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("entry"))).alias("word")))


def maybe_listed(key: Column, words: Column, blocks: int) -> Column:
    mask = _mask(key)
    return F.element_at(words, (_block(key, blocks) + 1).cast("int")).bitwiseAND(mask) == mask


def filter_urls(pages: DataFrame, listed: DataFrame | Sequence[str] = LISTED, rules: Sequence[tuple[str, str, str]] = RULES, blocks: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages. A table of listed URLs has them in a column entry."""
    spark = pages.sparkSession
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(x,) for x in listed], "entry string")
    listed = canonical_list(listed)
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.max("labels"), F.lit(0)).alias("labels")).first()
    blocks = blocks or filter_blocks(size.n)
    words = bloom_filter(listed, blocks) if blocks <= PLAN_BLOCKS else None
    table = block_table(listed, blocks) if words is None else None
    listed = listed.select("entry")
    host, path = host_and_path(F.col("url"))
    name, verdict = by_rule(F.col("host"), F.col("path"), rules)
    seen = pages.select("page_id", host.alias("host"), path.alias("path")).fillna("", ["host", "path"]).withColumns({"rule": name, "verdict": verdict})
    keys = lookup_keys(F.col("host"), F.col("path"), size.labels)
    passing = keys if words is None else F.filter(keys, lambda k: maybe_listed(k, words, blocks))
    keyed = seen.withColumn("keys", F.when(F.col("rule").isNull(), passing))
    asked = F.size(F.coalesce("keys", F.array().cast("array<string>"))) > 0
    columns = ["page_id", "host", "path", "rule", "verdict"]
    clear = keyed.filter(~asked).select(*columns)
    # the verdict hangs on host and path alone: hits are found once for each pair, then joined to the rows
    possible = keyed.filter(asked)
    pairs = possible.select("host", "path", "keys").distinct().withColumn("entry", F.explode("keys")).drop("keys")
    if table is not None:
        met = pairs.withColumn("block", _block(F.col("entry"), blocks)).join(table, "block")
        pairs = met.filter(F.col("word").bitwiseAND(_mask(F.col("entry"))) == _mask(F.col("entry"))).select("host", "path", "entry")
    hits = pairs.join(listed, "entry").select("host", "path", F.lit(True).alias("hit")).distinct()
    judged = possible.join(hits, ["host", "path"], "left").withColumn("verdict", F.when(F.col("hit"), "block")).select(*columns)
    return clear.unionByName(judged).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))


def _sql_page(entry: str) -> str | None:
    """The canonical page of a listed URL, for URLS_SQL; none for a host."""
    rest = entry.rpartition("://")[2].split("?")[0].split("#")[0].rstrip("/").removeprefix("www.")
    return rest if "/" in rest else None


URLS_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), seen AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM seen
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN {" OR ".join(f"name = '{x}' OR suffix(name, '.{x}')" for x in LISTED if _sql_page(x) is None)} THEN 'block'
  WHEN name || regexp_replace(regexp_replace(regexp_replace(path, '/{{2,}}', '/', 'g'), '/(index|default)\\.(html?|php|aspx?)$', '/'), '/+$', '')
    IN ({", ".join(f"'{_sql_page(x)}'" for x in LISTED if _sql_page(x))}) THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@|:\\d*$', '', 'g'), '^www\\.|\\.$', '', 'g') AS name FROM ruled)
"""
