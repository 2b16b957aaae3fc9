"""URL filter: a blocked Bloom filter over listed canonical URLs passes possible hits to an exact hash join.

Native expressions only. A listed entry is a host and a path; it covers its host with all subdomains and every path
that starts with its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Bits per listed entry and words of 32 bits in a block of the filter.
BITS_PER_KEY, WORDS = 16, 8
#: Odd multipliers below 2^31 that give the bit of each word.
SALTS = [1203114875, 1150766481, 1142052525, 1364956239, 1884591559, 770785867, 1333666979, 1550580529]
#: A filter has so many bytes at most, whatever the list, so it is always broadcast. Longer lists have fewer bits per entry: more probes pass, and the exact join removes them.
MOST_BYTES = 16 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end. Null or no ://: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return ascii_lower(host), path


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    block = F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks))
    return block.cast("long"), [F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in SALTS]


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """keys: a column `key`. One row per block that has a bit: block, w0 to w7."""
    block, bits = _bits(F.col("key"), blocks)
    one = F.lit(1).cast("long")
    return keys.groupBy(block.alias("block")).agg(*[F.bit_or(F.call_function("shiftleft", one, b)).alias(f"w{i}") for i, b in enumerate(bits)])


def listed(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows: host, path. The rows that an entry covers, with the longest such entry: host, path, rule, verdict.

    Of entries of equal length the one with the longer host wins, then the smaller verdict. entries: host, path,
    verdict; nulls in them count as empty texts, and an entry with an empty host covers nothing.
    """
    entries = entries.select(F.coalesce("host", F.lit("")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v")).where("h <> ''")
    entries = entries.groupBy("h", "p").agg(F.min("v").alias("v")).withColumn("key", F.concat_ws("\n", "h", "p"))
    told = entries.agg(F.count(F.lit(1)), F.collect_set(F.length("p"))).first()  # a count, and lengths of paths
    blocks = max(1, min(-(-told[0] * BITS_PER_KEY // (32 * WORDS)), MOST_BYTES // (4 * WORDS)))
    lengths = F.array(*[F.lit(x) for x in sorted(told[1])]).cast("array<int>")

    labels = F.split("host", "\\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat_ws("\n", h, p))))
    probes = rows.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key"))

    block, bits = _bits(F.col("key"), blocks)
    bloom = F.broadcast(blocked_bloom(entries, blocks))
    possible = probes.select("*", block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)]).join(bloom, "block")
    for i in range(WORDS):
        possible = possible.where(F.call_function("shiftrightunsigned", F.col(f"w{i}"), F.col(f"b{i}")).bitwiseAND(F.lit(1).cast("long")) == 1)
    sure = possible.select("host", "path", "key").join(entries, "key").select("host", "path", F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("m"), F.concat("h", "p").alias("rule"), "v").alias("hit"))
    return sure.groupBy("host", "path").agg(F.max("hit").alias("hit")).select("host", "path", F.col("hit.rule").alias("rule"), F.col("hit.v").alias("verdict"))


def judge_urls(pages: DataFrame, entries: DataFrame, url: str = "url", default: str = "allow", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per row of pages: the columns in keep, host, path, rule (null if no entry covers the url), verdict.

    Urls are judged once per host and path; a url that a third of the rows share is one row until the last join,
    which the adaptive execution splits. Null, empty and malformed urls have an empty host and path and get the
    default verdict. Other columns of pages are ignored. No pages: no rows; no entries: default verdicts.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    out = rows.join(listed(rows, entries), ["host", "path"], "left")
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
