"""URL filters: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

The list holds rules (host and path prefix) and single URLs. A URL asks for
the host suffixes and path prefixes that rules can have at all: the numbers of
labels and the prefix lengths that occur in the list. The Bloom filter (one
64-bit word per block, four bits per key) drops nearly all questions; the
rest meets the list in a join on the key, which removes false positives. The
longest rule wins.

Only DataFrame functions run here. The verdict depends on the URL alone, so
distinct URLs are judged and joined back: one URL on a third of all rows is
one question. The filter is broadcast only below ``BROADCAST_BYTES`` (16 bytes
a block, its size is known from the number of keys); beyond, it is joined by
shuffle like any table.

Defined results: a null URL or one without ``://`` has an empty host and path
and meets only rules for them; a rule that is listed twice with different
verdicts blocks; equally long rules: block before allow, then the smaller
text; an empty list gives every row the default; repeated rows stay; the
result has the columns of the input (of a clashing name, the new one) plus
host, path, rule and verdict.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import stored

BITS_PER_KEY = 16
HASHES = 4
BROADCAST_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _mask(key: Column) -> Column:
    """``HASHES`` bits of one 64-bit word."""
    code = F.xxhash64(F.lit("bits"), key)
    out = F.lit(0).cast("long")
    for i in range(HASHES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(code, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, bits) of a blocked Bloom filter; blocks without keys are left out."""
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def _questions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys that could be listed for a URL: suffixes of the host times prefixes of the path, and the URL itself."""
    parts = F.split(host, r"\.")
    suffixes = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels]
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    rules = [F.concat(s, p) for s in suffixes for p in prefixes]
    return F.array_distinct(F.array_compact(F.array(F.concat(F.lit("="), host, path), *rules)))


def filter_urls(df: DataFrame, rules: DataFrame, listed: DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row.

    ``rules`` has (host, path, verdict) with verdict block or allow; ``listed``
    has URLs in ``url`` that are blocked as they are where no rule fits.
    """
    keys = rules.where("host IS NOT NULL AND path IS NOT NULL").select(
        F.concat("host", "path").alias("key"), "verdict", _labels(F.col("host")).alias("labels"), F.length("path").alias("prefix"))
    shape = keys.agg(F.collect_set("labels").alias("labels"), F.collect_set("prefix").alias("prefix")).first()
    table = keys.select("key", "verdict")
    if listed is not None:
        host, path = host_and_path(F.col("url"))
        table = table.unionByName(listed.where("url IS NOT NULL").select(F.concat(F.lit("="), host, path).alias("key"), F.lit("block").alias("verdict")))
    table = stored(table.groupBy("key").agg(F.max("verdict").alias("verdict")), "url-list")
    blocks = max(1, math.ceil(table.count() * BITS_PER_KEY / 64))
    bits = stored(bloom_filter(table, "key", blocks), "bloom-filter")
    if 16 * blocks <= BROADCAST_BYTES:
        bits = F.broadcast(bits)

    host, path = host_and_path(F.col("url"))
    asked = df.select(F.col(url).alias("url")).distinct().select("url", F.explode(_questions(
        host, path, sorted(shape["labels"]), sorted(shape["prefix"]))).alias("key"))
    asked = asked.withColumn("block", _block(F.col("key"), blocks)).withColumn("mask", _mask(F.col("key")))
    possible = asked.join(bits, "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("url", "key")
    hits = possible.join(table, "key")
    single = F.col("key").startswith("=")
    best = stored(hits.groupBy("url").agg(
        F.min(F.when(~single, F.struct((-F.length("key")).alias("n"), (F.col("verdict") != "block").alias("open"), F.col("key").alias("rule"), "verdict"))).alias("best"),
        F.max(F.when(single, F.col("verdict"))).alias("own")), "url-verdicts")
    verdicts = best.select(F.col("url").alias("_url"), F.col("best.rule").alias("_rule"), F.coalesce("best.verdict", "own").alias("_verdict"))
    plain = df.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(url))
    return plain.join(verdicts, F.col(url).eqNullSafe(F.col("_url")), "left").select(
        *plain.columns, host.alias("host"), path.alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict"))
