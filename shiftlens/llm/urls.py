"""URL filter: rules and listed URLs, probed through a blocked Bloom filter and an exact hash join.

Each listed entry is one key. Rules (host and path prefix) and canonical URLs share the filter; a
page's candidate keys are its canonical URL and every pair of a host suffix and a path prefix of a
length that some rule has. Only keys that the filter lets through are joined with the exact list,
which removes the false positives. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import ascii_lower

ALLOW, BLOCK = "allow", "block"
#: 64-bit words of the filter. It is broadcast as one row per word in use: at most 2^20 rows, 16 MB.
WORDS = 1 << 20
BITS_PER_KEY = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host after the first ``://`` and the path up to ``?``, ``#`` or the end; both are
    empty for a null url or one without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def canonical(host: Column, path: Column) -> Column:
    """``host/path`` without a leading ``www.``, a default port and trailing slashes; null without a host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"/+$", "")))


def _block(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    """``BITS_PER_KEY`` bits of one 64-bit word, from six bits each of a second hash."""
    h, out = F.xxhash64(key, F.lit("bits")), F.lit(0).cast("bigint")
    for i in range(BITS_PER_KEY):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return out


def bloom_words(keys: DataFrame, words: int = WORDS) -> DataFrame:
    """The filter of ``keys.key`` as rows (block, word), at most ``words`` of them."""
    return (keys.select(_block(F.col("key"), words).alias("block"), _mask(F.col("key")).alias("mask"))
            .groupBy("block").agg(F.bit_or("mask").alias("word")))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, url: str = "url",
                default: str = ALLOW, words: int = WORDS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (verdict, host, path prefix) from the configuration, so their number is bounded;
    a rule fits its host and all subdomains if the path starts with its prefix, and the longest rule
    (host and path together; the larger string on a tie, then block before allow) decides. ``listed.url`` are canonical URLs
    to block, of any number. Without a rule a listed URL is blocked and any other gets ``default``.

    Null, empty and malformed urls have an empty host and path, fit no rule and no listed URL.
    Repeated pages are all returned. Nulls and repeats in ``listed`` count for nothing. Input columns
    named like an output column are replaced.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url}`"))
    outs = ("host", "path", "rule", "verdict")
    base = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in outs], host.alias("host"), path.alias("path"))
    seen = pages.select(host.alias("host"), path.alias("path")).filter("host <> ''").distinct()

    exact = listed.select(F.concat(F.lit("u "), F.col("url")).alias("key")).filter("key is not null").distinct() \
        .select("key", F.lit(None).cast("string").alias("fits"), F.lit(BLOCK).alias("says"))
    if rules:
        exact = exact.unionByName(spark.createDataFrame(
            [(f"r {h}{p}", f"{h}{p}", v) for v, h, p in dict.fromkeys(map(tuple, rules))], "key string, fits string, says string"))
    lengths = sorted({len(p) for _, _, p in rules})

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]).cast("array<string>")
    by_rule = F.flatten(F.transform(suffixes, lambda s: F.transform(
        F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(F.lit("r "), s, p))))
    keys = F.concat(by_rule, F.array(F.concat(F.lit("u "), canonical(F.col("host"), F.col("path")))))

    probes = seen.select("host", "path", F.explode(F.array_distinct(keys)).alias("key")) \
        .select("*", _block(F.col("key"), words).alias("block"), _mask(F.col("key")).alias("mask"))
    possible = probes.join(F.broadcast(bloom_words(exact, words)), "block") \
        .filter(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("host", "path", "key")
    found = possible.join(exact, "key").groupBy("host", "path").agg(
        F.max_by(F.struct("fits", "says"), F.struct(F.coalesce(F.length("fits"), F.lit(-1)), "key", "says")).alias("best"))
    return (base.join(found, ["host", "path"], "left")
            .select(*[c for c in base.columns if c not in ("host", "path")], "host", "path", F.col("best.fits").alias("rule"),
                    F.coalesce("best.says", F.lit(default)).alias("verdict")))
