"""URL filters: prefix rules, then a list of canonical URLs behind a blocked Bloom filter.

The list becomes a Bloom filter of 256-bit blocks (four 64-bit words, two
bits set in each): a URL reads one block only, so the filter is a table keyed
by block. It passes possible hits on; only those meet the list itself in an
exact hash join, which removes the false positives. Column functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

WORDS = ("w0", "w1", "w2", "w3")
#: In a broadcast hash table a block takes key, four words and row overhead.
BLOCK_BYTES = 96


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column, host: Column, path: Column) -> Column:
    """Host without ``www.``/``m.`` and default port, path without closing
    slashes, sorted query without tracking parameters; no scheme, no fragment.
    Empty for a URL without host."""
    query = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*[^?#]*\?([^#]*)", 1), F.lit(""))
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)=")))
    site = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    page = F.concat(site, F.regexp_replace(path, "/+$", ""))
    return F.when(host == "", F.lit("")).otherwise(
        F.when(F.size(params) > 0, F.concat(page, F.lit("?"), F.array_join(params, "&"))).otherwise(page)
    )


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting ``(verdict, host/path)``
    rule, else null; of equal lengths the longer host goes first. A rule fits
    its host and all subdomains, under its path. Rules are configuration: each
    is one test of the expression."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1].index("/") * -1, r[1])):
        h, p = rule[: rule.index("/")], rule[rule.index("/"):]
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(url)), F.lit(blocks).cast("long"))


def _masks(url: str) -> list[Column]:
    """Two bits in each of four words, from 6-bit pieces of a second hash."""
    bits = f"xxhash64({url}, 'bits')"
    return [
        F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({bits}, {6 * k}) & 63L as int))" for k in (2 * j, 2 * j + 1)))
        for j in range(4)
    ]


def bloom_blocks(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """The filter: (block, w0..w3), combined map-side before its shuffle."""
    bits = listed.select(_block(url, blocks).alias("block"), *(m.alias(w) for m, w in zip(_masks(url), WORDS)))
    return bits.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in WORDS))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], *, key: str = "page_id",
               url: str = "url", bits_per_url: int = 12, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per page: key, url, host, path, rule, verdict, canonical and
    possible (the filter passed it on).

    ``listed`` has one column ``canonical`` (repeats and nulls allowed). A
    fitting rule decides; of the others, listed URLs are blocked. The filter
    is broadcast while its blocks take at most ``max_broadcast_bytes``;
    beyond that pages meet it in a join on the block. The exact join reads
    possible hits only and is a plain equi-join, whose skewed partitions Spark
    splits.

    Null or malformed URL: host and path empty, allowed. Repeated rows are
    judged one by one; empty tables give empty results; other columns of
    ``pages`` are not looked at.
    """
    listed = stage(listed.select("canonical").where("canonical <> ''").distinct(), "url-list")
    blocks = max(1, -(-listed.count() * bits_per_url // 256))
    bloom = bloom_blocks(listed, "canonical", blocks).withColumnRenamed("block", "b")
    if blocks * BLOCK_BYTES <= max_broadcast_bytes:
        bloom = F.broadcast(bloom)
    p = pages.select(F.col(key), F.col(url)).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    p = p.withColumn("canonical", canonical_url(F.col(url), F.col("host"), F.col("path")))
    p = p.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    inside = F.lit(True)
    for w, m in zip(WORDS, _masks("canonical")):
        inside = inside & (F.col(w).bitwiseAND(m) == m)
    p = (
        p.join(bloom, _block("canonical", blocks) == F.col("b"), "left")
        .withColumn("possible", F.col("fit").isNull() & (F.col("canonical") != "") & F.coalesce(inside, F.lit(False)))
        .select(key, url, "host", "path", "canonical", "fit", "possible")
    )
    hits = p.where("possible").join(listed.select("canonical", F.lit("block").alias("listed")), "canonical", "left")
    rest = p.where("not possible").withColumn("listed", F.lit(None).cast("string"))
    return rest.unionByName(hits).select(
        key, url, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.col("listed"), F.lit("allow")).alias("verdict"),
        "canonical", "possible",
    )
