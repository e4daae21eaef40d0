"""Template detection and first-wins deduplication.

Input: ``items(site, ord, title, content, content_type, source_url)``.

Plan shape (chosen for hot sites and hot hashes):

* the content hash is computed once, map side;
* a narrow key table ``(site, ord, md5, is_blog)`` is aggregated per
  ``(site, md5)`` and per ``site`` -- partial (map-side) aggregation, so a
  hash shared by a third of all rows is pre-combined before the shuffle;
* the kept ``(site, ord)`` keys are joined back to the wide rows on the
  unique item key, so no window ever runs over rows carrying content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_likely_blog_url

# Template thresholds.
TEMPLATE_MIN_COUNT = 3          # count must exceed this
SMALL_RUN_MAX = 10              # runs up to this size use the higher share
SMALL_RUN_SHARE = 0.5
LARGE_RUN_SHARE = 0.3
TEMPLATE_PREFIX = "[Template Content] "


def with_hash(items: DataFrame) -> DataFrame:
    """md5 hex of the UTF-8 content."""
    return items.withColumn("content_md5", F.md5(F.col("content")))


def hash_counts(items: DataFrame) -> DataFrame:
    """A1: items per (site, content hash), with first-seen order."""
    return (
        with_hash(items)
        .groupBy("site", "content_md5")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("ord").alias("first_ord"))
    )


def _stats(items: DataFrame):
    keys = with_hash(items).select("site", "ord", "content_md5", is_likely_blog_url("source_url").alias("is_blog"))
    per_hash = keys.groupBy("site", "content_md5").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("ord").alias("first_ord"),
        F.min(F.when(~F.col("is_blog"), F.col("ord"))).alias("first_nonblog_ord"),
        F.count_if(F.col("is_blog")).alias("blog_cnt"),
    )
    per_site = per_hash.groupBy("site").agg(F.sum("cnt").alias("total"), F.min("first_ord").alias("site_first_ord"))
    return keys, per_hash, per_site


def template_hashes(items: DataFrame) -> DataFrame:
    """A2: the template hash of each site (at most one row per site).

    A hash qualifies when its count exceeds 3 and reaches 50 % of the site's
    items (30 % for runs over 10 items); of several, the one seen last wins.
    """
    _, per_hash, per_site = _stats(items)
    return _templates(per_hash, per_site)


def _templates(per_hash: DataFrame, per_site: DataFrame) -> DataFrame:
    share = F.when(F.col("total") <= SMALL_RUN_MAX, F.lit(SMALL_RUN_SHARE)).otherwise(F.lit(LARGE_RUN_SHARE))
    qualifying = per_hash.join(per_site, "site").where(
        (F.col("cnt") > TEMPLATE_MIN_COUNT) & (F.col("cnt") >= F.col("total") * share)
    )
    return qualifying.groupBy("site").agg(
        F.max_by("content_md5", "first_ord").alias("template_md5"),
        F.max_by("cnt", "first_ord").alias("template_cnt"),
        F.max_by("blog_cnt", "first_ord").alias("template_blog_cnt"),
        F.first("total").alias("total"),
        F.first("site_first_ord").alias("site_first_ord"),
    )


def dropped_and_marked(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, ord) of every item that dedup drops, and of the representatives:
    narrow keys only."""
    keys, per_hash, per_site = _stats(items)
    tpl = _templates(per_hash, per_site)
    # Template removal empties the site -> keep its first item, marked.
    emptied = F.coalesce(F.col("template_blog_cnt") == F.col("total"), F.lit(False))
    marked = tpl.where(emptied).select("site", F.col("site_first_ord").alias("ord"))
    # J6 + W1: template hash keeps its first non-blog item, others their first item.
    kept = (
        F.when(emptied, F.col("site_first_ord"))
        .when(F.coalesce(F.col("content_md5") == F.col("template_md5"), F.lit(False)), F.col("first_nonblog_ord"))
        .otherwise(F.col("first_ord"))
    )
    # hashes of one item that stays need no look at their items
    changed = F.col("template_md5").isNotNull() | (F.col("cnt") > 1)
    per_hash = per_hash.join(tpl, "site", "left").where(changed).select("site", "content_md5", kept.alias("kept"))
    dropped = keys.join(per_hash, ["site", "content_md5"]).where(~F.col("ord").eqNullSafe(F.col("kept"))).select("site", "ord")
    return dropped, marked


def deduplicate(items: DataFrame) -> DataFrame:
    """Template exclusion, representative rule and first-wins dedup.

    Dropped keys leave by an anti-join: with few copies they are broadcast and
    no content moves."""
    dropped, marked = dropped_and_marked(items)
    out = items.join(dropped, ["site", "ord"], "left_anti").join(marked.withColumn("representative", F.lit(True)), ["site", "ord"], "left")
    return out.withColumn(
        "title", F.when(F.col("representative"), F.concat(F.lit(TEMPLATE_PREFIX), F.col("title"))).otherwise(F.col("title")),
    ).drop("representative")
