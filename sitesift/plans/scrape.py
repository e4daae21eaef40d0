"""End-to-end scrape (P8) and result sinks (K1-K6).

``scrape(sites, fetches)``:
  F6 route -> direct URL or discovery (P1) -> O1 per-site limit on ``ord``
  -> J2 lookup in the archive -> P6 extract -> checkpoint -> P7 dedup+chunk
  -> K2 nested result per site, empty sites kept (F19).

Shuffles: the URL lookup (join on url; the candidate side is bounded per
site), the dedup aggregates on (site, hash) with map-side combine, the
join back on the unique (site, ord) key, and one grouping per site to nest
the result. The nested record holds a site's items in one row, bounded by the
O1 limit; ``nest_pages`` cuts the list of a site of any size into rows of
bounded size, and ``write_partitioned`` writes the flat items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..functions.urls import default_scheme, route, url_netloc
from ..operators.chunking import chunk_items
from ..operators.dedup import deduplicate
from ..operators.discover import discover
from ..operators.extract import extract, items_of
from ..operators.lookup import lookup_url
from ..operators.order import number_within, running_sum_within
from ..operators.report import report_record
from ..session import cut_lineage

#: Bytes of item text in one page of a nested result, about.
PAGE_BYTES = 4_000_000
#: Bytes of item text in one file of a host, about.
FILE_BYTES = 256_000_000
API_CONTENT_CUT = 5000
API_MAX_ITEMS = 20
API_DEFAULT_ITEMS = 10


def candidates(sites: DataFrame, fetches: DataFrame) -> DataFrame:
    """F6 + S7 + P1: direct sites yield their own URL, the others discover."""
    routed = sites.withColumn("route", route("base_url"))
    direct = routed.where(F.col("route") == "direct").select(
        "site", F.col("base_url").alias("url"), F.lit("direct").alias("source"),
        F.lit(None).cast("date").alias("lastmod"), F.lit(1).alias("ord"))
    others = routed.where(F.col("route") != "direct").drop("route")
    found = discover(others, fetches)
    return direct.unionByName(found.select("site", "url", "source", "lastmod", "ord"))


@dataclass(frozen=True)
class Run:
    """The tables of one run; what is counted or read twice is written once."""

    candidates: DataFrame  # site, url, source, lastmod, ord
    items: DataFrame       # extracted, before dedup
    result: DataFrame      # site, ord, part, title, content, content_type, source_url


def run(sites: DataFrame, fetches: DataFrame, cands: DataFrame | None = None) -> Run:
    """Candidates, extracted and processed items. A null ``max_items`` takes
    all candidates of its site; ``result`` is lazy."""
    cands = candidates(sites, fetches) if cands is None else cands
    limited = cands.join(sites.select("site", "max_items", "use_browser", "chunk_size"), "site") \
        .where(F.col("max_items").isNull() | (F.col("ord") <= F.col("max_items")))                                   # O1
    f = fetches.select("url", "status", "content_type", "body", "rendered_html", "render_error")
    looked = lookup_url(limited, f)                                                  # J2
    items = items_of(extract(looked, use_browser="use_browser"), keys=("site", "ord", "chunk_size"))
    items = cut_lineage(items)  # extraction is the costly stage; dedup reads it twice
    result = chunk_items(deduplicate(items), F.col("chunk_size")).drop("chunk_size")
    return Run(cands, items, result)


def scrape_items(sites: DataFrame, fetches: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    """Flat processed items: site, ord, part, title, content, content_type,
    source_url. A null ``max_items`` takes all candidates of its site."""
    return run(sites, fetches, cands).result


def stage_counts(run: Run) -> DataFrame:
    """A5: discovered, extracted, deduped and chunked per site, from the tables
    of one run: one tagged aggregate over narrow columns. Every item that
    dedup keeps has a first part. Give a ``run`` whose result is written, or
    the result is computed for its counts."""
    tags = ("discovered", "extracted", "deduped", "chunked")
    rows = (
        run.candidates.select("site", F.lit("discovered").alias("tag"))
        .unionByName(run.items.select("site", F.lit("extracted").alias("tag")))
        .unionByName(run.result.select("site", F.explode(F.when(F.col("part") == 1, F.array(F.lit("deduped"), F.lit("chunked")))
                                                         .otherwise(F.array(F.lit("chunked")))).alias("tag")))
    )
    return rows.groupBy("site").agg(*(F.count_if(F.col("tag") == t).alias(t) for t in tags))


_ITEM = ("title", "content", "content_type", "source_url")


def nest(sites: DataFrame, items: DataFrame) -> DataFrame:
    """K2 + F19: {site, items:[{title, content, content_type, source_url}]} in item order.

    For sites with a ``max_items`` (O1), whose groups that bounds; without one,
    ``nest_pages`` gives rows of bounded size.
    """
    per = items.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("ord", "part", *_ITEM))).alias("x"))
    per = per.select("site", F.transform("x", lambda i: F.struct(*(i[c].alias(c) for c in _ITEM))).alias("items"))
    return sites.select("site").join(per, "site", "left").select(
        "site", F.coalesce("items", F.array().cast(per.schema["items"].dataType)).alias("items"))


def nest_pages(sites: DataFrame, items: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """K2 for sites of any size: {site, page, items}, pages numbered from 1.

    Prefix sums of the items' bytes cut a site's list; a page starts within
    ``page_bytes`` and so exceeds them by one item at most. All pages of a site
    in order are its whole list. Sites without items have one empty page.
    """
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in _ITEM), F.lit(0).cast("long"))
    order = [F.col("ord"), F.col("part")]
    sized = running_sum_within(items.select("site", "ord", "part", size.alias("size")), "site", order, "size", "before")
    paged = sized.select("site", "ord", "part", (F.floor(F.col("before") / page_bytes)).alias("slot"))
    first = paged.groupBy("site", "slot").agg(F.min(F.struct("ord", "part")).alias("first"))
    first = number_within(first, "site", [F.col("slot")], "page").select("site", "slot", F.col("page").cast("int").alias("page"))
    per = items.join(paged, ["site", "ord", "part"]).groupBy("site", "slot").agg(
        F.sort_array(F.collect_list(F.struct("ord", "part", *_ITEM))).alias("x"))
    per = per.join(first, ["site", "slot"]).select("site", "page", F.transform("x", lambda i: F.struct(*(i[c].alias(c) for c in _ITEM))).alias("items"))
    return sites.select("site").join(per, "site", "left").select(
        "site", F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("items", F.array().cast(per.schema["items"].dataType)).alias("items"))


def scrape(sites: DataFrame, fetches: DataFrame) -> DataFrame:
    return nest(sites, scrape_items(sites, fetches))


def api_result(nested: DataFrame, processing_time=None) -> DataFrame:
    """K4: content cut to 5,000 characters, total_items, processing_time rounded to 2."""
    pt = F.lit(None).cast("double") if processing_time is None else F.round(F.lit(float(processing_time)), 2)
    return nested.select(
        "site",
        F.transform("items", lambda i: i.withField("content", F.substring(i["content"], 1, API_CONTENT_CUT))).alias("items"),
        F.size("items").alias("total_items"),
        pt.alias("processing_time"),
    )


def api_request_sites(requests: DataFrame) -> DataFrame:
    """App profile (O2, U5): scheme added, cap min(n or 10, 20), chunk 6000; without the rejected rows."""
    r = requests.withColumn("u", py_strip("url"))
    return r.where(F.col("u") != "").select(
        default_scheme("u").alias("site"), default_scheme("u").alias("base_url"),
        F.least(F.coalesce("max_items", F.lit(API_DEFAULT_ITEMS)), F.lit(API_MAX_ITEMS)).alias("max_items"),
        F.lit(6000).alias("chunk_size"), F.coalesce("use_browser", F.lit(False)).alias("use_browser"))


def rejected_requests(requests: DataFrame) -> DataFrame:
    """the requests without a URL, all columns kept, with the error that they get."""
    return requests.where(F.coalesce(py_strip("url"), F.lit("")) == "").withColumn("error", F.lit("URL is required"))


# ---------------------------------------------------------------- sinks

def item_records(items: DataFrame) -> DataFrame:
    """K1: the four-key item record as JSON text."""
    return items.select("site", "ord", "part", F.to_json(F.struct("title", "content", "content_type", "source_url")).alias("record"))


def write_results(nested: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: one JSON object per line (UTF-8, not ASCII-escaped)."""
    nested.write.mode(mode).json(path)


def write_partitioned(items: DataFrame, path: str, run_date: str, mode: str = "overwrite", file_bytes: int = FILE_BYTES) -> None:
    """K6: output files named by host and run date (partition folders).

    Each host's rows are dealt over as many slots as its bytes fill files, and
    a slot is written by one task: a small host is one file, a large one has
    about its bytes over ``file_bytes``, and no task holds more than a few slots."""
    named = items.withColumns({"host": url_netloc("source_url"), "run_date": F.lit(run_date)})
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in _ITEM), F.lit(0).cast("long"))
    files = named.groupBy("host").agg(F.ceil((F.sum(size) + 1) / file_bytes).alias("__files"))
    slot = F.pmod(F.xxhash64("source_url", "ord", "part"), F.col("__files"))
    dealt = named.join(files, "host").withColumn("__slot", slot).repartition("host", "__slot").drop("__files", "__slot")
    dealt.write.mode(mode).partitionBy("host", "run_date").json(path)


def write_report(results: DataFrame, dimension: DataFrame, path: str, run_date: str, mode: str = "overwrite") -> None:
    """K5: the whole run report under ``path``: detailed_results and
    test_websites as tables of their own, and, written last, ``report``: one
    JSON record of metadata (with ``run_date``), statistics and the names of
    the two tables. A reader that finds ``report`` finds all of it."""
    results.write.mode(mode).json(f"{path}/detailed_results")
    dimension.write.mode(mode).json(f"{path}/test_websites")
    record = report_record(results, dimension, run_date)
    record = record.withColumn("detailed_results", F.lit("detailed_results")).withColumn("test_websites", F.lit("test_websites"))
    record.coalesce(1).write.mode(mode).json(f"{path}/report")
