"""Writers (K3, K5, K6) and the nested/API result shapes."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sitesift.operators.report import report_record
from sitesift.plans import scrape as SC
from sitesift.sources.archive import read_table
from sitesift.sources.results import dimension, results_from_events

SF = "/root/testdata/sf0.001"


def _items(spark):
    rows = [("s1", 2, 1, "B", "b" * 6000, "blog", "https://s1.example/b"),
            ("s1", 1, 1, "A", "é" * 10, "news", "https://s1.example/a")]
    return spark.createDataFrame(rows, "site string, ord long, part int, title string, content string, content_type string, source_url string")


def test_nest_and_api_shape(spark):
    sites = spark.createDataFrame([("s1",), ("s2",)], "site string")
    nested = SC.nest(sites, _items(spark))
    got = {r.site: r for r in nested.collect()}
    assert [i.title for i in got["s1"].items] == ["A", "B"]        # item order
    assert got["s2"].items == []                                     # empty site kept
    api = {r.site: r for r in SC.api_result(nested, 1.234).collect()}
    assert api["s1"].total_items == 2 and api["s1"].processing_time == 1.23
    assert len(api["s1"].items[1].content) == 5000


def test_json_writers(spark):
    out = tempfile.mkdtemp(prefix="sitesift-out-")
    sites = spark.createDataFrame([("s1",)], "site string")
    SC.write_results(SC.nest(sites, _items(spark)), out + "/res")
    lines = [ln for f in os.listdir(out + "/res") if f.endswith(".json") for ln in open(os.path.join(out, "res", f), encoding="utf-8")]
    rec = json.loads(lines[0])
    assert rec["site"] == "s1" and rec["items"][0]["content"] == "é" * 10
    assert "é" in lines[0]                                            # not ASCII-escaped
    SC.write_partitioned(_items(spark), out + "/part", "2026-12-02")
    assert os.path.isdir(out + "/part/host=s1.example/run_date=2026-12-02")


def test_report_record(spark):
    res = results_from_events(read_table(spark, SF, "events"))
    dim = dimension(spark, res)
    rec = report_record(res, dim, "2026-12-02T10:00:00")
    row = rec.collect()[0]
    assert row.metadata.total_tests == res.count()
    assert row.metadata.planned_tests == 2 * row.metadata.total_websites
    assert set(row.summary_statistics.mode_comparison) <= {"browser", "non_browser"}
    assert row.metadata.test_run_date == "2026-12-02T10:00:00"


def test_whole_report(spark, tmp_path):
    res = results_from_events(read_table(spark, SF, "events"))
    dim = dimension(spark, res)
    SC.write_report(res, dim, str(tmp_path / "r"), "2026-12-02")
    rec = json.loads(next(ln for f in os.listdir(tmp_path / "r/report") if f.endswith(".json") for ln in open(tmp_path / "r/report" / f)))
    assert rec["metadata"]["test_run_date"] == "2026-12-02" and set(rec) >= {"summary_statistics", "detailed_results", "test_websites"}
    assert spark.read.json(str(tmp_path / "r" / rec["detailed_results"])).count() == res.count() == rec["metadata"]["total_tests"]
    assert spark.read.json(str(tmp_path / "r" / rec["test_websites"])).count() == dim.count() == rec["metadata"]["total_websites"]


def _many(spark, n, hot):
    rows = [("hot" if i < hot else f"s{i % 7}", i // 3, i % 3, f"t{i}", "é" * (i % 50) * 20, "blog", f"https://{'hot' if i < hot else f's{i % 7}'}.example/{i}")
            for i in range(n)]
    return spark.createDataFrame(rows, "site string, ord long, part int, title string, content string, content_type string, source_url string")


@pytest.mark.parametrize("page_bytes", [1, 5000, 10**9])
def test_pages_hold_the_whole_list(spark, page_bytes):
    items = _many(spark, 600, 200).repartition(5)
    sites = items.select("site").distinct().unionByName(spark.createDataFrame([("empty",)], "site string"))
    whole = {r.site: r.items for r in SC.nest(sites, items).collect()}
    pages = sorted(SC.nest_pages(sites, items, page_bytes).collect(), key=lambda r: (r.site, r.page))
    joined = {}
    for r in pages:
        before = joined.setdefault(r.site, [])
        assert r.page == 1 + sum(p.site == r.site and p.page < r.page for p in pages)
        size = [sum(len(x.encode()) for x in i) for i in r.items]
        assert not size or sum(size[:-1]) < page_bytes
        before += r.items
    assert joined == whole and joined["empty"] == []


def test_files_follow_the_bytes_of_a_host(spark, tmp_path):
    """A hot host is split over files, small ones are one file each."""
    items = _many(spark, 6000, 5000).withColumn("content", F.concat("content", F.sha2("title", 512), F.sha2("source_url", 512)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as they are, slots stay tasks of their own
    try:
        SC.write_partitioned(items.repartition(8), str(tmp_path / "o"), "2026-12-02", file_bytes=300_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {h: sum(f.endswith(".json") for f in os.listdir(tmp_path / "o" / h / "run_date=2026-12-02")) for h in os.listdir(tmp_path / "o") if h.startswith("host=")}
    assert 1 < files.pop("host=hot.example") <= 20 and set(files.values()) == {1} and len(files) == 7
    assert spark.read.json(str(tmp_path / "o")).count() == 6000


def test_rejected_requests(spark):
    rows = spark.createDataFrame([(1, " "), (2, None), (3, "a.example"), (4, "\t\n")], "n int, url string")
    assert sorted((r.n, r.error) for r in SC.rejected_requests(rows).collect()) == [(i, "URL is required") for i in (1, 2, 4)]
    accepted = SC.api_request_sites(rows.withColumns({"max_items": F.lit(50), "use_browser": F.lit(None).cast("boolean")}))
    assert [(r.site, r.max_items) for r in accepted.collect()] == [("https://a.example", 20)]
