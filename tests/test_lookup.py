"""Lookups in an archive, numbering in groups, and the crawl archive over a page table."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitesift.operators import discover as D
from sitesift.operators.lookup import asked_for, lookup_url, read_archive, write_archive
from sitesift.operators.order import number_within
from sitesift.sources.crawl import KINDS, first_copies, site_archive


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "a")
    rows = spark.range(5000).select(F.concat(F.lit("https://h.example/p/"), "id").alias("url"), F.repeat(F.lit("body "), 200).alias("body"))
    rows.unionByName(spark.createDataFrame([(None, "no url")], "url string, body string")).write.parquet(path)
    return spark.read.parquet(path)


def requests_of(spark, n):
    rows = [(i, f"https://h.example/p/{i * 7}") for i in range(n)] + [(-1, None), (-2, "https://h.example/none"), (-3, "https://h.example/p/0")]
    return spark.createDataFrame(rows, "rid long, url string")


@pytest.mark.parametrize("n", [0, 3, 700])
@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_lookup_equals_join(spark, archive, n, broadcast_rows):
    requests = requests_of(spark, n)
    want = sorted((r.rid, r.url) for r in requests.join(archive, "url").collect())
    got = lookup_url(requests, archive, broadcast_rows=broadcast_rows)
    assert sorted((r.rid, r.url) for r in got.collect()) == want and got.where("body is null").isEmpty()


def test_rows_nobody_asked_for_stop_before_the_shuffle(spark, archive):
    requests = requests_of(spark, 100)
    passed = asked_for(archive, requests, requests.count())
    assert 101 <= passed.count() <= 100 + 5000 // 64 * 3
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "body" in plan
    # the only exchanges lie below the broadcast, which has no bodies
    assert all("body" not in line for line in plan.splitlines() if "Exchange" in line)


def test_archive_table_is_not_shuffled(spark, archive):
    write_archive(archive, "lookup_archive", 4)
    try:
        stored = read_archive(spark, "lookup_archive")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = lookup_url(requests_of(spark, 50), stored, broadcast_rows=0)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
        # one side is dealt out by URL: the requests
        assert sum("Exchange hashpartitioning(url" in line for line in plan.splitlines()) == 1
        assert joined.count() == 52 - 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS lookup_archive")


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_within_a_hot_group(spark, partitions):
    rng = random.Random(4)
    rows = [(("hot" if i % 3 else f"g{rng.randrange(40)}"), rng.choice([None, *range(50)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, a long, i long").repartition(partitions)
    order = [F.col("a").desc_nulls_last(), F.col("i")]
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = number_within(df, "g", order, "n")
    assert got.columns == ["g", "a", "i", "n"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert number_within(df.limit(0), "g", order, "n").count() == 0


def test_every_source_and_every_page(spark):
    """One site a kind and more, one of them large: all pages are found, each kind by its own way."""
    rows, hosts = [], [f"h{i}.example" for i in range(40)]
    for k, host in enumerate(hosts):
        for j in range(300 if k == 0 else 1 + k % 7):
            rows.append((len(rows), f"http{'s' * (k % 2)}://{host}/en/{j}?a=1&b={j}", f"<html>{host} {j}</html>"))
    rows += [(90_000, rows[5][1], "a later copy"), (90_001, "no host", "x"), (90_002, None, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert first_copies(pages).count() == len(rows) - 1
    sites, fetches = site_archive(pages, large=100, per_file=20)
    assert sites.count() == len(hosts) and fetches.groupBy("url").count().where("count > 1").isEmpty()
    maps = fetches.where("url like '%/maps/sitemap-%'").count()
    assert maps > 10  # the large site has many files
    candidates = D.discover(sites, fetches)
    found = {r.url for r in candidates.collect()}
    assert {r[1] for r in rows[:-3]} <= found
    by_source = {r.source for r in candidates.select("source").distinct().collect()}
    assert by_source == {"sitemap", "feed", "section", "spa", "navigation", "rendered"} and len(KINDS) == 8
