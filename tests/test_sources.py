"""Literal XML / robots / JSON fixtures for the archive scans."""

from pyspark.sql import functions as F

from sitesift.operators import discover as D


def _docs(spark, rows):
    return spark.createDataFrame(rows, "site string, domain string, probe_idx int, body string")


def test_sitemap_urlset_and_dates(spark):
    entries = "".join(
        f"<url><loc>https://s.example/blog/p{i}</loc><lastmod>{d}</lastmod></url>"
        for i, d in enumerate(["2024-01-05", "2024-1-5", "2024-02-31", "2024-03-01T10:00:00Z", "", "2023-12-31"])
    )
    body = f'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{entries}</urlset>'
    docs = _docs(spark, [("s", "s.example", 0, body), ("s", "s.example", 1, "<urlset><url><loc>broken")])
    ent = D.parse_sitemap(docs, ["site", "domain", "probe_idx"]).where("kind = 'url'").orderBy("pos").collect()
    assert [r.loc for r in ent] == [f"https://s.example/blog/p{i}" for i in range(6)]
    assert [str(r.lastmod) if r.lastmod else None for r in ent] == [
        "2024-01-05", "2024-01-05", None, "2024-03-01", None, "2023-12-31"]
    ranked = D.sitemap_entries(D.parse_sitemap(docs, ["site", "domain", "probe_idx"]), ["site", "probe_idx"])
    order = [r.loc for r in ranked.orderBy("rank").collect()]
    # newest first, ties in document order, missing dates last
    assert order == ["https://s.example/blog/p3", "https://s.example/blog/p0", "https://s.example/blog/p1",
                     "https://s.example/blog/p5", "https://s.example/blog/p2", "https://s.example/blog/p4"]


def test_sitemap_caps(spark):
    many = "".join(f"<url><loc>https://s.example/blog/p{i}</loc></url>" for i in range(2100))
    idx = "<sitemapindex>" + "".join(f"<sitemap><loc>https://s.example/s{i}.xml</loc></sitemap>" for i in range(4)) + "</sitemapindex>"
    docs = _docs(spark, [("s", "s.example", 0, "<urlset>" + many + "</urlset>"), ("s", "s.example", 1, idx)])
    ent = D.parse_sitemap(docs, ["site", "domain", "probe_idx"])
    assert ent.where("kind = 'url'").count() == 2100          # no limit by default
    assert ent.where("kind = 'child'").count() == 4
    assert D.sitemap_entries(ent, ["site", "probe_idx"]).count() == 2100
    ent = D.parse_sitemap(docs, ["site", "domain", "probe_idx"], D.SINGLE_SITE)
    assert ent.where("kind = 'url'").count() == 2000          # W5: first 2,000 tags
    assert ent.where("kind = 'child'").count() == 3           # W4: first 3 children
    assert D.sitemap_entries(ent, ["site", "probe_idx"], D.SINGLE_SITE).count() == 100   # W3: newest 100


def test_robots_lines(spark):
    body = "User-agent: *\nSitemap: https://s.example/a.xml\nSITEMAP:https://s.example/b.xml\n Sitemap: no\nsitemap: https://s.example/c.xml?x=1:2\n"
    docs = _docs(spark, [("s", "s.example", 0, body)])
    got = [r.loc for r in D.robots_sitemaps(docs, ["site"]).orderBy("line_no").collect()]
    assert got == ["https://s.example/a.xml", "https://s.example/b.xml", "https://s.example/c.xml?x=1:2"]


def test_feeds_rss_and_atom(spark):
    rss = ('<rss version="2.0"><channel><item><link>https://o.example/x</link></item><item><title>n</title></item>'
           '<item><guid>https://o.example/g</guid></item><item><guid isPermaLink="false">123</guid></item></channel></rss>')
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="https://s.example/y"/></entry>'
            '<entry><link rel="edit" href="https://s.example/e"/><link rel="alternate" href="https://s.example/z"/></entry></feed>')
    rdf = '<RDF><channel><title>t</title></channel><item><link>https://r.example/i</link></item></RDF>'
    probes = spark.createDataFrame([("s", "feed", 0, rss), ("s", "feed", 1, atom), ("s", "feed", 2, rdf)], "site string, role string, probe_idx int, body string")
    got = sorted(r.url for r in D.discover_feeds(probes).collect())
    assert got == ["https://o.example/g", "https://o.example/x", "https://r.example/i", "https://s.example/y", "https://s.example/z"]


def test_index_chain_and_json_nesting_have_no_depth_limit(spark):
    urls = [("https://s.example/sitemap.xml", "<sitemapindex><sitemap><loc>https://s.example/1.xml</loc></sitemap></sitemapindex>")]
    urls += [(f"https://s.example/{i}.xml", f"<sitemapindex><sitemap><loc>https://s.example/{i + 1}.xml</loc></sitemap>"
              "<sitemap><loc>https://s.example/sitemap.xml</loc></sitemap></sitemapindex>") for i in range(1, 6)]
    urls += [("https://s.example/6.xml", "<urlset><url><loc>https://s.example/blog/deep</loc></url></urlset>")]
    fetches = spark.createDataFrame([(u, 200, b, None, None) for u, b in urls],
                                    "url string, status int, body string, rendered_html string, render_error string")
    sites = spark.createDataFrame([("s", "https://s.example/")], "site string, base_url string")
    got = D.discover_sitemaps(D.lookup(D.probe_table(sites), fetches), fetches).select("url").distinct().collect()
    assert [r.url for r in got] == ["https://s.example/blog/deep"]

    body = '{"a":' * 9 + '[{"url":"/blog/deep"}]' + "}" * 9
    api = spark.createDataFrame([("https://s.example/api/x", 200, "application/json", body)],
                                "url string, status int, content_type string, body string")
    assert [r.url for r in D.api_payload_urls(api, sites).collect()] == ["https://s.example/blog/deep"]


def test_generators_push_no_computed_test_to_the_scan(spark):
    from sitesift.plans.catalog import queries

    for name in ("c2_c3_chunk_2000", "h1_links", "p5_spa_urls", "p3_nav_sections", "p6_extract"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter ((size(" not in plan and "Filter (size(" not in plan, name


def test_json_payload_urls(spark):
    body = ('{"a":{"url":"/blog/x","slug":{"url":"/blog/no"}},"items":[{"href":"/p/1/2"},{"link":5}],'
            '"path":"https://other.example/blog/z","meta":{"link":"/about/team"}}')
    fetches = spark.createDataFrame([("https://s.example/api/posts", 200, "application/json", body)],
                                    "url string, status int, content_type string, body string")
    sites = spark.createDataFrame([("s", "https://s.example/")], "site string, base_url string")
    got = sorted(r.url for r in D.api_payload_urls(fetches, sites).collect())
    assert got == ["https://s.example/blog/x", "https://s.example/p/1/2"]


def test_json_payloads_of_other_hosts(spark):
    """Responses of API hosts count for the site whose page asked for them."""
    rows = [("https://api.s.example/v1", "https://s.example/", '{"url":"/blog/sub"}'),
            ("https://cdn.example/data.json", "https://s.example/", '[{"href":"/blog/cdn"},{"href":"https://cdn.example/blog/no"}]'),
            ("https://api.s.example/v2", "https://t.example/x", '{"url":"/blog/t"}'),
            ("https://s.example/api/own", None, '{"url":"/blog/own"}'), ("https://api.s.example/v3", None, '{"url":"/blog/nobody"}')]
    fetches = spark.createDataFrame([(u, 200, "application/json", p, b) for u, p, b in rows],
                                    "url string, status int, content_type string, page_url string, body string")
    sites = spark.createDataFrame([("s", "https://s.example/"), ("t", "https://t.example/")], "site string, base_url string")
    got = sorted((r.site, r.url) for r in D.api_payload_urls(fetches, sites).collect())
    assert got == [("s", "https://s.example/blog/cdn"), ("s", "https://s.example/blog/own"), ("s", "https://s.example/blog/sub"),
                   ("t", "https://t.example/blog/t")]


def test_rank_candidates(spark):
    rows = [("s", "https://s.example/a", "spa", None), ("s", "https://s.example/a", "sitemap", "2024-01-01"),
            ("s", "https://s.example/b", "sitemap", "2024-02-01"), ("s", "https://s.example/c", "feed", None)]
    df = spark.createDataFrame(rows, "site string, url string, source string, lastmod string").withColumn(
        "lastmod", F.to_date("lastmod"))
    got = [(r.url, r.source, r.ord) for r in D.rank_candidates(df).orderBy("ord").collect()]
    assert got == [("https://s.example/b", "sitemap", 1), ("https://s.example/a", "sitemap", 2), ("https://s.example/c", "feed", 3)]


def test_index_child_stop(spark):
    """W6 with nested indexes: children 0 and 1 bring 900 URLs each, so child 2 is not read."""
    def leaf(tag):
        return "<urlset>" + "".join(f"<url><loc>https://s.example/blog/{tag}-{i}</loc></url>" for i in range(150)) + "</urlset>"

    def index(locs):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"

    docs = {"https://s.example/sitemap.xml": index([f"https://s.example/c{a}.xml" for a in range(3)])}
    for a in range(3):
        docs[f"https://s.example/c{a}.xml"] = index([f"https://s.example/c{a}{b}.xml" for b in range(3)])
        for b in range(3):
            docs[f"https://s.example/c{a}{b}.xml"] = index([f"https://s.example/c{a}{b}{c}.xml" for c in range(3)])
            for c in range(3):
                docs[f"https://s.example/c{a}{b}{c}.xml"] = leaf(f"{a}{b}{c}")
    fetches = spark.createDataFrame([(u, 200, b, None, None) for u, b in docs.items()],
                                    "url string, status int, body string, rendered_html string, render_error string")
    probes = spark.createDataFrame([("s", "s.example", "sitemap", 0, "https://s.example/sitemap.xml",
                                     docs["https://s.example/sitemap.xml"])],
                                   "site string, domain string, role string, probe_idx int, url string, body string")
    got = D.discover_sitemaps(probes, fetches, D.SINGLE_SITE)
    urls = [r.url for r in got.collect()]
    assert len(urls) == 1800
    assert not any("/blog/2" in u for u in urls)
