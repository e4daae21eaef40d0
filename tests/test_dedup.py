"""Template/dedup fixtures (A2 thresholds, ties, representative) and properties."""

from pyspark.sql import functions as F

from sitesift.operators.dedup import deduplicate, template_hashes


def _items(spark, rows):
    return spark.createDataFrame(rows, "site string, ord long, title string, content string, content_type string, source_url string")


def _run(spark, contents, blog=True):
    url = "https://s.example/blog/{}" if blog else "https://s.example/{}"
    rows = [("s", i, f"t{i}", c, "blog", url.format(i)) for i, c in enumerate(contents)]
    return _items(spark, rows)


def test_thresholds(spark):
    assert template_hashes(_run(spark, ["T"] * 5 + [f"u{i}" for i in range(5)])).count() == 1     # n=10, 5 -> yes
    assert template_hashes(_run(spark, ["T"] * 4 + [f"u{i}" for i in range(6)])).count() == 0     # n=10, 4 -> no
    assert template_hashes(_run(spark, ["T"] * 4 + [f"u{i}" for i in range(7)])).count() == 1     # n=11, 4 -> yes
    assert template_hashes(_run(spark, ["T"] * 3 + ["a", "b"])).count() == 0                       # count must exceed 3


def test_tie_last_first_seen_wins(spark):
    got = deduplicate(_run(spark, ["A", "B", "A", "B", "A", "B", "A", "B"])).orderBy("ord").collect()
    # B (first seen second) is the template and dropped on blog URLs; A deduped to its first row
    assert [(r.ord, r.content) for r in got] == [(0, "A")]


def test_all_template_representative(spark):
    got = deduplicate(_run(spark, ["T"] * 5)).collect()
    assert [(r.ord, r.title) for r in got] == [(0, "[Template Content] t0")]


def test_template_on_home_kept(spark):
    got = deduplicate(_run(spark, ["T"] * 5, blog=False)).collect()
    assert [(r.ord, r.title) for r in got] == [(0, "t0")]


def test_dedup_properties(spark):
    rows = [("s%d" % (i % 3), i, f"t{i}", f"c{i % 7}", "blog", f"https://x.example/blog/{i}") for i in range(60)]
    items = _items(spark, rows)
    out = deduplicate(items)
    # subset of the input (titles unchanged here) and idempotent
    assert out.join(items, ["site", "ord", "title", "content"], "left_anti").count() == 0
    again = deduplicate(out)
    assert sorted(again.select("site", "ord").collect()) == sorted(out.select("site", "ord").collect())
    # result independent of partitioning
    one = deduplicate(items.repartition(1)).select("site", "ord").collect()
    many = deduplicate(items.repartition(16, F.col("ord"))).select("site", "ord").collect()
    assert sorted(one) == sorted(many)
