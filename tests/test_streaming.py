"""The streaming extraction gives the same items as the batch job."""

import tempfile

from sitesift.operators.extract import extract, items_of
from sitesift.sources.archive import pages_as_fetches, read_table
from sitesift.streaming.archive_stream import start_extraction

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="sitesift-arch-")
    out = tempfile.mkdtemp(prefix="sitesift-items-")
    f = pages_as_fetches(read_table(spark, SF, "pages"))
    f.write.mode("overwrite").parquet(src + "/batch1")
    q = start_extraction(spark, src + "/batch1", f.schema, out, name="t_stream")
    q.awaitTermination(300)
    got = spark.read.parquet(out).select("page_id", "title", "content").collect()
    want = items_of(extract(f, use_browser=False), keys=("site", "page_id", "url")).select("page_id", "title", "content").collect()
    assert sorted(got) == sorted(want) and len(got) > 0
