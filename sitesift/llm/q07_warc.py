"""Query op7: all pages through WARC archives and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read, scratch
from .registry import register
from .warc import read_archives, write_archives

SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM f
"""


@register("op7_warc_round_trip", SQL)
def op7_warc_round_trip(spark, sf_dir):
    """What the archives of all pages say about each page."""
    folder = scratch(spark, "warc")
    records = read_archives(spark, folder, write_archives(read(spark, sf_dir, "pages"), folder))
    return records.select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.split("refers_to", ":")[2].cast("long").alias("refers_to"),
    )
