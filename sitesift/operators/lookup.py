"""Looking URLs up in an archive without moving the bodies nobody asked for.

The requested side is narrow and is measured first. A small one is broadcast,
and the archive is only scanned. A larger one becomes a bitmap, one bit per
hashed URL, which the archive's rows pass before anything is shuffled: of the
rows that nobody asked for, at most one in ``BITS_PER_URL`` gets by (more, if
the bitmap's own bound is reached). The join that follows is exact. An archive
table bucketed by URL (``write_archive``) is not shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Requests of at most so many rows and bytes of URLs are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16_000_000
BITS_PER_URL = 64
#: A bitmap has at most so many bits (64 MB); with less than MIN_BITS a URL it is no use.
MAX_BITS, MIN_BITS = 1 << 29, 4
_BUCKET = 8 * 4096  # bits of one bitmap row


def _bit(url: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(bits)) + 1


def asked_for(archive: DataFrame, requests: DataFrame, n: int, url: str = "url") -> DataFrame:
    """The rows of ``archive`` whose URL may be one of the ``n`` requested ones."""
    bits = min(MAX_BITS, max(_BUCKET, BITS_PER_URL * n))
    wanted = requests.select(_bit(F.col(url), bits).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("asked_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("asked_bits"))
    bit = _bit(F.col(url), bits)
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("asked_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    here = (F.bitmap_bucket_number(bit) == F.col("asked_bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return archive.join(F.broadcast(wanted), here, "left_semi")


def lookup_url(requests: DataFrame, archive: DataFrame, url: str = "url", *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner equi-join of the requests with the archive on ``url``."""
    n, size = requests.agg(F.count(url), F.coalesce(F.sum(F.octet_length(url)), F.lit(0))).first()
    if n <= broadcast_rows and size <= BROADCAST_BYTES:
        return archive.join(F.broadcast(requests), url)
    if MIN_BITS * n <= MAX_BITS:
        archive = asked_for(archive, requests, n, url)
    return requests.join(archive, url)


def write_archive(fetches: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Store fetches as a table bucketed and sorted by URL: later lookups shuffle requests only."""
    fetches.write.mode(mode).bucketBy(buckets, "url").sortBy("url").format("parquet").saveAsTable(table)


def read_archive(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
