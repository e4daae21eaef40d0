"""Extraction as a stream over newly archived fetch files.

New parquet files landing in an archive folder are read with
``readStream``; each micro-batch runs the same stateless extraction (P6) and
appends the items to a table. Exactly-once output comes from the file sink
plus the query checkpoint, kept under the session's ``spark.checkpoint.dir``
(a shared folder on a cluster). Dedup and chunking need the whole run's
hash counts (template detection), so they stay batch jobs over the item
table (``operators.dedup`` / ``operators.chunking``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.extract import extract, items_of
from ..session import checkpoint_dir


def extracted_stream(spark: SparkSession, archive_dir: str, schema, use_browser=False,
                     max_files_per_trigger: int = 64) -> DataFrame:
    """Streaming DataFrame of items from fetch files (schema of the fetch table)."""
    fetches = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(archive_dir)
    )
    return items_of(extract(fetches, use_browser=use_browser), keys=("site", "page_id", "url"))


def start_extraction(spark: SparkSession, archive_dir: str, schema, out_dir: str, name: str = "sitesift_extract",
                     use_browser=False, available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    ckpt = os.path.join(checkpoint_dir(spark), name)
    items = extracted_stream(spark, archive_dir, schema, use_browser)
    w = items.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.queryName(name).start()
