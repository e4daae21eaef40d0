"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Fixed value: a word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def words(text: Column | str) -> Column:
    """Array of the words of a whole text; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def ascii_lower(text: Column | str) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=8)
def _ship(application: str) -> None:
    """Give the package to the Python workers of the application, once."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="sitesift-"), "sitesift.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    SparkContext.getOrCreate().addPyFile(path)


_listeners: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate table or file set, in the shared
    folder that ``spark.checkpoint.dir`` names; it lives as long as its user
    keeps it (all of one application lie under ``<application id>``)."""
    _ship(spark.sparkContext.applicationId)
    path = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    for paths in _listeners:
        paths.append(path)
    return path


@contextmanager
def scratch_of() -> Iterator[list[str]]:
    """The scratch folders named inside the block, for ``free``."""
    paths: list[str] = []
    _listeners.append(paths)
    try:
        yield paths
    finally:
        _listeners[:] = [x for x in _listeners if x is not paths]


def free(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch folders that nobody reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def file_row(docs: DataFrame, key: str = "doc_id") -> Column | None:
    """A name of every row of a table read from files, the same each time it
    is read: the key and the row's place. None where ``docs`` has no place; rows
    that a join or an explode repeats are not told apart."""
    if "_metadata" in docs.columns:
        return None
    place = [F.md5(F.col("_metadata.file_path")), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0")]
    try:
        docs.select(*place)
    except AnalysisException:
        return None
    first = F.coalesce(F.lpad(F.col(key).cast("string"), 20, "0"), F.lit("")) if key in docs.columns else F.lit("")
    return F.concat_ws(":", first, *place)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the
    lineage ends there, and a lost executor costs only its own tasks."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows whose texts a task turns into Python objects at once.
SLICE = 256
#: Words of more code points (or bytes) are not remembered by a task.
KEPT_CHARS = 256


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: a batch of Spark's holds
    many MB of texts, which need not all be Python objects at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (names differ beyond case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
