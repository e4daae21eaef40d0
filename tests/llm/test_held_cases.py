"""Queries against their SQL on inputs that hold what the small tables lack:
listed pages, linked vectors, certified rejections, revisits."""

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle_harness import compare
from sitesift.llm.common import read
from sitesift.llm.queries import oracle_sql, queries

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def against_sql(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        path = f"{folder}/{t}.parquet"
        try:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if str(folder) not in (SMALL, LARGE) else ''}')")
        except duckdb.IOException:
            pass  # a table that the query does not read
    df = queries()[name](spark, str(folder)).cache()
    r = compare(df, con, oracle_sql()[name])
    assert r["cols_match"] and r["values_match"], r["first_diff"]
    return df


def test_listed_pages_are_blocked(spark):
    df = against_sql(spark, "op2_url_filter", LARGE)
    assert df.where("verdict = 'block' and rule is null").count() > 5


def test_certified_cutoffs_reject(spark):
    df = against_sql(spark, "op5_quality_rules", LARGE)
    assert df.where("not base_failed and not kept").count() > 100


def test_near_vectors_are_linked(spark, tmp_path):
    e = read(spark, SMALL, "embeddings")
    vector = next(f.name for f in e.schema if "array" in f.dataType.simpleString())
    near = e.where("vec_id % 3 = 0").withColumns({
        "vec_id": F.col("vec_id") + 1_000_000,
        vector: F.transform(vector, lambda x, i: (x * F.when(i % 7 == 0, 1.02).otherwise(1.0)).cast(e.schema[vector].dataType.elementType)),
    })
    e.unionByName(near).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = against_sql(spark, "op4_embedding_dedup", tmp_path)
    assert df.where("n_links > 0").count() >= 2 * near.where("label is not null").count() * 0.9
    assert df.where("not kept").count() > 0


def test_equal_payloads_are_revisits(spark, tmp_path):
    p = read(spark, SMALL, "pages")
    again = p.where("page_id % 2 = 0").withColumn("page_id", F.col("page_id") + 10_000)
    empty = p.where("page_id < 3").withColumns({"page_id": F.col("page_id") + 20_000, "html": F.lit(None).cast("string")})
    p.unionByName(again).unionByName(empty).write.parquet(str(tmp_path / "pages.parquet"))
    df = against_sql(spark, "op7_warc_round_trip", tmp_path)
    assert df.where("record_type = 'revisit'").count() == again.count() + empty.count() - 1
    assert df.where("payload_bytes = 0").count() == empty.count()
