"""The queries against their SQL on the small tables, and the pipeline's stages against what they promise."""

import duckdb
import pytest

import corpus_pipeline
from oracle_harness import compare
from sitesift.llm.common import read, stage
from sitesift.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET temp_directory = ''")
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    r = compare(queries()[name](spark, SF), con, oracle_sql()[name])
    assert r["cols_match"] and r["rows"][0] == r["rows"][1] and r["values_match"], r["first_diff"]


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = read(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        out = stage(function(spark, docs, SF), f"test-{name}")
        seen[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    toxic = {r.doc_id for r in queries()["op6_toxicity"](spark, SF).where("predicted = 1").collect()}
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    assert kept == {r.doc_id for r in read(spark, SF, "documents").collect()} - toxic
    assert not seen["secrets"].where("text rlike 'AKIA[A-Z0-9]{12}|[0-9a-f]{32}'").count()
    assert seen["secrets"].count() == seen["near_duplicates"].count() <= len(kept)
    mixed = {r.doc_id for r in seen["mix"].collect()}
    assert mixed <= {r.doc_id for r in seen["secrets"].collect()}
    tokens = seen["packing"].groupBy("sequence_id").sum("length").collect()
    assert all(r[1] == 1024 or r[1] & (r[1] - 1) == 0 for r in tokens)
