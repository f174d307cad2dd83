"""Queries against their SQL on the smallest tables; REGISTRY=all runs every one."""

import os

import duckdb
import pytest

from subspark.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["pretok_vocab", "ngram_corpus", "cooc_window_1", "merge_contexts_filtered", "weighted_edges", "viterbi_maxmin", "expected_counts", "bigram_viterbi_words", "reduced_vocab"]
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_with_sql_is_registered():
    assert set(ORACLES) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("REGISTRY") == "all" else SOME)
def test_query_is_its_sql(spark, tables, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    expected = tables.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert len(got) > 0 and sorted(map(repr, got)) == sorted(map(repr, expected))


def test_halves_take_documents_with_negative_or_no_ids(spark, tmp_path):
    docs = [(i, "red green blue red") for i in (-3, -2, None, 1, 2)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 0.5]) for i in range(3)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.subword, r.word): r.n for r in registry.queries()["merge_contexts_sum"](spark, str(tmp_path)).collect()}
    assert got["bl", "red"] == 10 and got["gr", "blue"] == 5 and got["d", "green"] == 10


def test_stored_tables_go_at_the_end_of_a_block(spark):
    from pyspark.errors import AnalysisException

    from subspark.plans.store import stored, temporary

    outside = stored(spark.range(5), "kept")
    with temporary(spark):
        with temporary(spark):
            inner = stored(spark.range(7), "inner")
            assert inner.count() == 7
        again = stored(spark.range(3), "again")
        assert again.count() == 3
    assert outside.count() == 5
    for gone in (inner, again):
        path = gone.inputFiles()[0].rsplit("/", 1)[0]
        with pytest.raises(AnalysisException):
            spark.read.parquet(path).count()
