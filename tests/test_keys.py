"""Lookups through the sorted index read the files that can hold their keys; joins of bucketed tables move no row."""

import uuid

import pytest
from pyspark.sql import functions as F

from inkspan.operators import joins
from inkspan.sources import keys, shards


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('shards')}"
    rows = [(f"s{k % 3}", k, f"K{k // 2:05d}", f"text {k}") for k in range(4000)] + [("s0", 9999, "é", "last"), ("s0", 9998, "", "no key")]
    shards.write_shards(spark.createDataFrame([r for r in rows if r[2]], "shard string, ordinal int, doc_key string, text string"), path).count()
    keys.write_key_index(spark, path, files=8)
    return path


def asked(spark, *some):
    return spark.createDataFrame([(k,) for k in some], "doc_key string")


def test_a_lookup_reads_one_file(spark, path):
    assert spark.read.parquet(f"{path}/{keys.CATALOG}").count() == 8
    found = keys.pointers(spark, path, asked(spark, "K01234"))
    assert len(found.inputFiles()) == 1 and found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(doc_key,K01234)]" in plan
    assert keys.files_for(spark, path, ["A", "L", "zz"]) == [] or len(keys.files_for(spark, path, ["A", "L", "zz"])) <= 1
    assert keys.pointers(spark, path, asked(spark, "A")).count() == 0
    assert len(keys.files_for(spark, path, ["K00000", "K01999", "é"])) == 2


@pytest.mark.parametrize("listed", [10_000, 1])
def test_lookups_find_the_first(spark, path, listed, monkeypatch):
    """As a list or by a join: first document of each key by shard and place, as the scan of all indexes finds it."""
    monkeypatch.setattr(keys, "LISTED", listed)
    some = asked(spark, "K00000", "K00001", "K01999", "K00001", "none", None, "é")
    got = sorted((r.doc_key, r.text) for r in keys.documents_of(spark, path, some).collect())
    assert got == sorted((r.doc_key, r.text) for r in shards.lookup_many(spark, path, some).collect()) and len(got) == 4
    assert dict(got)["K00000"] == "text 0" and dict(got)["é"] == "last"
    assert keys.documents_of(spark, path, some.where("false")).count() == 0


def test_bucketed_join_moves_nothing(spark, path, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    index = shards.read_index(spark, path)
    names = [f"{n}_{uuid.uuid4().hex}" for n in ("rows", "index")]
    try:
        rows = joins.write_bucketed(index.select("shard", "doc_key", F.col("offset").alias("at")), names[0], f"{tmp_path}/rows", buckets=4)
        both = joins.with_pointers(rows, joins.write_bucketed(index, names[1], f"{tmp_path}/index", buckets=4))
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert both.count() == joins.with_pointers(index.select("shard", "doc_key"), index).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            joins.drop_bucketed(spark, n)
