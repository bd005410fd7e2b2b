"""What a worker holds does not follow the size of Spark's batch or of an archive's index; texts are moved once."""

import io
import tracemalloc

import pyarrow as pa
import pytest

from inkspan.plans import queries
from inkspan.plans.corpus import facts
from inkspan.sources import archives, shards


def test_split_holds_a_few_texts_at_a_time():
    class Aps:
        def alias(self, _):
            return self

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            text = "<?xml version='1.0'?><a>" + "x" * 500000 + "</a>"
            batch = pa.RecordBatch.from_pydict({"file": [str(i) for i in range(60)], "text": [text] * 60, "aps": [False] * 60})
            tracemalloc.start()
            assert sum(b.num_rows for b in run(iter([batch]))) == 60
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return peak

    assert archives.split(Files(), Aps()) < 12 << 20


@pytest.mark.parametrize("end", ["", "\n", "\r\n\n"])
def test_index_in_pieces_says_what_the_whole_says(end):
    lines = [f"clé{i}\t{i * 7}\t7" for i in range(50)]
    text = "\n".join(lines[:25]) + "\r\n\n" + "\n".join(lines[25:]) + end
    whole = shards.parse_index("s", text)
    for most in (1, 3, 64, 1 << 20):
        pieces = list(shards._index_chunks(io.BytesIO(text.encode()), most))
        assert [r for first, t in pieces for r in shards.parse_index("s", t, first)] == whole and len(whole) == 50
    bad = [*lines[:30], "no"]
    with pytest.raises(shards.IndexError_, match="line 31:"):
        for first, t in shards._index_chunks(io.BytesIO("\n".join(bad).encode()), 16):
            shards.parse_index("s", t, first)


def test_texts_are_moved_by_doc_id_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert len(joins) >= 6 and all("doc_id" in x for x in joins[:2]) and "p_partkey" not in "".join(joins[:2])


def test_manifests_need_no_key(spark, monkeypatch):
    monkeypatch.setattr(queries.C, "doc_key", None)
    assert queries.manifest_lines(spark, "/root/testdata/sf0.001").count() == 8
