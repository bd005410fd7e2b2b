"""One shard on several tasks is, byte for byte, what one task writes."""

from pathlib import Path

import pytest

from inkspan.sources import shards


@pytest.mark.parametrize("tasks", [1, 4, 50])
def test_parts_are_byte_equal(spark, tmp_path, tasks):
    rows = [("big", k, f"K{k}", "word " * (k % 97)) for k in range(1500)] + [("a/small", 0, "x", None), ("a/small", 7, "x", "é"), ("b", 3, "y", "")]
    docs = spark.createDataFrame(rows, "shard string, ordinal long, doc_key string, text string").repartition(5)
    (tmp_path / "one/a").mkdir(parents=True)
    one, many = f"file://{tmp_path}/one", f"file://{tmp_path}/many"
    want = sorted(map(tuple, shards.write_shards(docs, one).collect()))
    done = shards.write_shards_in_parts(docs, many, tasks)
    assert sorted(map(tuple, done.collect())) == want and [w[:2] for w in want] == [("a/small", 2), ("b", 1), ("big", 1500)]
    files = lambda top: {str(p.relative_to(top)): p.read_bytes() for p in Path(top).rglob("*") if p.is_file()}
    assert files(tmp_path / "one") == files(tmp_path / "many")
    placed = shards.placed_frames(docs, tasks)
    assert (placed.where("shard = 'big'").select("part").distinct().count() >= min(tasks, 4) - 1) and sorted(r.offset for r in placed.where("shard = 'b'").collect()) == [0]
    assert shards.write_shards_in_parts(docs.where("false"), many, tasks).count() == 0
