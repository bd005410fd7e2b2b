"""Archives as a data source, sets of shards as committed writes, and both as a stream."""

import json
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkspan.sources import archive_format, archives, shards, sinks
from inkspan.streaming import landing

GRANT = (
    '<?xml version="1.0"?><!DOCTYPE us-patent-grant SYSTEM "us-patent-grant-v47.dtd" []><us-patent-grant dtd-version="v4.7" file="US{n}.XML"><us-bibliographic-data-grant><publication-reference>'
    "<document-id><country>US</country><doc-number>{n}</doc-number><kind>B2</kind><date>20200101</date></document-id></publication-reference>"
    "<invention-title>T{n}</invention-title></us-bibliographic-data-grant></us-patent-grant>"
)
OTHER = '<?xml version="1.0"?><other/>'


def put(path, *records, entry="x.xml"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr(entry, "\n".join(records))


@pytest.fixture
def weeks(tmp_path):
    put(tmp_path / "in/a/ipg1.zip", GRANT.format(n=1), OTHER, GRANT.format(n=2))
    put(tmp_path / "in/b/ipg1.ZIP", GRANT.format(n=3))
    put(tmp_path / "in/ipg2.zip", OTHER, OTHER)
    put(tmp_path / "in/ipa3.zip")
    put(tmp_path / "in/pftaps4.zip", "PATN\nWKU  1\n", entry="pftaps4.txt")
    return f"file://{tmp_path}/in", f"file://{tmp_path}/out", tmp_path / "out"


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())


def test_equal_names_stay_apart(spark, weeks):
    source, _, _ = weeks
    rows = archives.read_archives(spark, source).select("shard", "source_file", "ordinal", "error").collect()
    assert sorted(r for r in rows if r.shard.endswith("ipg1")) == [("a/ipg1", "ipg1.zip", k, None) for k in range(3)] + [("b/ipg1", "ipg1.ZIP", 0, None)]
    assert {r.shard for r in rows} == {"a/ipg1", "b/ipg1", "ipg2", "pftaps4"}
    heads = archives.read_archives(spark, source, headers=True).where("ordinal IS NULL").collect()
    assert sorted(r.shard for r in heads) == ["a/ipg1", "b/ipg1", "ipa3", "ipg2", "pftaps4"] and all(r.raw is None and r.error is None for r in heads)
    assert archives.read_archives(spark, source, limit=1).where("shard = 'a/ipg1'").count() == 1


def test_names_that_differ_in_their_ending_only(tmp_path):
    for n in ("x.zip", "x.ZIP", "sub/y.zip"):
        put(tmp_path / n)
    assert [s for _, s, _ in archive_format.archive_list(str(tmp_path))] == ["y", "x.ZIP", "x.zip"]
    with pytest.raises(FileNotFoundError):
        archive_format.archive_list(str(tmp_path / "none"))


def test_only_wanted_archives_are_opened(spark, weeks):
    """A broken archive beside the wanted ones is never opened; else it gives an error row."""
    source, _, _ = weeks
    (Path(source[7:]) / "ipg9.zip").write_bytes(b"no archive")
    r = archives.read_archives(spark, source)
    assert [x.shard for x in r.where("error IS NOT NULL").collect()] == ["ipg9"] and r.rdd.getNumPartitions() == 6
    some = archives.read_archives(spark, source, only=["b/ipg1", "ipg2"])
    assert some.rdd.getNumPartitions() == 2 and some.where("shard = 'b/ipg1'").count() == 1 and some.count() == 3
    assert archives.read_archives(spark, source, only=["nowhere"]).count() == 0


def test_a_frame_is_used_again_after_a_filter(spark, weeks):
    r = archives.read_archives(spark, weeks[0])
    n = r.count()
    assert r.where("shard = 'ipg2'").count() == 2 and r.count() == n and r.where("shard = 'ipg2'").union(r).count() == n + 2


def test_sets_are_whole(spark, weeks):
    source, out, folder = weeks
    rows = sinks.write_archive_set(spark, source, out).collect()
    assert [tuple(r) for r in rows] == [
        ("a/ipg1", "ipg1.zip", "grant", 2, 0, 1, 0), ("b/ipg1", "ipg1.ZIP", "grant", 1, 0, 0, 0), ("ipa3", "ipa3.zip", "application", 0, 0, 0, 0),
        ("ipg2", "ipg2.zip", "grant", 0, 0, 2, 0), ("pftaps4", "pftaps4.zip", "grant", 1, 0, 0, 0),
    ]
    ends = (".biblio.jsonl", ".idx", ".manifest.json", ".zst")
    listed = {"a/ipg1", "ipg2"}
    assert names(folder) == sorted(f"{r.shard}{e}" for r in rows for e in (*ends, *([".unsupported.tsv"] if r.shard in listed else [])))
    assert (folder / "ipa3.zst").read_bytes() == b"" and json.loads((folder / "ipa3.manifest.json").read_text())["patents_written"] == 0
    assert (folder / "ipg2.unsupported.tsv").read_text().splitlines()[1:] == ["1\tsource detection failed: unsupported XML root 'other'", "2\tsource detection failed: unsupported XML root 'other'"]
    index = shards.read_index(spark, out)
    assert sorted((r.shard, r.doc_key) for r in index.collect()) == [("a/ipg1", "US1"), ("a/ipg1", "US2"), ("b/ipg1", "US3"), ("pftaps4", "1")]
    texts = {r.doc_key: r.text for r in shards.read_documents(index, out).collect()}
    assert "# T3" in texts["US3"] and len(texts) == 4


def test_a_new_set_ends_the_old_one(spark, weeks):
    """No list of unsupported records stays from a set before; shards that are not written again stay."""
    source, out, folder = weeks
    sinks.write_archive_set(spark, source, out)
    put(Path(source[7:]) / "ipg2.zip", GRANT.format(n=9))
    sinks.write_archive_set(spark, f"{source}/ipg2.zip", out)
    assert not (folder / "ipg2.unsupported.tsv").exists() and json.loads((folder / "ipg2.manifest.json").read_text())["patents_written"] == 1
    assert (folder / "a/ipg1.unsupported.tsv").exists()


def test_one_bad_archive_leaves_nothing(spark, weeks):
    source, out, folder = weeks
    (Path(source[7:]) / "ipg9.zip").write_bytes(b"no archive")
    with pytest.raises(ValueError):
        sinks.write_archive_set(spark, source, out)
    assert names(folder) == [] if folder.exists() else True


def _rows(*shards_):
    cols = list(zip(*[(s, f"{s}.zip", "grant", k, f"k{k}", f"frame{k}".encode(), "{}", None, None) for s in shards_ for k in range(3)]))
    kinds = [pa.string()] * 3 + [pa.int32(), pa.string(), pa.binary()] + [pa.string()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in archive_format.SET_SCHEMA.split(", ")])


def test_failed_and_repeated_tasks(tmp_path):
    """A task that breaks off, one that ran twice of which one counts, and a job that is given up."""

    def broken():
        yield _rows("ipg1")
        raise OSError("lost")

    out = tmp_path / "out"
    w = archive_format.ArchiveSetWriter({"path": str(out)}, False)
    with pytest.raises(OSError):
        w.write(broken())
    first, again, other = w.write(iter([_rows("ipg1")])), w.write(iter([_rows("ipg1")])), w.write(iter([_rows("ipg2", "sub/ipg3")]))
    assert first.shards[0][0] != again.shards[0][0]
    w.commit([again, None, other])
    assert names(out) == sorted(f"{s}{e}" for s in ("ipg1", "ipg2", "sub/ipg3") for e in (".biblio.jsonl", ".idx", ".manifest.json", ".zst"))
    assert (out / "ipg1.zst").read_bytes() == b"frame0frame1frame2" and (out / "ipg1.idx").read_text() == "k0\t0\t6\nk1\t6\t6\nk2\t12\t6\n"
    before = {n: (out / n).read_bytes() for n in names(out)}
    given_up = archive_format.ArchiveSetWriter({"path": str(out)}, False)
    given_up.abort([given_up.write(iter([_rows("ipg1", "ipg7")])), None])
    twice = archive_format.ArchiveSetWriter({"path": str(out)}, False)
    with pytest.raises(ValueError):
        twice.commit([twice.write(iter([_rows("ipg1")])), twice.write(iter([_rows("ipg1")]))])
    assert before == {n: (out / n).read_bytes() for n in names(out)}
    last = archive_format.ArchiveSetWriter({"path": str(out)}, True)
    last.commit([last.write(iter([_rows("ipg5")]))])
    assert {n.split(".")[0] for n in names(out)} == {"ipg5"}


def test_stream_has_each_record_once(spark, weeks, tmp_path):
    """A stream that breaks off within its second batch, and is started again."""
    source, out, folder = weeks
    flat = tmp_path / "landing"
    put(flat / "ipg1.zip", GRANT.format(n=1), OTHER)
    start = lambda: landing.write_archive_stream(spark, f"file://{flat}", out, f"file://{tmp_path}/checkpoint")
    start().awaitTermination(120)
    put(flat / "ipg2.zip", GRANT.format(n=2))
    (flat / "ipg3.zip").write_bytes(b"not yet whole")
    with pytest.raises(Exception, match="ipg3"):
        start().awaitTermination(120)
    assert {n.split("/")[0] for n in names(folder)} == {"batch-00000000"}
    put(flat / "ipg3.zip", GRANT.format(n=3))
    for _ in range(2):
        start().awaitTermination(120)
    assert sorted(r.doc_key for r in shards.read_index(spark, out).collect()) == ["US1", "US2", "US3"]
    assert sinks.read_manifests(spark, out).agg(F.sum("written"), F.sum("unsupported")).first() == (3, 1)
