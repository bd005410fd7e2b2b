"""Data sources of Spark: weekly archives to read (`patent_archives`), sets of shard files to write (`patent_archive_set`)."""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .archives import archive_batches

#: What a shard consists of, in the order in which it is put in place; its manifest follows.
PARTS = (".zst", ".idx", ".biblio.jsonl", ".unsupported.tsv")
COUNTS = ("written", "Supplemental", "Unsupported", "Malformed")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the place in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def archive_list(path: str) -> list[tuple[str, str, str]]:
    """(path, shard, source_file) of all archives below path, or of the one at it, by path. FileNotFoundError if there is none.

    A shard is named as its archive without the ending; where several are named so, by the path below, too, so that equal
    names in different folders stay apart."""
    store, root = opened(path)
    info = store.get_file_info(root)
    found = store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
    paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))
    if not paths:
        raise FileNotFoundError(f"no .zip files found in '{path}'")
    below = [p[len(root) :].lstrip("/") or p.rsplit("/", 1)[-1] for p in paths]
    shards = [p.rsplit("/", 1)[-1][:-4] for p in paths]
    for longer in ([p[:-4] for p in below], below):
        seen = Counter(shards)
        shards = [s if seen[s] == 1 else x for s, x in zip(shards, longer)]
    return [(p, s, p.rsplit("/", 1)[-1]) for p, s in zip(paths, shards)]


class ArchiveReader(DataSourceReader):
    """One partition an archive, which a task opens by its path and reads as a stream."""

    def __init__(self, options) -> None:
        self.path, self.headers = options["path"], options.get("headers", "false").lower() == "true"
        self.limit = int(options["limit"]) if "limit" in options else None
        self.only = set(json.loads(options["only"])) if "only" in options else None

    def partitions(self) -> list[InputPartition]:
        some = [a for a in archive_list(self.path) if self.only is None or a[1] in self.only]
        return [InputPartition(a) for a in some] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, shard, name = partition.value
        store, _ = opened(self.path)
        with store.open_input_file(path) as f:
            yield from archive_batches((path, shard, name), f, self.limit, self.headers)


class ArchiveSource(DataSource):
    """Records of all *.zip files below a path: path, shard, source_file, ordinal, raw, error.

    The first entry of an archive that is named as XML or tagged text is read, as UTF-8 or else Latin-1. limit: reading stops
    after so many records of an archive that can be parsed. headers: a row without ordinal and raw comes first for each
    archive, so that empty ones are seen. only: a JSON list of shards; no other archive is opened. An archive that can't be
    opened is a row with an error.

    Filters are not taken over from Spark: as of 4.1.2, a DataFrame of a Python data source keeps what one query's filter
    has left of its partitions, and the next query on the same DataFrame misses rows."""

    @classmethod
    def name(cls) -> str:
        return "patent_archives"

    def schema(self) -> str:
        return "path string, shard string, source_file string, ordinal int, raw string, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


class SetMessage(WriterCommitMessage):
    """The shards that a task has written: (name of the parts in the staging folder, shard, source_file, doc_kind, counts)."""

    def __init__(self, shards: list[tuple[str, str, str, str, dict[str, int]]]) -> None:
        self.shards = shards


class ArchiveSetWriter(DataSourceArrowWriter):
    """Tasks write into a staging folder, each attempt under names of its own; the commit moves what the successful ones have
    written into place, the manifest of each shard last. So failed and repeated tasks leave nothing, and a failed job leaves
    what was there before. A shard whose manifest is missing was being put in place when the driver was lost."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> SetMessage:
        store, root = opened(self.path)
        stage = f"{root}/{self.staging}"
        store.create_dir(stage, recursive=True)
        shards: list = []
        sinks: list = []
        offset = 0

        def close() -> None:
            for s in sinks:
                s.close()

        try:
            for b in iterator:
                for r in b.to_pylist():
                    if not shards or r["shard"] != shards[-1][1]:
                        close()
                        shards.append((uuid.uuid4().hex, r["shard"], r["source_file"], r["doc_kind"], dict.fromkeys(COUNTS, 0)))
                        sinks = [store.open_output_stream(f"{stage}/{shards[-1][0]}{p}", compression=None) for p in PARTS]
                        sinks[3].write(b"doc_key\treason\n")
                        offset = 0
                    count = shards[-1][4]
                    if r["frame"] is not None:
                        sinks[0].write(r["frame"])
                        sinks[1].write(f"{r['doc_key']}\t{offset}\t{len(r['frame'])}\n".encode())
                        sinks[2].write(f"{r['biblio']}\n".encode())
                        offset += len(r["frame"])
                        count["written"] += 1
                    elif r["skip"] is not None:
                        count[r["skip"]] += 1
                        if r["skip"] == "Unsupported":
                            sinks[3].write(f"{r['doc_key']}\t{r['reason']}\n".encode())
        finally:
            close()
        return SetMessage(shards)

    def commit(self, messages) -> None:
        store, root = opened(self.path)
        stage = f"{root}/{self.staging}"
        shards = [s for m in messages if m is not None for s in m.shards]
        twice = [s for s, n in Counter(x[1] for x in shards).items() if n > 1]
        if twice:
            store.delete_dir(stage)
            raise ValueError(f"rows of a shard in more than one task: {sorted(twice)[:3]}")
        exists = lambda p: store.get_file_info(p).type != fs.FileType.NotFound
        if self.overwrite and exists(root):
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.path != stage:
                    (store.delete_dir if f.type == fs.FileType.Directory else store.delete_file)(f.path)
        for own, shard, source, kind, count in shards:
            store.create_dir(f"{root}/{shard}".rsplit("/", 1)[0], recursive=True)
            for end in (".manifest.json", ".unsupported.tsv"):  # the old set ends here, and no old list stays beside the new
                if exists(f"{root}/{shard}{end}"):
                    store.delete_file(f"{root}/{shard}{end}")
            for end in PARTS if count["Unsupported"] else PARTS[:3]:
                store.move(f"{stage}/{own}{end}", f"{root}/{shard}{end}")
            fields = {"format_version": 1, "stem": shard, "source_file": source, "doc_kind": kind, "patents_written": count["written"]}
            fields |= {f"{k.lower()}_skipped": count[k] for k in COUNTS[1:]}
            with store.open_output_stream(f"{stage}/{own}.manifest.json") as out:
                out.write(json.dumps(fields, indent=2, ensure_ascii=False).encode())
            store.move(f"{stage}/{own}.manifest.json", f"{root}/{shard}.manifest.json")
        if exists(stage):
            store.delete_dir(stage)

    def abort(self, messages) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class ArchiveSet(DataSource):
    """Writes rows (shard, source_file, doc_kind, ordinal, doc_key, frame, biblio, skip, reason) as shards: .zst, .idx,
    .biblio.jsonl, .manifest.json and, if there is any, .unsupported.tsv. A shard's rows come in one task, in order; a
    row with neither frame nor skip only names its shard, so that it is written even if it is empty."""

    @classmethod
    def name(cls) -> str:
        return "patent_archive_set"

    def schema(self) -> str:
        return SET_SCHEMA

    def writer(self, schema, overwrite: bool) -> ArchiveSetWriter:
        return ArchiveSetWriter(self.options, overwrite)


SET_SCHEMA = "shard string, source_file string, doc_kind string, ordinal int, doc_key string, frame binary, biblio string, skip string, reason string"


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    for source in (ArchiveSource, ArchiveSet):
        spark.dataSource.register(source)
