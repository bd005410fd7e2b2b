"""Record sources: single files, folders and weekly ZIP archives, split into records."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import lean, slices

_XML_START = re.compile(r"<\?xml\s.*?\?>\s*+(?:<!--.*?-->\s*+)*+<(?:!DOCTYPE\s*+[A-Za-z_]|[A-Za-z_])", re.S)
_XML_BYTES = re.compile(_XML_START.pattern.encode(), re.S)
#: So much of an entry is read at once, and so much of what was searched is searched again with the next part.
CHUNK, TAIL = 1 << 20, 1 << 10
_APS_START = re.compile(r"(?:^|(?<=[\r\n]))PATN[ \t]*+(?=\r|\n|\Z)", re.M)


def next_aps_record(text: str, start: int = 0) -> int | None:
    """Where the next tagged-text record begins, at or after start."""
    m = _APS_START.search(text, start)
    return m.start() if m else None


def split_records(text: str, aps: bool) -> Iterator[str]:
    """Records of a whole file; what is before the first is dropped, blank ones are passed over."""
    starts = [m.start() for m in (_APS_START if aps else _XML_START).finditer(text)]
    for a, b in zip(starts, [*starts[1:], len(text)]):
        if text[a:b].strip():
            yield text[a:b]


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def stream_records(entry: BinaryIO, aps: bool, chunk: int = CHUNK) -> Iterator[str]:
    """Records of an open entry as they are read. XML: only the record at hand is held, and each is decoded by itself;
    tagged text: the whole entry is decoded at once, as one byte decides for all of it."""
    if aps:
        yield from split_records(decode(entry.read()), True)
        return
    held, start, at = b"", None, 0
    while True:
        part = entry.read(chunk)
        held += part
        for m in _XML_BYTES.finditer(held, at):
            if start is not None:
                yield decode(held[start : m.start()])
            start, at = m.start(), m.end()
        if not part:
            break
        at = max(at, len(held) - TAIL)
        drop = at if start is None else start
        held, at, start = held[drop:], at - drop, None if start is None else 0
    if start is not None:
        yield decode(held[start:])


def is_aps_name(name: str) -> bool:
    base = name.rsplit("/", 1)[-1].lower()
    return base.startswith("pftaps") and base.endswith(".txt")


def _some(df: DataFrame, what: str, path: str) -> DataFrame:
    if not df.inputFiles():  # names only; nothing is read
        raise FileNotFoundError(f"no {what} files found in '{path}'")
    return df


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder's files named *.xml in any case, or one file: path, raw, error; in the order of paths. FileNotFoundError if
    there is none; a blank file is a row with an error."""
    files = _some(spark.read.text(path, wholetext=True, pathGlobFilter="*.[xX][mM][lL]"), ".xml", path)
    d = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return d.withColumn("error", F.when(F.col("raw").rlike(r"\A\s*+\z"), F.concat(F.lit("empty input '"), "path", F.lit("'")))).orderBy("path")


_ARCHIVE = "path string, shard string, source_file string, ordinal int, raw string, error string"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _ARCHIVE.split(", ")])


def _records(known: tuple[str, str, str], archive: BinaryIO, limit: int | None) -> Iterator[tuple]:
    """Rows of one archive, known as (path, shard, source_file). limit: it stops after so many records that can be parsed.
    What can't be opened: one error row."""
    try:
        with zipfile.ZipFile(archive) as z:
            entry = next((i.filename for i in z.infolist() if not i.is_dir() and (i.filename.endswith((".xml", ".XML")) or is_aps_name(i.filename))), None)
            if entry is None:
                yield *known, None, None, "No XML entry found in zip"
                return
            good = 0
            with z.open(entry) as f:
                for k, raw in enumerate(stream_records(f, is_aps_name(entry))):
                    yield *known, k, raw, None
                    if limit is not None:
                        good += _parses(raw)
                        if good >= limit:
                            return
    except (zipfile.BadZipFile, pa.ArrowInvalid, EOFError, OSError, NotImplementedError, RuntimeError) as e:
        yield *known, None, None, f"{type(e).__name__}: {e}"


def _parses(raw: str) -> bool:
    from .. import api

    return api.is_parsable(raw)


def archive_batches(known: tuple[str, str, str], archive: BinaryIO, limit: int | None = None, headers: bool = False, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of one archive. headers: the first has neither ordinal nor raw nor error."""
    held, size = [(*known, None, None, None)] if headers else [], 0
    for r in _records(known, archive, limit):
        held.append(r)
        size += len(r[4] or "")
        if size > most or len(held) == 200:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def read_archives(spark: SparkSession, path: str, limit: int | None = None, headers: bool = False, only: list[str] | None = None) -> DataFrame:
    """All *.zip files below path, or `only` those of some shards, as a DataFrame of the format patent_archives; see
    ArchiveSource. FileNotFoundError if there is none at all."""
    from .archive_format import ArchiveSource, archive_list, register

    register(spark)
    archive_list(path)  # FileNotFoundError here, not in a task
    given = {"headers": str(headers).lower(), "limit": limit, "only": None if only is None else json.dumps(only)}
    return spark.read.format(ArchiveSource.name()).options(**{k: v for k, v in given.items() if v is not None}).load(path)


def open_archives(paths: DataFrame, headers: bool = False) -> DataFrame:
    """paths (path): the records of these archives. Equal names are kept apart by their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        from pyarrow import fs

        for b in batches:
            for p in b.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(p)
                place = place if store.get_file_info(place).type != fs.FileType.NotFound else unquote(place)
                name = place.rsplit("/", 1)[-1]
                with store.open_input_file(place) as f:
                    yield from archive_batches((p, name[:-4], name), f, None, headers)

    return paths.select("path").mapInArrow(run, _ARCHIVE)


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """records (folder, name, entry, ordinal, raw) as ZIP archives <path>/<folder>/<name> of one entry each, its records in
    order; a null raw adds nothing. Returns the archives' paths. One task writes an archive, as a stream, under a temporary
    name that is moved into place when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        now, done, opened = None, [], []

        def close() -> None:
            for x in reversed(opened):
                x.close()
            if now is not None:
                store.move(done[-1][0], done[-1][1])
            opened.clear()

        for b in batches:
            for folder, name, entry, raw in zip(*(b.column(c).to_pylist() for c in ("folder", "name", "entry", "raw"))):
                if (folder, name) != now:
                    close()
                    now = folder, name
                    store.create_dir(f"{root}/{folder}", recursive=True)
                    done.append((f"{root}/{folder}/.{uuid.uuid4().hex}", f"{root}/{folder}/{name}"))
                    opened.append(store.open_output_stream(done[-1][0]))
                    opened.append(zipfile.ZipFile(opened[0], "w", zipfile.ZIP_DEFLATED))
                    opened.append(opened[1].open(entry, "w", force_zip64=True))
                opened[2].write((raw or "").encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in done], pa.string())], ["path"])

    dealt = records.select("folder", "name", "entry", "ordinal", "raw").repartition("folder", "name").sortWithinPartitions("folder", "name", "ordinal")
    return dealt.mapInArrow(run, "path string")


def split(files: DataFrame, aps) -> DataFrame:
    """files (file, text): file, ordinal, raw of the records in each text; aps: a column, whether it is tagged text. A worker
    holds a few texts at a time, whatever Spark's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for name, text, tagged in zip(*(b.column(c).to_pylist() for c in ("file", "text", "aps"))):
                rows = list(enumerate(split_records(text or "", bool(tagged))))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([k for k, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.string())], ["file", "ordinal", "raw"])

    return files.select("file", "text", aps.alias("aps")).mapInArrow(lean(run), "file string, ordinal int, raw string")
