"""Archives of one zstandard frame per document with a tab-separated index, as sink and source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .scratch import kept, lean, slices

LEVEL = 9


class IndexError_(ValueError):
    """A line of an index that can't be read."""


#: So many characters of an index are read at once.
INDEX_CHUNK = 1 << 20


def parse_index(shard: str, text: str, first: int = 1) -> list[tuple[str, str, int, int]]:
    """(doc_key, shard, offset, length) of an index file, or of its lines from `first` on; errors name the line, from 1."""
    out = []
    for n, line in enumerate(text.splitlines(), first):
        if not (line := line.strip()):
            continue
        parts = line.split("\t")
        if len(parts) != 3 or not parts[0] or not all(p.isdigit() and p.isascii() for p in parts[1:]):
            raise IndexError_(f"{shard}.idx: line {n}: expected key, offset and length")
        out.append((parts[0], shard, int(parts[1]), int(parts[2])))
    return out


def compressed(df: DataFrame, text: str, frame: str) -> DataFrame:
    """df with the column text as a zstandard frame each, null where it is null, in its place. Map-only."""
    names = [frame if c == text else c for c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=LEVEL)
        for b in slices(batches, text):
            f = pa.array([None if t is None else z.compress(t.encode()) for t in b.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([f if c == text else b.column(c) for c in b.schema.names], names)

    fields = [StructField(frame, BinaryType()) if f.name == text else f for f in df.schema.fields]
    return df.mapInArrow(lean(run), StructType(fields))


def frames(docs: DataFrame) -> DataFrame:
    """docs (shard, ordinal, doc_key, text) with frame, offset and length within the shard."""
    d = docs.select("shard", F.col("ordinal").cast("int").alias("ordinal"), "doc_key", F.coalesce("text", F.lit("")).alias("text"))
    f = compressed(d, "text", "frame").withColumn("length", F.length("frame").cast("long"))
    before = Window.partitionBy("shard").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return f.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def write_shards(docs: DataFrame, path: str) -> DataFrame:
    """Writes <shard>.zst and <shard>.idx under path; returns shard, documents, bytes. A shard is written in order by one
    task, under a temporary name that is moved into place when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        now, sink, index, count, total, tmp, done = None, None, None, 0, 0, "", []

        def close() -> None:
            if now is None:
                return
            sink.close()
            index.close()
            store.create_dir(f"{root}/{now}".rsplit("/", 1)[0], recursive=True)
            store.move(tmp, f"{root}/{now}.zst")
            store.move(f"{tmp}.lines", f"{root}/{now}.idx")
            done.append((now, count, total))

        for b in slices(batches, "frame"):
            for shard, key, frame, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_key", "frame", "offset", "length"))):
                if shard != now:
                    close()
                    now, count, total, tmp = shard, 0, 0, f"{root}/.{uuid.uuid4().hex}"
                    sink, index = store.open_output_stream(tmp), store.open_output_stream(f"{tmp}.lines")
                sink.write(frame)
                index.write(f"{key}\t{offset}\t{length}\n".encode())
                count += 1
                total += length
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["shard", "documents", "bytes"])

    # the window over lengths has dealt the frames out by shard already
    return frames(docs).sortWithinPartitions("shard", "ordinal").mapInArrow(lean(run), "shard string, documents long, bytes long")


def placed_frames(docs: DataFrame, tasks: int) -> DataFrame:
    """docs (shard, ordinal, doc_key, text) as frames with part, length and offset within the shard, where no task has to see
    a whole shard: (shard, ordinal) is dealt out by ranges, parts are a task's stretch of a shard, and offsets are
    prefix sums within a part and over the parts (one row each)."""
    d = docs.select("shard", F.col("ordinal").cast("int").alias("ordinal"), "doc_key", F.coalesce("text", F.lit("")).alias("text"))
    f = compressed(d, "text", "frame").withColumn("length", F.length("frame").cast("long"))
    order = ["shard", "ordinal"]
    f = kept(f.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "frames")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = f.groupBy("shard", "part").agg(F.sum("length").alias("bytes")).withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    within = Window.partitionBy("shard", "part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("inner", F.coalesce(F.sum("length").over(within), F.lit(0)))
    return f.join(base.select("shard", "part", "base"), ["shard", "part"]).withColumn("offset", F.col("base") + F.col("inner")).drop("base", "inner")


def write_shards_in_parts(docs: DataFrame, path: str, tasks: int) -> DataFrame:
    """As write_shards(), byte for byte, with the frames of a shard written by several tasks: each writes its parts beside the
    shards, under names of its attempt, and a list of those that were committed; then the parts of a shard are put together
    in order, as bytes only. Returns shard, documents, bytes."""
    spark, stage = docs.sparkSession, f".parts-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(f"{root}/{stage}", recursive=True)
        done: list[list] = []
        sinks: list = []
        for b in slices(batches, "frame"):
            for shard, part, key, frame, offset in zip(*(b.column(c).to_pylist() for c in ("shard", "part", "doc_key", "frame", "offset"))):
                if not done or done[-1][:2] != [shard, part]:
                    for s in sinks:
                        s.close()
                    done.append([shard, part, uuid.uuid4().hex, 0, 0])
                    sinks = [store.open_output_stream(f"{root}/{stage}/{done[-1][2]}.{end}", compression=None) for end in ("frames", "idx")]
                sinks[0].write(frame)
                sinks[1].write(f"{key}\t{offset}\t{len(frame)}\n".encode())
                done[-1][3] += 1
                done[-1][4] += len(frame)
        for s in sinks:
            s.close()
        cols = list(zip(*done)) or [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["shard", "part", "file", "documents", "bytes"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        whole: dict[str, list[tuple]] = {}
        for b in batches:  # a row for each part
            for shard, *rest in zip(*(b.column(c).to_pylist() for c in ("shard", "file", "documents", "bytes"))):
                whole.setdefault(shard, []).append(rest)
        for shard, parts in whole.items():
            for old, end in (("frames", "zst"), ("idx", "idx")):
                tmp = f"{root}/{stage}/{uuid.uuid4().hex}"
                with store.open_output_stream(tmp, compression=None) as out:
                    for file, _, _ in parts:
                        with store.open_input_stream(f"{root}/{stage}/{file}.{old}", compression=None) as source:
                            while data := source.read(1 << 20):
                                out.write(data)
                store.create_dir(f"{root}/{shard}".rsplit("/", 1)[0], recursive=True)
                store.move(tmp, f"{root}/{shard}.{end}")
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([sum(p[1] for p in parts)], pa.int64()), pa.array([sum(p[2] for p in parts)], pa.int64())], ["shard", "documents", "bytes"])

    order = ["shard", "part"]
    placed = placed_frames(docs, tasks).repartition(tasks, *order).sortWithinPartitions(*order, "ordinal")
    parts = kept(placed.mapInArrow(write, "shard string, part int, file string, documents long, bytes long"), "shard-parts")
    done = kept(parts.repartition("shard").sortWithinPartitions(*order).mapInArrow(join, "shard string, documents long, bytes long"), "shards-joined")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{stage}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return done


def _index_chunks(f, most: int = INDEX_CHUNK) -> Iterator[tuple[int, str]]:
    """(number of the first line, text) of an open index in pieces that end where a line does."""
    import codecs

    decoder, rest, first, more = codecs.getincrementaldecoder("utf-8")(), "", 1, True
    while more:
        data = f.read(most)
        more = bool(data)
        rest += decoder.decode(data, not more)
        cut = rest.rfind("\n") + 1 if more else len(rest)
        if cut:
            yield first, rest[:cut]
            first, rest = first + len(rest[:cut].splitlines()), rest[cut:]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_key, shard, offset, length of all index files below path; a shard is named by its place below path."""
    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    names = sorted(f.path[len(root) :].strip("/")[:-4] for f in found if f.path.endswith(".idx"))  # names only; one an archive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for s in b.column("shard").to_pylist():
                with store.open_input_stream(f"{root}/{s}.idx") as f:
                    for first, text in _index_chunks(f):
                        cols = list(zip(*parse_index(s, text, first))) or [[]] * 4
                        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_key", "shard", "offset", "length"])

    listed = spark.createDataFrame([(n,) for n in names], "shard string").repartition(max(1, len(names)), "shard")
    return listed.mapInArrow(lean(run), "doc_key string, shard string, offset long, length long")


def read_documents(pointers: DataFrame, path: str) -> DataFrame:
    """Fetches only the frames pointed at: doc_key, text. A task opens each archive once and closes it at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from contextlib import ExitStack

        import zstandard

        store, root = fs.FileSystem.from_uri(path)
        z, handles = zstandard.ZstdDecompressor(), {}
        with ExitStack() as opened:
            for b in batches:
                out, size = [], 0
                for key, shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("doc_key", "shard", "offset", "length"))):
                    name = shard.strip()
                    if name not in handles:
                        handles[name] = opened.enter_context(store.open_input_file(f"{root}/{name}.zst"))
                    handles[name].seek(offset)
                    out.append((key, z.decompress(handles[name].read(length)).decode()))
                    size += len(out[-1][1])
                    if size > 8 << 20:
                        yield _texts(out)
                        out, size = [], 0
                yield _texts(out)

    return pointers.select("doc_key", "shard", "offset", "length").mapInArrow(run, "doc_key string, text string")


def _texts(out: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())], ["doc_key", "text"])


def lookup_many(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The first document of each key in keys (doc_key); keys that are nowhere have no row. The side that is small enough
    is broadcast by the optimizer; else both are dealt by key."""
    wanted = keys.select("doc_key").distinct()
    first = read_index(spark, path).join(wanted, "doc_key").groupBy("doc_key").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return read_documents(first.select("doc_key", "at.*"), path)


def lookup(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The first document of a key."""
    return read_documents(read_index(spark, path).where(F.col("doc_key") == key).orderBy("shard", "offset").limit(1), path)
