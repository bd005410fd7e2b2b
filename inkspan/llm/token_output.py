"""Token-id files: fixed-size blocks of ids, shuffled into byte or bit planes, each plane compressed with zstandard.

A file: MAGIC, the blocks' planes one after another, an index and its place.
  index  zstd of: int64 n_blocks, n_ids, n_docs, plane count; int64 offsets of all planes (one more at the end,
         blocks in turn, planes within each); int64 doc_id, int64 n_tokens, uint8 "doc_id is null" of each document
  tail   int64 offset and int64 length of the index, MAGIC
Every block but the last holds BLOCK ids. An empty plane (offset equal to the next) is all zeros.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written
from .tokens import default_tokenizer, encoder, slices

MAGIC = b"INKTOK01"
BLOCK = 1 << 16


def shuffle_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of uint32 ids, lowest first."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if bits:
        planes = np.packbits((planes[:, None, :] >> np.arange(8, dtype=np.uint8)[None, :, None]) & 1, axis=2).reshape(32, -1)
    return [p.tobytes() if p.any() else b"" for p in planes]


def unshuffle_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((4, n), np.uint8)
    for k, p in enumerate(planes):
        if p and len(planes) == 32:
            out[k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8))[:n] << np.uint8(k % 8)
        elif p:
            out[k] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(out.T).view("<u4").reshape(-1)


class TokenFileWriter:
    def __init__(self, sink, bits: bool = False, level: int = 3):
        import zstandard

        self.sink, self.bits, self.zstd = sink, bits, zstandard.ZstdCompressor(level=level)
        self.offsets, self.at, self.blocks, self.n = [], len(MAGIC), 0, 0
        self.docs: list[tuple] = []
        self.rest: list[np.ndarray] = []
        self.held = 0
        sink.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        for p in shuffle_planes(ids, self.bits):
            data = self.zstd.compress(p) if p else b""
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.blocks += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.rest.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= BLOCK:
            whole = np.concatenate(self.rest)
            for i in range(0, len(whole) - BLOCK + 1, BLOCK):
                self._block(whole[i : i + BLOCK])
            self.rest = [whole[len(whole) // BLOCK * BLOCK :]]
            self.held = len(self.rest[0])

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        head = np.array([self.blocks, self.n, len(self.docs), 32 if self.bits else 4], "<i8")
        ids = np.array([x or 0 for x, _ in self.docs], "<i8")
        index = self.zstd.compress(b"".join([head.tobytes(), np.array([*self.offsets, self.at], "<i8").tobytes(), ids.tobytes(), np.array([n for _, n in self.docs], "<i8").tobytes(), bytes(x is None for x, _ in self.docs)]))
        self.sink.write(index + np.array([self.at, len(index)], "<i8").tobytes() + MAGIC)


class TokenFileReader:
    """Opens any seekable file; holds the index, reads one block at a time."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        source.seek(source.tell() - 24)
        tail = source.read(24)
        if tail[16:] != MAGIC:
            raise ValueError("not a token file, or cut off")
        at, length = np.frombuffer(tail[:16], "<i8").tolist()
        source.seek(at)
        index = self.zstd.decompress(source.read(length))
        self.blocks, self.n, n_docs, self.planes = np.frombuffer(index[:32], "<i8").tolist()
        rest = np.frombuffer(index[32 : 32 + 8 * (self.blocks * self.planes + 1 + 2 * n_docs)], "<i8")
        self.offsets, self.doc_ids, self.lengths = np.split(rest, [self.blocks * self.planes + 1, self.blocks * self.planes + 1 + n_docs])
        self.null = np.frombuffer(index[len(index) - n_docs :], np.uint8) if n_docs else np.zeros(0, np.uint8)

    def block(self, k: int) -> np.ndarray:
        at = self.offsets[k * self.planes : (k + 1) * self.planes + 1].tolist()
        self.source.seek(at[0])
        data = self.source.read(at[-1] - at[0])
        planes = [self.zstd.decompress(data[a - at[0] : b - at[0]]) if b > a else b"" for a, b in zip(at, at[1:])]
        return unshuffle_planes(planes, min(BLOCK, self.n - k * BLOCK))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, ids) in the order written."""
        buffer, k, start = np.zeros(0, np.uint32), 0, 0
        for doc_id, n, null in zip(self.doc_ids.tolist(), self.lengths.tolist(), self.null.tolist()):
            parts, have = [buffer], len(buffer)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            buffer = np.concatenate(parts) if len(parts) > 1 else buffer
            yield None if null else doc_id, start, buffer[:n]
            buffer, start = buffer[n:], start + n


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, bits: bool = False, partitions: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) as token files under path, in ascending doc_id order; returns the written manifest.

    Documents are dealt out by ranges of doc_id, sorted within a task (nulls first, equal ids by text), encoded in
    streaming fashion, and written to one file for each task under a name of its attempt; the manifest (part, file,
    n_docs, n_ids) names the files of the attempts that were committed, so lost or repeated tasks leave no trace.
    Null text: empty. Empty table: no documents.
    """
    tok = tokenizer or default_tokenizer()
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    picked = docs.select("doc_id", "text")
    ranged = picked.repartitionByRange(partitions, *order[:1]) if partitions else picked.repartitionByRange(*order[:1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tok), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        writer = None
        with store.open_output_stream(f"{root}/{name}") as sink:
            writer = TokenFileWriter(sink, bits)
            for batch in slices(batches, "text"):
                ids, at = enc.encode(batch.column("text"))
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    writer.add(doc_id, np.append(ids[a:b], end_id).astype(np.uint32))
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n]})

    return written(ranged.sortWithinPartitions(*order).mapInArrow(run, "part int, file string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """Reads the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The files' starts are prefix sums over the manifest, which has one row for each file.
    """
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in sorted(manifest.collect()):
        rows.append((r.part, r.file, start))
        start += r.n_ids
    files = spark.createDataFrame(rows, "part int, file string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(f"{root}/{name}") as source:
                    out: list[tuple] = []
                    for doc_id, at, ids in TokenFileReader(source).documents():
                        out.append((doc_id, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 20_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    return files.repartition(max(1, len(rows)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op9_bit_plane_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), path), path)
