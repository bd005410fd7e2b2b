"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table
from .tokens import default_tokenizer, encoder, slices


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 1024
    loss: int = 2048


class VectorPacker:
    """Dot-product heuristic, bin by bin: the open bin takes the waiting item whose demand vector has the largest
    dot product with what is left of the bin. Items are held by size class, so a step looks at the distinct sizes.

    An item is (key, start, length, loss); loss-bearing tokens are its last ones. Where nothing fits whole, the
    largest item is cut to fill the bin, unless `cut` is off or less than `least` tokens would go into a piece.
    """

    def __init__(self, limits: Limits, cut: bool = True, least: int = 8):
        self.limits, self.cut, self.least = limits, cut, least
        self.items: list[list[tuple]] = []
        self.at: dict[tuple[int, int], int] = {}
        self.size = np.zeros((3, 64))
        self.count = np.zeros(64, np.int64)
        self.tokens = self.waiting = 0

    def add(self, key, start: int, length: int, loss: int) -> None:
        k = self.at.get((length, loss))
        if k is None:
            k = self.at[length, loss] = len(self.items)
            self.items.append([])
            if k >= len(self.count):
                self.size, self.count = np.concatenate([self.size, np.zeros_like(self.size)], 1), np.concatenate([self.count, np.zeros_like(self.count)])
            self.size[:, k] = length, 1, loss
        self.items[k].append((key, start, length, loss))
        self.count[k] += 1
        self.tokens += length
        self.waiting += 1

    def _take(self, k: int) -> tuple:
        self.count[k] -= 1
        item = self.items[k].pop()
        self.tokens -= item[2]
        self.waiting -= 1
        return item

    def bin(self) -> list[tuple]:
        """The next bin's items; empty when nothing waits."""
        full = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        left, out = full.copy(), []
        while self.waiting and left[0] > 0 and left[1] > 0:
            n = len(self.items)
            ok = (self.count[:n] > 0) & (self.size[0, :n] <= left[0]) & (self.size[2, :n] <= left[2])
            score = np.where(ok, (left / full**2) @ self.size[:, :n], -1)
            k = int(score.argmax())
            if score[k] >= 0:
                item = self._take(k)
            else:
                if not self.cut:
                    break
                k = int(np.where(self.count[:n] > 0, self.size[0, :n], -1).argmax())
                length, loss = int(self.size[0, k]), int(self.size[2, k])
                free = length - loss  # leading tokens without loss
                a = min(int(left[0]), free + int(left[2]), length - self.least)
                if a < self.least:
                    break
                key, start, length, loss = self._take(k)
                rest = min(loss, length - a)
                item = (key, start, a, loss - rest)
                self.add(key, start + a, length - a, rest)
            out.append(item)
            left -= (item[2], 1, item[3])
        if not out and self.waiting:
            raise ValueError("an item is larger than a bin and may not be cut")
        return out


def powers_of_two(items: list[tuple]) -> list[list[tuple]]:
    """The items of one bin, cut into bins whose sizes are the powers of two that its size adds up from."""
    n, out, queue = sum(x[2] for x in items), [], items[::-1]
    for b in reversed(range(n.bit_length())):
        if n >> b & 1:
            room, one = 1 << b, []
            while room:
                key, start, length, loss = queue.pop()
                if length > room:
                    rest = min(loss, length - room)
                    queue.append((key, start + room, length - room, rest))
                    length, loss = room, loss - rest
                one.append((key, start, length, loss))
                room -= length
            out.append(one)
    return out


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long"


def pieces(n: int, free: int, limits: Limits):
    """(start, length, loss) of n ids, of which the first `free` bear no loss, cut where a limit is reached."""
    a = 0
    while a < n:
        end = min(n, a + limits.tokens, max(a, free) + limits.loss)
        yield a, end - a, max(0, end - max(a, free))
        a = end


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), end_id: int = 1, with_ids: bool = False, pool: int = 1 << 20, prompt: str | None = None) -> DataFrame:
    """Packs every document's ids (with end_id) into sequences; one row per piece. Map-only: no shuffle.

    docs: doc_id, text (others are ignored). prompt: the column of a text whose ids go before and bear no loss, as in
    instruction data; without it, all ids bear loss. loss: how many ids of a piece do, its last ones. Each task packs its own partition from a pool of about `pool` waiting
    tokens, so memory is bounded and lost tasks rerun alone. Documents beyond a sequence are cut. A task's last,
    partly filled sequence is cut into sequences at powers of two, which need no padding. sequence_id: unique, the
    partition in the upper bits. Null text: empty, so one end id. Null doc_id: kept as null. Repeated rows: packed
    each. Empty table: no rows. with_ids adds `ids`, the piece's ids.
    """
    path = tokenizer or default_tokenizer()
    schema = _SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, ctx = encoder(path), VectorPacker(limits), TaskContext.get()
        base, made = ((ctx.partitionId() if ctx else 0) << 33), 0
        kept: dict[int, list] = {}  # key: [doc_id, ids, tokens not yet placed]
        rows: list[list] = []

        def emit(one: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for key, start, length, loss in one:
                doc = kept[key]
                ids = doc[1][start : start + length]
                rows.append([doc[0], start, length, zlib.crc32(ids.tobytes()), len(doc[1]), base + made, offset, loss, *([ids] if with_ids else [])])
                offset += length
                doc[2] -= length
                if not doc[2]:
                    del kept[key]
            made += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * (8 + with_ids)
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in cols[:8]] + ([pa.array([x.astype(np.int32) for x in cols[8]], pa.list_(pa.int32()))] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

        n = 0
        for batch in slices(batches, "text"):
            ids, at = enc.encode(batch.column("text"))
            before, first = enc.encode(batch.column(prompt)) if prompt else (ids[:0], np.zeros(batch.num_rows + 1, np.int64))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.concatenate([before[first[k] : first[k + 1]], ids[at[k] : at[k + 1]], [end_id]]).astype("<u4")
                kept[n] = [doc_id, own, len(own)]
                for piece in pieces(len(own), int(first[k + 1] - first[k]), limits):
                    if piece[1] == limits.tokens:
                        emit([(n, *piece)])
                    else:
                        packer.add(n, *piece)
                n += 1
            if packer.tokens > pool:
                while packer.tokens > pool // 4:
                    emit(packer.bin())
            if len(rows) > 5000:
                yield flush()
        while packer.waiting:
            one = packer.bin()
            used = sum(x[2] for x in one)
            for x in [one] if packer.waiting or used == limits.tokens else powers_of_two(one):
                emit(x)
        yield flush()

    return docs.select("doc_id", "text", *([prompt] if prompt else [])).mapInArrow(lean(run), schema)


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
