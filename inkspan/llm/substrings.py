"""Exact repeated-substring removal: bytes covered by a 200-byte string that also starts somewhere else."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokens import slices

_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_TABLE = np.frombuffer(hashlib.shake_256(b"bytes").digest(2048), np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (1 << 64) - 1))
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """64-bit hashes of any substring of a text from prefix sums, with the position divided out."""

    def __init__(self, data: bytes):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * _powers(_B, n), out=self.sums[1:])
        self.back = _powers(_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash (leftmost of equals) of each run of `window` hashes: a function of the run's
    content, so equal runs choose the same place."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, span = hashes, 1  # minima of runs of a growing power of two
    while span * 2 <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    least = np.minimum(low[:n], low[window - span : window - span + n])
    # a position is chosen if some window that holds it has its hash as minimum and no equal one before it
    order = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(order[1:], n)
    out: list[np.ndarray] = []
    same = np.flatnonzero(np.isin(hashes, least[order]))
    values = hashes[same]
    for a, b in zip(order.tolist(), ends.tolist()):  # windows a..b-1 share a minimum value
        i = np.searchsorted(same, a)
        j = np.searchsorted(same, b - 1 + window)
        at = same[i:j][values[i:j] == least[a]]
        if len(at) == 1:
            out.append(at)
        else:  # leftmost within each of the windows
            out.append(np.unique(at[np.searchsorted(at, np.arange(a, b))]))
    return np.unique(np.concatenate(out))


def _batch(cols: dict[str, np.ndarray | list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in types.items()], list(types))


_ANCHOR = {"h": pa.int64(), "digest": pa.int64(), "key": pa.int64(), "pos": pa.int32(), "left": pa.int32(), "right": pa.int32(), "kind": pa.int32()}
_NEED = {"h": pa.int64(), "key": pa.int64(), "a": pa.int32(), "b": pa.int32(), "kind": pa.int32()}
ONE, MANY, SPAN, NEED, PARTNER = 0, 1, 2, 3, 4


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, of each whole text as UTF-8.

    Not the suffix array that the operator is named for; see the README. Of each `length`-byte string, the `gram`-byte
    string with the smallest hash is its anchor, so equal strings meet at equal anchors, aligned. Only anchors are
    shuffled, with a digest of the aligned bytes on both sides that such strings can reach. Where a digest occurs
    twice, all that it stands for is covered, and no text has to move. Where an anchor has several digests, these few
    contexts are fetched and their aligned strings compared. The final texts are cut by the merged spans.
    Anchors, digests and strings are compared by 64-bit hashes. Null text: empty. Texts under `length` bytes: nothing
    removed. Null doc_id: kept. Repeated rows: each is elsewhere for the others. Empty table: no rows.
    """
    window = length - gram + 1
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            parts = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                n = len(text)
                if n < length:
                    continue
                roll, starts = Rolling(text), np.arange(n - gram + 1)
                g = roll.of(starts, starts + gram)
                pos = anchors(g, window)
                a, b = np.maximum(pos - window + 1, 0), np.minimum(pos + length, n)
                d = _mix(roll.of(a, b) + (pos - a).astype(np.uint64))
                parts.append((g[pos], d, np.full(len(pos), key), pos, pos - a, b - pos))
            if not parts:
                continue
            h, d, key, pos, left, right = (np.concatenate(x) for x in zip(*parts))
            o = np.lexsort((d, h))
            h, d, key, pos, left, right = (x[o] for x in (h, d, key, pos, left, right))
            same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            first = np.concatenate([[True], ~same])
            # strings that occur twice in this batch are covered; one of them goes on for the others' sake
            cols = {"h": h.view(np.int64)[first], "digest": d.view(np.int64)[first], "key": key[first], "pos": pos[first], "left": left[first], "right": right[first], "kind": np.where(twice[first], MANY, ONE)}
            yield _batch(cols, _ANCHOR)
            if twice.any():
                t = twice
                spread = _mix(key[t].astype(np.uint64) + pos[t].astype(np.uint64)).view(np.int64)
                yield _batch({"h": spread, "digest": np.zeros(t.sum(), np.int64), "key": key[t], "pos": pos[t], "left": left[t], "right": right[t], "kind": np.full(t.sum(), SPAN)}, _ANCHOR)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (h, digest); the last h of a batch waits for the next one."""
        rest = None
        for batch in batches:
            cols = {k: batch.column(k).to_numpy() for k in _ANCHOR}
            if rest is not None:
                cols = {k: np.concatenate([rest[k], cols[k]]) for k in cols}
            cut = np.searchsorted(cols["h"], cols["h"][-1], "left") if len(cols["h"]) else 0
            rest = {k: v[cut:] for k, v in cols.items()}
            if cut:
                yield met({k: v[:cut] for k, v in cols.items()})
        if rest is not None and len(rest["h"]):
            yield met(rest)

    def met(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        span = c["kind"] == SPAN
        own = {k: v[~span] for k, v in c.items()}
        h, d = own["h"], own["digest"]
        new_h = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        new_d = new_h | np.concatenate([[True], d[1:] != d[:-1]]) if len(h) else new_h
        group, run = np.cumsum(new_d) - 1, np.cumsum(new_h) - 1
        size = np.bincount(group, minlength=1) if len(h) else np.zeros(1, int)
        many = np.zeros(len(size), bool)
        np.logical_or.at(many, group, own["kind"] == MANY)
        many |= size > 1
        kinds = np.bincount(run[new_d], minlength=1)  # digests of each h
        cover = many[group] & (own["left"] + own["right"] >= length)
        several = new_d & (kinds[run] > 1) if len(h) else new_d
        out = {k: [] for k in _NEED}

        def put(x: dict, at: np.ndarray, a: np.ndarray, b: np.ndarray, kind) -> None:
            for k, v in (("h", x["h"][at]), ("key", x["key"][at]), ("a", a[at]), ("b", b[at]), ("kind", np.broadcast_to(kind, x["h"].shape)[at])):
                out[k].append(v)

        put(c, span, c["pos"] - c["left"], c["pos"] + c["right"], SPAN)
        put(own, cover, own["pos"] - own["left"], own["pos"] + own["right"], SPAN)
        put(own, several, own["pos"], own["pos"], np.where(many[group], PARTNER, NEED) if len(h) else NEED)
        return _batch({k: np.concatenate(v) for k, v in out.items()}, _NEED)

    dealt = keyed.mapInArrow(find, "h long, digest long, key long, pos int, left int, right int, kind int").repartition("h").sortWithinPartitions("h", "digest")
    found = written(dealt.mapInArrow(meet, "h long, key long, a int, b int, kind int"), "repeats-met")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            h, key, pos, kind, left, data = [], [], [], [], [], []
            for k, text, wants in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wants").to_pylist()):
                for w in wants:
                    a = max(0, w["a"] - window + 1)
                    h.append(w["h"]), key.append(k), pos.append(w["a"]), kind.append(w["kind"]), left.append(w["a"] - a), data.append(text[a : w["a"] + length])
            for i in range(0, len(h), 4000):
                j = slice(i, i + 4000)
                yield pa.RecordBatch.from_arrays([pa.array(h[j], pa.int64()), pa.array(key[j], pa.int64()), pa.array(pos[j], pa.int32()), pa.array(kind[j], pa.int32()), pa.array(left[j], pa.int32()), pa.array(data[j], pa.binary())], ["h", "key", "pos", "kind", "left", "data"])

    wants = found.where(F.col("kind") >= NEED).groupBy("key").agg(F.collect_set(F.struct("h", "a", "kind")).alias("wants"))
    ctx = keyed.join(wants, "key").select("key", "text", "wants").mapInArrow(contexts, "h long, key long, pos int, kind int, left int, data binary")
    # repeated rows have one key; their anchors were counted as MANY, so one context of each is enough
    ctx = ctx.repartition("h").sortWithinPartitions("h")

    wide = window - 1 + length

    def compared(h: np.ndarray, key: np.ndarray, pos: np.ndarray, kind: np.ndarray, left: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        keys, starts = [], []
        order = np.arange(len(h))
        values, at = [], []
        power = _powers(_B, wide)
        for i in range(0, len(h), 512):
            part = order[i : i + 512]
            m = np.zeros((len(part), wide), np.uint8)
            ends = np.zeros(len(part), np.int64)
            for r, k in enumerate(part.tolist()):
                s = window - 1 - left[k]
                ends[r] = s + len(data[k])
                m[r, s : ends[r]] = np.frombuffer(data[k], np.uint8)
            sums = np.zeros((len(part), wide + 1), np.uint64)
            np.cumsum(_TABLE[m] * power, axis=1, out=sums[:, 1:])
            o = np.arange(window)
            w = _mix((sums[:, length : length + window] - sums[:, :window]) + _mix(h[part].view(np.uint64))[:, None] + _mix(o.astype(np.uint64) + np.uint64(1))[None, :])
            ok = (o[None, :] >= (window - 1 - left[part])[:, None]) & (o[None, :] + length <= ends[:, None])
            values.append(w[ok])
            at.append(np.stack([np.repeat(part, ok.sum(1)), np.broadcast_to(o, ok.shape)[ok]]))
        v, (row, off) = np.concatenate(values), np.concatenate(at, axis=1)
        o = np.argsort(v, kind="stable")
        eq = v[o][1:] == v[o][:-1]
        hit = np.zeros(len(v), bool)
        hit[o[1:][eq]] = True
        hit[o[:-1][eq]] = True
        row, off = row[hit], off[hit]
        use = kind[row] == NEED
        row, start = row[use], pos[row[use]] - (window - 1) + off[use]
        if len(row):  # neighbouring strings of a context become one span
            o = np.lexsort((start, row))
            row, start = row[o], start[o]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1
            keys, starts, stops = key[row[first]], start[first], start[last] + length
        else:
            stops = []
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["key", "a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left")) if len(h) else 0
            if cut:
                yield done(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield done(rest)

    def done(t: pa.Table) -> pa.RecordBatch:
        return compared(*(t.column(c).to_numpy() for c in ("h", "key", "pos", "kind", "left")), t.column("data").to_pylist())

    spans = found.where(F.col("kind") == SPAN).select("key", "a", "b").unionByName(written(ctx.mapInArrow(compare, "key long, a int, b int"), "repeats-spans"))
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                at, removed, runs, end, kept = 0, 0, 0, -1, hashlib.sha256()
                for a, b in sorted((s["a"], s["b"]) for s in own or ()):
                    runs += a > end
                    if a > at:
                        kept.update(text[at:a])
                    removed += max(0, b - max(a, at))
                    at = end = max(at, b)
                kept.update(text[at:])
                rows.append((len(text), removed, runs, kept.hexdigest()))
            n, r, s, k = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(k)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return keyed.join(spans, "key", "left").select(F.col("doc_id").cast("long"), "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
