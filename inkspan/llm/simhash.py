"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming checks, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import few_parts, free_names, lean, table, written
from .components import components
from .tokens import slices

#: Beyond so many fingerprints in one block bucket (256 kB), pairs are found by their neighbourhoods instead.
HOT = 1 << 15


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined word shingles, repeats included; fewer words: the whole sequence; none: empty."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(x), 42) for x in zip(*(words[i:] for i in range(width)))), np.uint64, len(words) - width + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every whole text; null text: as one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = [majority_bits(shingle_hashes(t or b"", width)) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _edges_within(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest (pairs of positions) of the graph of fingerprints that differ in at most `most` bits."""
    n, out = len(fp), []
    left = np.arange(n)
    while len(left):  # breadth first: each fingerprint is compared with those not reached yet
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= most
            for y in left[near].tolist():
                out.append((x, y))
                queue.append(y)
            left = left[~near]
    return out


def _runs(batches: Iterator[pa.RecordBatch], most: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: forest edges within each run of a key; the members of longer runs as (fp, fp)."""
    key, held, over = None, [], False
    out: list[tuple[int, int]] = []

    def close() -> None:
        fp = np.concatenate(held)
        if not over and len(fp) > 1:
            out.extend((int(fp[a]), int(fp[b])) for a, b in _edges_within(fp.view(np.uint64), most))

    def flush() -> pa.RecordBatch:
        a = np.array(out, np.int64).reshape(-1, 2)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    for batch in batches:
        keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        ends = np.append(starts[1:], len(keys))
        wide = (ends - starts > 1) | (starts == 0) | (ends == len(keys))  # runs of one inside a batch have no pairs
        for s, e in zip(starts[wide].tolist(), ends[wide].tolist()):
            if keys[s] != key:
                if held:
                    close()
                key, held, over = keys[s], [], False
            held.append(fps[s:e])
            if not over and sum(map(len, held)) > hot:
                over = True
                held = [np.concatenate(held)]
            if over:  # stream them on, hold none
                out.extend((x, x) for part in held for x in part.tolist())
                held = [fps[:0]]
            if len(out) > 50_000:
                yield flush()
    if held:
        close()
    yield flush()


def block_keys(n_blocks: int = 6, equal: int = 3, bits: int = 64) -> list[tuple[int, int]]:
    """(number, bit mask) for each choice of `equal` of n_blocks blocks: fingerprints that differ in at most
    n_blocks - equal bits agree in all bits of one mask at least."""
    edges = [round(i * bits / n_blocks) for i in range(n_blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n_blocks)]
    return [(k, sum(masks[i] for i in c)) for k, c in enumerate(combinations(range(n_blocks), equal))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_edges(fps: DataFrame, most: int = 3, hot: int = HOT) -> DataFrame:
    """fps: distinct fp. Edges (a, b) whose components are those of all pairs at `most` (3) or fewer differing bits.

    Pigeonhole: 6 blocks, of which close pairs share 3, so 20 keys of about 32 bits: few strangers meet. Sorted by
    key, a bucket's pairs are checked by Hamming distance, and only a spanning forest is returned. A bucket of over
    `hot` fingerprints isn't searched by pairs: its members meet at midpoints instead (every pair within 3 bits has
    a midpoint 1 bit from one and 2 from the other at most), at most 2081 members each. So no link is lost.
    """
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in block_keys(3 + most, 3)])
    # a collision of xxhash64 only brings strangers together, who then fail the Hamming check
    dealt = fps.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")
    found = written(dealt.select("key", "fp").mapInArrow(lambda b: _runs(b, most, hot), "a long, b long"), "simhash-runs", narrow=True)
    crowded = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return found
    return found.where("a <> b").unionByName(midpoint_edges(crowded, most))


def midpoint_edges(fps: DataFrame, most: int = 3) -> DataFrame:
    """Edges with the components of all pairs within 3 bits, from the points within 2 bits of each fingerprint.

    The points are dealt and sorted by their value; the fingerprints that share one (2081 at most, as they are distinct)
    are streamed: each is linked to the first one within 1 bit of it.
    """
    if most != 3:
        raise ValueError("midpoints are laid out for 3 bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1) << np.arange(64, dtype=np.uint64)
        flips = np.concatenate([[np.uint64(0)], one, [a ^ b for a, b in combinations(one, 2)]])
        far = np.arange(len(flips)) > 64
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                fp = batch.column("fp").slice(i, 200).to_numpy()
                z = (fp.view(np.uint64)[:, None] ^ flips).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(z.ravel()), pa.array(np.tile(far, len(fp))), pa.array(np.repeat(fp, len(flips)))], ["z", "far", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (z, far, fp). Only the point at hand and its first fingerprint are held."""
        now, first = None, 0
        for batch in batches:
            z, far, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("z", "far", "fp"))
            if not len(z):
                continue
            new = np.concatenate([[now is None or z[0] != now], z[1:] != z[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(z)), -1))
            lead = np.where(head < 0, first, fp[head])
            # without a fingerprint within 1 bit, what lies around a point is no link
            near = np.where(head < 0, first_near if now is not None else False, ~far[head])
            keep = near & (lead != fp)
            yield pa.RecordBatch.from_arrays([pa.array(lead[keep]), pa.array(fp[keep])], ["a", "b"])
            now, first, first_near = z[-1], lead[-1], near[-1]

    met = fps.mapInArrow(spread, "z long, far boolean, fp long").repartition("z").sortWithinPartitions("z", "far", "fp")
    return met.mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of `most` or fewer bits.

    Equal fingerprints are one node, so copies cost one row each. Null text: fingerprint zero, linked like any other.
    Null doc_id: kept; it never names a component that has another. Repeated rows: kept. Empty table: no rows.
    """
    found = written(fingerprints(docs, width), "simhash-fp", narrow=True)
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = components(near_edges(nodes.select("fp"), most), "simhash")  # node, root: those with links only, and no roots
    rooted = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return few_parts(found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


#: Min-hashes of a shingle set: BANDS keys of ROWS each. At a Jaccard similarity s two sets share no key with a chance of
#: (1 - s**4)**32: 5 in 100 million at 0.8, less above.
BANDS, ROWS = 32, 4
_FLIPS = np.random.default_rng(7).integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_ODDS = np.random.default_rng(8).integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def min_hash_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys (signed longs) of a set of 64-bit hashes, each of ROWS min-hashes."""
    low = np.full((BANDS * ROWS, 1), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 1 << 12):
        x = hashes[i : i + (1 << 12)].astype(np.uint32)  # the lower 32 bits
        low = np.minimum(low, ((x ^ _FLIPS) * _ODDS).min(1, keepdims=True))
    two = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = (key ^ two[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


#: Odd constants that draw further 128-bit hashes from one.
_DRAWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _widest_bits(digests: list[bytes]) -> bytes:
    """The 512 majority bits of 16-byte hashes, each of which is drawn out to 64 bytes by multiply and shift rounds."""
    if not digests:
        return bytes(64)
    counts = np.zeros(512, np.int64)
    for i in range(0, len(digests), 1 << 12):
        seeds = np.frombuffer(b"".join(digests[i : i + (1 << 12)]), np.uint64).reshape(-1, 2)
        x = np.concatenate([seeds * np.uint64(k) for k in _DRAWS], axis=1)
        for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(k)
        x ^= x >> np.uint64(33)
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(digests)).tobytes()


def shingle_digests(text: bytes, width: int) -> list[bytes]:
    """128-bit digests of the distinct word shingles; fewer words: of the whole sequence; none: empty."""
    import xxhash

    words = text.lower().split()
    shingles = {b" ".join(x) for x in zip(*(words[i:] for i in range(width)))} or ({b" ".join(words)} if words else set())
    return [xxhash.xxh3_128_digest(s) for s in shingles]


def shingle_set(digests: list[bytes]) -> np.ndarray:
    """The sorted set of the digests' first 64 bits."""
    return np.unique(np.frombuffer(b"".join(digests), np.uint64)[::2])


def spanning_edges(fp: np.ndarray, loose: int) -> list[tuple[int, int, int]]:
    """A minimum spanning forest (positions, differing bits) of fingerprints (rows of 64-bit words) that differ in at most
    `loose` bits: at every lower limit, what is linked at that limit is linked by its edges."""
    n, out = len(fp), []
    left = np.arange(1, n)
    best, at = np.full(n, loose + 1), np.zeros(n, np.int64)
    now = 0
    while len(left):
        d = np.bitwise_count(fp[left] ^ fp[now]).sum(1, dtype=np.int64)
        closer = d < best[left]
        best[left[closer]], at[left[closer]] = d[closer], now
        k = int(best[left].argmin())
        now = int(left[k])
        if best[now] <= loose:
            out.append((int(at[now]), now, int(best[now])))
        left = np.delete(left, k)
    return out


def exact_links(sets: list[np.ndarray], labels: np.ndarray, asking: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of positions of distinct values whose Jaccard similarity is `least` or more, enough to connect all whom such
    pairs with one of `asking` (positions) connect beyond what equal labels connect already. A position is compared with
    those only that are not connected with it yet, by counting the bits of the values that two sets at least have."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate([*sets, np.zeros(0, np.uint32)])
    _, of, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    of = np.where(shared[of], (np.cumsum(shared) - 1)[of], -1)
    width = -(-int(shared.sum()) // 64) * 8
    bits = np.zeros((n, width), np.uint8)
    for k, (end, m) in enumerate(zip(np.cumsum(size).tolist(), size.tolist())):
        own = of[end - m : end]
        row = np.zeros(width * 8, bool)
        row[own[own >= 0]] = True
        bits[k] = np.packbits(row)
    words = bits.view(np.uint64)
    labels, out = labels.copy(), []
    for x in asking.tolist():
        rest = np.flatnonzero((labels != labels[x]) & (size >= least * size[x] - 1e-9) & (least * size <= size[x] + 1e-9))
        for i in range(0, len(rest), 1024):
            at = rest[i : i + 1024]
            both = np.bitwise_count(words[at] & words[x]).sum(1, dtype=np.int64)
            near = at[both >= (least - 1e-9) * (size[at] + size[x] - both)]
            for y in near[np.unique(labels[near], return_index=True)[1]].tolist():
                if labels[y] != labels[x]:
                    out.append((x, y))
                    labels[labels == labels[y]] = labels[x]
    return out


def central(fp: np.ndarray, n: int) -> np.ndarray:
    """The positions of the n fingerprints nearest to the bitwise majority of all: those that most others are copies of."""
    counts = np.zeros(fp.shape[1] * 64, np.int64)
    for i in range(0, len(fp), 1 << 12):
        counts += np.unpackbits(fp[i : i + (1 << 12)].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    middle = np.packbits(counts * 2 > len(fp), bitorder="little").view(np.uint64)
    return np.argsort(np.bitwise_count(fp ^ middle).sum(1, dtype=np.int64), kind="stable")[:n]


#: So many rows of one key (72 bytes each) a task holds at most; of these, so many central ones take part in each portion.
HELD, HUBS = 1 << 20, 64


_EDGE_NAMES = ["a", "b", "key", "over"]


def _bucket_edges(batches: Iterator[pa.RecordBatch], loose: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, near): edges (a, b) of the minimum spanning forests of each key's rows. A key with more than `most`
    rows is handled in portions, each together with the key's central rows, as copies of one text may be linked through it
    alone. As rows of such a key don't all meet here, it is named, too, (key, over true); so are the first and the last key of
    the task (over false), which may go on in another one. linked_families() holds these against each other."""
    rest, first, last = None, None, None

    def named(keys: list[int], over: bool) -> pa.RecordBatch:
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(keys, pa.int64()), pa.array([over] * len(keys), pa.bool_())], _EDGE_NAMES)

    def linked(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        fp = np.frombuffer(b"".join(t.column("s").to_pylist()), np.uint64).reshape(-1, 8)
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        ends = np.append(starts[1:], len(k))
        two = starts[ends - starts == 2]
        d = np.bitwise_count(fp[two] ^ fp[two + 1]).sum(1, dtype=np.int64)
        a, b = [two[d <= loose]], [two[d <= loose] + 1]
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            hubs = s + central(fp[s:e], HUBS) if e - s > most else np.zeros(0, np.int64)
            for c in range(s, e, most):
                rows = np.union1d(np.arange(c, min(e, c + most)), hubs)
                if found := spanning_edges(fp[rows], loose):
                    x, y, _ = np.array(found).T
                    a.append(rows[x]), b.append(rows[y])
        a, b = (np.concatenate(x) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.bool_())], _EDGE_NAMES)
        yield named(k[starts[ends - starts > most]].tolist(), True)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        k = t.column("key").to_numpy()
        if len(k):
            first, last = int(k[0]) if first is None else first, int(k[-1])
        cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
        if not cut and len(k) >= HELD:
            cut = len(k)
        if cut:
            yield from linked(t.slice(0, cut))
        rest = t.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield from linked(rest)
    if first is not None:
        yield named(sorted({first, last}), False)


def crossed(fp: np.ndarray, labels: np.ndarray, asking: np.ndarray, loose: int) -> list[tuple[int, int]]:
    """Pairs of positions of fingerprints that differ in at most `loose` bits, enough to connect all whom such pairs with one of
    `asking` connect beyond what equal labels connect already."""
    labels, out = labels.copy(), []
    for x in asking.tolist():
        rest = np.flatnonzero(labels != labels[x])
        near = rest[np.bitwise_count(fp[rest] ^ fp[x]).sum(1, dtype=np.int64) <= loose]
        for y in near[np.unique(labels[near], return_index=True)[1]].tolist():
            out.append((x, y))
            labels[labels == labels[y]] = labels[x]
    return out


#: So many rows of a key a side of a block holds at most, about, where a crowded key's rows are held against each other.
CELL = 8192


def linked_families(blocks: DataFrame, loose: int, most: int) -> DataFrame:
    """blocks (key, near, node, s): node, root of the components of all pairs of one key that differ in at most `loose` bits.

    First by one task for each range of (key, near). Keys whose rows did not all meet there, as they are more than `most` or on
    both sides of a range's end, are gone through again: those of their rows that are not in the key's largest component yet
    are held against all of its rows, in blocks of CELL by CELL rows, dealt over the cluster. So no pair is left out; rows
    without near copies under one crowded key cost their number times the key's."""
    dealt = blocks.repartitionByRange("key", "near").sortWithinPartitions("key", "near")
    found = written(dealt.select("key", "node", "s").mapInArrow(lambda b: _bucket_edges(b, loose, most), "a long, b long, key long, over boolean"), "near-copies-found", narrow=True)
    edges = found.where("a IS NOT NULL").select("a", "b")
    crowded = found.where("key IS NOT NULL").groupBy("key").agg(F.max("over").alias("over"), F.count("*").alias("n")).where("over OR n > 1").select("key")
    so_far = written(components(edges, "near-copies-families"), "near-copies-family", narrow=True)
    label = so_far.select("node", F.col("root").alias("label"))
    # a few keys: one for each range's end, and at most one in `most` rows
    told = blocks.join(F.broadcast(crowded), "key").select("key", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    told = written(told, "near-copies-told", narrow=True)
    by = told.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("largest"), F.max("n").alias("most"))
    of = lambda n: F.ceil(n / CELL).cast("int")
    apart = written(by.where("n > most").select("key", "largest", of(F.col("n")).alias("parts"), of(F.col("n") - F.col("most")).alias("blocks")), "near-copies-crowded", narrow=True)
    if apart.isEmpty():
        return so_far
    held = blocks.select("key", "node", F.col("s").alias("set")).join(F.broadcast(apart), "key").join(told.select("key", "node", "label"), ["key", "node"])
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = held.select("key", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), cells("blocks").alias("block"), "node", "set", "label", F.lit(False).alias("asks"))
    left = held.where("label <> largest").select("key", cells("parts").alias("part"), F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int").alias("block"), "node", "set", "label", F.lit(True).alias("asks"))
    keys = ["key", "part", "block"]
    link = lambda sets, labels, asking: crossed(np.frombuffer(b"".join(sets), np.uint64).reshape(-1, 8), labels, asking, loose)
    met = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b: _links_of_groups(b, keys, link), "a long, b long")
    return written(components(so_far.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(met), "near-copies-joined"), "near-copies-families", narrow=True)


#: A group of near copies is searched by one task up to so many texts and so many bytes of their sets; a larger one in portions
#: of that size, each with HUBS common texts of the group.
PORTION, PORTION_BYTES = 2048, 4 << 20


def _links_of_groups(batches: Iterator[pa.RecordBatch], keys: list[str], link) -> Iterator[pa.RecordBatch]:
    """Rows (keys, node, set, label, asks) sorted by keys: link(sets, labels, asking) of each run of equal keys."""
    held: list[pa.Table] = []

    def links(t: pa.Table) -> pa.RecordBatch:
        node = t.column("node").to_numpy()
        node, first = np.unique(node, return_index=True)  # a hub may be in its own portion, too
        sets = t.column("set").take(pa.array(first)).to_pylist()
        label, asks = t.column("label").to_numpy()[first], t.column("asks").to_numpy(zero_copy_only=False)
        asking = np.flatnonzero(np.isin(node, t.column("node").to_numpy()[asks]))
        a, b = np.array(link(sets, label, asking), np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    for b in batches:
        t = pa.Table.from_batches([b])
        k = np.stack([t.column(c).to_numpy() for c in keys], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)] if len(k) else [0]
        for s, e in zip(cuts, cuts[1:]):
            run = t.slice(s, e - s)
            if held and [held[0].column(c)[0].as_py() for c in keys] != k[s].tolist():
                yield links(pa.concat_tables(held))
                held.clear()
            held.append(run)
    if held:
        yield links(pa.concat_tables(held))


def verified_links(sets: DataFrame, least: float) -> DataFrame:
    """sets (root, node, set): edges (a, b) of a Jaccard similarity of `least` and more, which connect all whom such pairs
    within a root connect.

    A root of up to PORTION texts is one task's work. A larger one is first searched in portions, dealt by hash, with HUBS
    common texts in each. Where that leaves more than one component, all texts outside the largest one are compared with
    all of the root, block by block; so nothing is missed, and a family that hangs together costs no more than its portions."""
    link = lambda found, labels, asking: exact_links([np.frombuffer(x, np.uint32) for x in found], labels, asking, least)
    work = lambda d, keys: d.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b: _links_of_groups(b, keys, link), "a long, b long")
    size = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("set")).alias("bytes"))
    of = lambda n, b: F.greatest(F.ceil(n / PORTION), F.ceil(b / PORTION_BYTES)).cast("int")
    large = written(size.select("root", of(F.col("n"), F.col("bytes")).alias("portions")).where("portions > 1"), "near-copies-large", narrow=True)
    as_own = [F.col("node").alias("label"), F.lit(True).alias("asks")]
    if large.isEmpty():
        return work(sets.select("root", F.lit(0).alias("part"), "node", "set", *as_own), ["root", "part"])
    small = sets.join(large, "root", "left_anti").select("root", F.lit(0).alias("part"), "node", "set", *as_own)
    crowd = written(sets.join(large, "root").withColumn("hash", F.xxhash64("node")), "near-copies-crowd")
    own = F.pmod("hash", F.col("portions")).cast("int")
    hubs = _smallest(crowd, HUBS).join(crowd, ["root", "hash"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
    parts = small.unionByName(crowd.select("root", own.alias("part"), "node", "set", *as_own)).unionByName(hubs.select("root", "part", "node", "set", *as_own))
    links = written(work(parts, ["root", "part"]), "near-copies-links", narrow=True)
    # what the portions have left apart
    so_far = components(links, "near-copies-portions").select("node", F.col("root").alias("label"))
    named = written(crowd.select("root", "node", "portions", "hash", F.length("set").alias("bytes")).join(so_far, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-copies-named", narrow=True)
    most = named.groupBy("root", "label").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    apart = named.join(most, "root").where("label <> most").groupBy("root").agg(F.first("most").alias("most"), of(F.count("*"), F.sum("bytes")).alias("blocks"))
    apart = written(apart, "near-copies-apart", narrow=True)
    if apart.isEmpty():
        return links
    told = crowd.select("root", "node", "set", "portions", "hash").join(named.select("node", "label"), "node").join(apart, "root")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = told.select("root", own.alias("part"), cells("blocks").alias("block"), "node", "set", "label", F.lit(False).alias("asks"))
    block = F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int")
    left = told.where("label <> most").select("root", cells("portions").alias("part"), block.alias("block"), "node", "set", "label", F.lit(True).alias("asks"))
    return links.unionByName(work(left.unionByName(right), ["root", "part", "block"]))


def _smallest(crowd: DataFrame, n: int) -> DataFrame:
    """root, hash: the n smallest hashes of each root, first within each part of the input, so that no root meets in one task."""
    w = Window.partitionBy("root", "salt").orderBy("hash")
    some = crowd.select("root", "hash", F.pmod(F.shiftright("hash", 20), F.col("portions")).alias("salt")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return some.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("hash"))).where(F.col("k") <= n).select("root", "hash")


def one_of_each(docs: DataFrame, width: int = 5, least: float = 0.8, loose: int = 112, most: int = 4096) -> DataFrame:
    """docs without near copies: of each group, the row with the smallest doc_id stays. Columns as in docs.

    Groups are the components of the links between sets of distinct `width`-word shingles (as 32-bit hashes) of a Jaccard
    similarity of `least` (0.8) and more. Candidates first: rows that share a block key (BANDS of ROWS min-hashes) are compared
    by their 512-bit SimHash, in a minimum spanning forest of each bucket up to `loose` differing bits. At a similarity s,
    the share of differing bits is arccos(2s / (1 + s)) / pi: 77 of 512 at 0.8, with a deviation of 8, 112 at 0.63. What such
    a forest connects is a family; texts that are linked are in one family, whether or not the forest has their edge.
    The sets of a family then meet, and only exact similarities make links (verified_links). Crowded buckets are spread over
    tasks by ranges of (key, further min-hashes) and handled in portions of `most` rows and the central ones; what that leaves
    apart is held against the whole bucket, block by block (linked_families). Equal sets are one node. Null text and texts without words: alike, so one of them stays. Repeated rows: one stays. Empty table: no rows.
    """
    node, keys, bits, row = free_names(docs, "_node", "_keys", "_bits", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, "text"):
            own, found, wide = [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                digests = shingle_digests(t or b"", width)
                chosen = shingle_set(digests)
                own.append(xxhash.xxh3_64_intdigest(chosen.tobytes()))
                found.append(min_hash_keys(chosen))
                wide.append(_widest_bits(digests))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(own, np.uint64).view(np.int64)), listed, pa.array(wide, pa.binary())], [*b.schema.names, node, keys, bits])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            sets = [np.unique(shingle_set(shingle_digests(t or b"", width)).astype(np.uint32)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("node"), pa.array(sets, pa.binary())], ["root", "node", "set"])

    made = StructType([*docs.schema.fields]).add(node, "long").add(keys, ArrayType(LongType())).add(bits, "binary")
    rows = written(docs.mapInArrow(lean(run), made).withColumn(row, F.monotonically_increasing_id()), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))).alias("first")
    nodes = written(rows.groupBy(F.col(node).alias("node")).agg(first), "near-copies-nodes", narrow=True)
    alone = rows.select(F.col(row).alias("at"), F.col(keys).alias("keys"), F.col(bits).alias("s"))
    blocks = nodes.select("node", F.col("first.row").alias("at")).join(alone, "at").select("node", "s", F.explode("keys").alias("key"), F.xxhash64(F.slice("keys", 1, 4)).alias("near"))
    families = linked_families(blocks, loose, most)
    members = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct())
    # sets of families only, each once, from their texts
    asked = nodes.select("node", F.col("first.row").alias("at")).join(members, "node")
    texts = asked.join(rows.select(F.col(row).alias("at"), "text"), "at").select("root", "node", "text")
    sets = written(few_parts(texts.mapInArrow(lean(to_sets), "root long, node long, set binary"), 8), "near-copies-sets")
    comp = components(verified_links(sets, least), "near-copies")
    grouped = nodes.join(comp.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("first"))
    stay = grouped.select(F.col("first.row").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
