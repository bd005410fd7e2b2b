"""Approximate nearest neighbours with a hash-prefix forest: sorted arrays of long hash strings, one per tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


class PrefixForest:
    """Trees over one block of vectors: each sorts the vectors by a 32-bit string of random-hyperplane signs.

    Inner products are searched as angles: vectors get one more component that brings them to the largest length;
    a query gets 0 there. That component would hide the angles of short vectors, so the block is split into ranges of
    similar lengths (`narrow` from longest to shortest), each with sorted strings and a largest length of its own. A query
    descends each tree to its longest matching prefix (by binary search of the sorted strings), and all trees of a range
    ascend together, a prefix length at a time, until their ranges hold enough distinct vectors.
    """

    def __init__(self, vectors: np.ndarray, trees: int = 64, bits: int = 32, seed: int = 11, narrow: float = 1.25):
        n, d = vectors.shape
        self.bits, self.n = bits, n
        self.planes = np.random.default_rng(seed).standard_normal((trees, d + 1, bits)).astype(np.float32)
        squares = (vectors**2).sum(1)
        down = np.argsort(-squares, kind="stable")
        self.ranges = []
        while len(down):
            top = squares[down[0]]
            cut = int(np.searchsorted(-squares[down], -top / narrow**2, "right"))
            rows, down = down[:cut], down[cut:]
            x = np.hstack([vectors[rows], np.sqrt(np.maximum(top - squares[rows], 0))[:, None]]).astype(np.float32)
            strings = [self._strings(x, p) for p in self.planes]
            order = [np.argsort(s, kind="stable") for s in strings]
            self.ranges.append((rows, order, [s[o] for s, o in zip(strings, order)]))

    def _strings(self, x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return ((x @ planes > 0) @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64)[::-1]))

    def candidates(self, queries: np.ndarray, share: float, least: int, own: list[np.ndarray]):
        """For each query, a mask of its candidates: in each range of lengths, share of the vectors and `least` of them at
        least (all, if fewer), counted once each and without the rows own[i] of query i, which are left out."""
        q = np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32)
        found = [self._strings(q, p) for p in self.planes]
        for i in range(0, len(q), 256):
            at = range(i, min(i + 256, len(q)))
            mask = np.zeros((len(at), self.n), bool)
            for rows, order, strings in self.ranges:
                place = np.full(self.n, -1)
                place[rows] = np.arange(len(rows))
                mine = [place[own[k]] for k in at]
                mask[:, rows] = self._within(order, strings, [s[i : i + 256] for s in found], [m[m >= 0] for m in mine], share, least)
            yield from mask

    def _within(self, order: list, strings: list, found: list, own: list[np.ndarray], share: float, least: int) -> np.ndarray:
        n, m = len(order[0]), len(own)
        mask = np.zeros((m, n), bool)
        wanted = np.array([min(n - len(x), max(share * (n - len(x)), least)) for x in own])

        def places(at: np.ndarray, length: np.ndarray):
            shift = (self.bits - length).astype(np.uint64)
            a = np.stack([np.searchsorted(s, (x[at] >> shift) << shift, "left") for s, x in zip(strings, found)])
            b = np.stack([np.searchsorted(s, ((x[at] >> shift) + np.uint64(1)) << shift, "left") for s, x in zip(strings, found)])
            return a, b

        # with repeats and own rows, places are no fewer than distinct candidates: no longer prefix can be enough
        low, high, every = np.zeros(m, np.int64), np.full(m, self.bits), np.arange(m)
        while (low < high).any():
            mid = (low + high + 1) // 2
            a, b = places(every, mid)
            enough = (b - a).sum(0) >= wanted
            low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
        length, todo = low, every
        while len(todo):
            a, b = places(todo, length[todo])
            for j, i in enumerate(todo.tolist()):
                for t, o in enumerate(order):
                    mask[i, o[a[t, j] : b[t, j]]] = True
                mask[i, own[i]] = False
            todo = todo[(mask[todo].sum(1) < wanted[todo]) & (length[todo] > 0)]
            length[todo] -= 1
        return mask


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 64, share: float = 0.75, block: int = 8192, query_block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product among the vectors (vec_id, embedding) but itself.

    Vectors are dealt into blocks of about `block` rows by a hash of their id, queries into blocks of `query_block`;
    each pair of blocks is one bounded group that builds its forest and returns k rows for each query, and the best k
    of all blocks are kept. A query's candidates in a block are at least share * rows and k of each range of lengths,
    each row counted once and the query's own not at all (all, if fewer): on directionless data few don't reach a
    recall of 0.9, as nearby angles differ little from others. Every row is indexed. Candidates are ranked by the exact inner product in double
    precision, ties to the smaller vec_id; copies of a vector share all strings, so they are found together.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Vectors of each length
    are searched by themselves. Repeated ids: each row is a candidate, but for a query's own id. Fewer candidates: all of them.
    """
    def usable(df: DataFrame, name: str) -> DataFrame:
        e = F.col("embedding")
        ok = e.isNotNull() & (F.size(e) > 0) & F.col(name).isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
        return df.where(ok).select(F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))

    v, q = usable(vectors, "vec_id"), usable(queries, "vec_id")
    n, m = v.count(), q.count()
    shards, parts = max(1, -(-n // block)), max(1, -(-m // query_block))
    left = v.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = q.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        for d in sorted(set(a["v"].map(len))) if len(a) and len(b) else []:
            x, y = a[a["v"].map(len) == d].sort_values("id", kind="stable"), b[b["v"].map(len) == d]
            if not len(y):
                continue
            ids, vec, qid, qv = x["id"].to_numpy(), _stack(x["v"]), y["id"].to_numpy(), _stack(y["v"])
            forest = PrefixForest(vec, trees)
            at, rank, found, scores = [], [], [], []
            same = {}
            for j, v in enumerate(ids.tolist()):
                same.setdefault(v, []).append(j)
            own = [np.array(same.get(v, []), np.int64) for v in qid.tolist()]
            for i, mask in enumerate(forest.candidates(qv, share, k, own)):
                if i % 256 == 0:
                    products = qv[i : i + 256] @ vec.T
                c = np.flatnonzero(mask)
                if len(c) > k:
                    rough = products[i % 256, c]
                    c = c[rough >= np.partition(rough, len(c) - k)[len(c) - k] - 1e-9 * max(1.0, abs(rough).max())]
                s = (vec[c] * qv[i]).sum(1)
                o = np.lexsort((ids[c], -s))[:k]
                at += [qid[i]] * len(o)
                found += ids[c][o].tolist()
                scores += s[o].tolist()
            out.append(pd.DataFrame({"query_id": at, "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})

    met = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(run, "query_id long, vec_id long, score double")
    # a task keeps the best k of a query of what it has before anything is shuffled, and ranks are streamed
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search(v, v.where("vec_id % 20 = 0"))
