"""Connected components of an edge list: alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: So many edges at most (16 bytes each) are finished by one task, whatever the size of the input; more go by rounds.
ONE_TASK = 1 << 20


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) and, for each, the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook larger roots onto smaller ones, then jump to the roots' roots
        p, q = root[x], root[y]
        open_ = p != q
        if not open_.any():
            return nodes, nodes[root]
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up


def _stars(batches: Iterator[pa.RecordBatch], names: tuple[str, str], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars (node, smallest node) of their components; most: in portions of so many edges."""
    a, b, held = [], [], 0

    def done() -> pa.RecordBatch:
        node, root = labels(np.concatenate(a), np.concatenate(b))
        inner = node != root
        a.clear(), b.clear()
        return pa.RecordBatch.from_arrays([pa.array(node[inner]), pa.array(root[inner])], list(names))

    for batch in batches:
        a.append(batch.column(0).to_numpy()), b.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if most and held >= most:
            yield done()
            held = 0
    if held:
        yield done()


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Hooks neighbours onto the smallest one around. both (large star): every node does this for larger neighbours;
    else (small star): for its smaller ones and itself."""
    if both:
        e = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    j = e.join(least, "a")
    if both:
        return j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    hooked = j.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, name: str, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """edges (a, b): node, root (the smallest node of its component) for every node of an edge but the roots.

    Each task first cuts its own edges down to stars. What is left is finished by one task if it has at most `one_task`
    edges (16 MB, a constant); else by rounds of stars over the whole cluster, each written to the shared folder, which cuts
    the lineage. Rounds grow with the logarithm of the size. Self-loops are ignored; no edges: no rows.
    """
    own = edges.where("a <> b").select("a", "b").mapInArrow(lambda b: _stars(b, ("a", "b"), ONE_TASK), "a long, b long")
    now = written(own, f"{name}-edges", narrow=True)
    if now.count() <= one_task:
        return now.coalesce(1).mapInArrow(lambda b: _stars(b, ("node", "root")), "node long, root long")
    now, before = now.distinct(), None
    for _ in range(rounds):
        large = _star(now, True).where("a <> b").distinct()
        now = written(_star(large, False).where("a <> b").distinct(), f"{name}-round", narrow=True)
        r = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (r[0], r[1]) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (r[0], r[1])
    raise RuntimeError("components did not settle")
