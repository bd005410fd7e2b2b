"""Quality classifier: naive-Bayes-scaled n-gram indicators under a linear hinge loss, fit by dual coordinate descent."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, written
from .tokens import slices

#: At most so many labelled rows are used to fit, and of these so many as have this many indicators together (4 bytes each);
#: by a hash of doc_id, so alike at every size.
MOST_LABELLED, MOST_INDICATORS = 8000, 16_000_000
#: An n-gram's indicators: present at all, and with at least these shares of the text's n-grams.
SHARES = (0.0, 0.005, 0.02, 0.08, 0.25, 0.6)

_CLASSES = bytes(b"A"[0] if 65 <= c <= 90 else b"a"[0] if 97 <= c <= 122 else b"0"[0] if 48 <= c <= 57 else b"n"[0] if c > 127 else c for c in range(256))
_LONG = re.compile(rb"(A)A+|(a)a+|(0)0+|(n)n+")


def indicators(text: bytes) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a whole text's indicators.

    The n-grams (1 to 3) are over word shapes: letters by case, digits and others as classes, runs of a class as one,
    marks as they are; with the share of words that repeat the last one, of distinct words, and of distinct lines.
    """
    words = text.split()
    shapes = _LONG.sub(lambda m: m[m.lastindex], text.translate(_CLASSES)).split()
    out = [b"len%d" % len(words).bit_length()]
    n = len(words)
    for k in (1, 2, 3):
        for g, c in Counter(zip(*(shapes[i:] for i in range(k)))).items():
            name = b" ".join(g)
            out += [name + b"@%d" % i for i, s in enumerate(SHARES) if c >= s * n]
    if n:
        lines = text.split(b"\n")
        for name, x in ((b"\x01repeats", sum(map(eq, words, words[1:])) / n), (b"\x01distinct", len(set(words)) / n), (b"\x01lines", len(set(lines)) / len(lines))):
            out += [name + b"%d" % i for i in range(int(x * 10) + 1)]
    return np.unique(np.fromiter(map(zlib.crc32, out), np.uint32, len(out)))


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights of min |w|^2/2 + sum cost_i * hinge(y_i w.x_i), x_i having values[j] at its columns j, scaled to length 1."""
    w, alpha, rng = np.zeros(len(values)), np.zeros(len(rows)), np.random.default_rng(seed)
    xs = [(v / max(1e-12, np.sqrt(v @ v))) if len(v := values[r]) else v for r in rows]
    for _ in range(epochs):
        change = 0.0
        for i in rng.permutation(len(rows)):
            if not len(xs[i]):
                continue
            g = y[i] * (w[rows[i]] @ xs[i]) - 1
            a = min(max(alpha[i] - g, 0.0), cost[i])  # |x_i| is 1
            if a != alpha[i]:
                w[rows[i]] += (a - alpha[i]) * y[i] * xs[i]
                change = max(change, abs(a - alpha[i]))
                alpha[i] = a
        if change < 1e-3:
            break
    return w


class NbSvm:
    """Fit on indicator rows and labels 0/1; score() gives the calibrated probability of 1."""

    def __init__(self, smooth: float = 1.0, cost: float = 1.0, least: int = 3):
        self.smooth, self.cost, self.least = smooth, cost, least
        self.names, self.ratio, self.w, self.platt = np.zeros(0, np.uint32), np.zeros(0), np.zeros(0), (0.0, 0.0)

    def _columns(self, row: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.names, row), len(self.names) - 1)
        return at[self.names[at] == row]

    def _train(self, rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.names)
        p, q = (np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(y == k)] or [np.zeros(0, int)]), minlength=n) + self.smooth for k in (1, 0))
        ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        # each class weighs as much as the other
        cost = np.where(y == 1, self.cost / max(1, (y == 1).sum()), self.cost / max(1, (y == 0).sum())) * len(y) / 2
        return ratio, dual_coordinate_descent(rows, ratio, np.where(y == 1, 1.0, -1.0), cost)

    @staticmethod
    def _margin(rows: list[np.ndarray], ratio: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.array([(w[r] @ ratio[r]) / max(1e-12, np.sqrt(ratio[r] @ ratio[r])) if len(r) else 0.0 for r in rows])

    def fit(self, found: list[np.ndarray], labels) -> NbSvm:
        y = np.asarray(labels)
        if not len(y) or len(set(y.tolist())) < 2:  # nothing to tell apart: a constant score
            share = float(y.mean()) if len(y) else 0.5
            self.platt = (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
            return self
        names, count = np.unique(np.concatenate(found), return_counts=True)
        self.names = names[count >= min(self.least, max(1, len(y) // 10))]
        rows = [self._columns(r) for r in found]
        fold, margin = np.arange(len(y)) % 3, np.zeros(len(y))
        for k in range(3):
            inside = [i for i in range(len(y)) if fold[i] != k]
            if len(set(y[inside].tolist())) == 2:
                own = self._train([rows[i] for i in inside], y[inside])
                margin[fold == k] = self._margin([rows[i] for i in np.flatnonzero(fold == k)], *own)
        self.ratio, self.w = self._train(rows, y)
        a, b, t = 1.0, 0.0, np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
        for _ in range(100):  # Newton steps for the two logistic parameters
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            s = p * (1 - p) + 1e-9
            h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
            step = np.linalg.solve(h, [((p - t) * margin).sum(), (p - t).sum()])
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-6:
                break
        self.platt = (float(a), float(b))
        return self

    def score(self, row: np.ndarray) -> float:
        c = self._columns(row)
        m = self._margin([c], self.ratio, self.w)[0] if len(c) else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.platt[0] * m + self.platt[1], -30, 30))))


def _held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, indicators_in_all: int = MOST_INDICATORS) -> NbSvm:
    """Fits on `most` labelled rows at most (crc32(doc_id) mod 5 not 0, quality not null, lowest hashes first; a
    doc_id with more rows counts with each), and on no more of them than have `indicators_in_all` indicators together, so that what the driver holds is bounded in bytes."""
    by = [F.md5(F.col("doc_id").cast("string")), F.col("quality")]
    picked = labels.where(~_held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality").orderBy(*by).limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            f = [indicators(t or b"").view(np.int32) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(f, pa.list_(pa.int32())), pa.array(map(len, f), pa.int64())], ["doc_id", "quality", "found", "n"])

    # the picked rows are bounded by `most`, so they may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, found array<int>, n long")
    rows = written(rows.withColumns({"digest": F.xxhash64("found"), "row": F.monotonically_increasing_id()}), "quality-indicators")
    # a doc_id may have any number of rows: what comes to the driver is bounded by rows first, then by their indicators
    order = [F.md5(F.col("doc_id").cast("string")), F.col("quality"), F.col("digest"), F.col("row")]
    total, kept = 0, []
    for r in rows.orderBy(*order).limit(most).select("row", "n").toArrow().to_pylist():
        total += r["n"]
        if total > indicators_in_all:
            break
        kept.append(r["row"])
    got = rows.where(F.col("row").isin(kept)) if kept else rows.limit(0)
    got = got.select("doc_id", "quality", "digest", "found").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("digest", "ascending")])
    return NbSvm().fit([x.values.to_numpy().view(np.uint32) for x in got.column("found")], got.column("quality").to_numpy())


def score_quality(docs: DataFrame, model: NbSvm, cut: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 if score >= cut). Null text: as the empty text. Map-only; other columns stay,
    those named score or predicted give way. Null doc_id: scored. Repeated rows: each scored. Empty table: no rows."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = [model.score(indicators(t or b"")) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= cut) for x in s], pa.int32())], [*kept, "score", "predicted"])

    return docs.select(*kept).mapInArrow(lean(run), out)


def op1_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
