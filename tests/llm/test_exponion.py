"""Vector codes against Lloyd's rounds with every entry compared, in Python's integers, and against their SQL."""

import hashlib

import duckdb
import numpy as np
import pytest

from inkspan.llm import exponion
from inkspan.llm.registry import ORACLE

NAN, INF = float("nan"), float("inf")


def wanted(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and x == x and abs(x) != INF for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) if kept else 0
    whole = [[(4096 * n) // d for n, d in (float(x).as_integer_ratio() for x in r[1])] for r in kept]
    cuts = [(k * width // parts, (k + 1) * width // parts) for k in range(parts)]
    cut = [[v[a:b] for a, b in cuts] for v in whole]
    books = [[v[k] for v in cut[:entries]] for k in range(parts)]

    def nearest(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[k]))

    for r in range(rounds + 1):
        found = [[nearest(k, v[k]) for k in range(parts)] for v in cut]
        for k in range(parts if r < rounds else 0):
            for e in range(len(books[k])):
                own = [v[k] for v, f in zip(cut, found) if f[k][1] == e]
                if own:
                    books[k][e] = [sum(c) // len(own) for c in zip(*own)]
    fit = lambda x: x if x is not None and x < 1 << 63 else None
    errors = [fit(sum(d for d, _ in f)) for f in found]
    by = {}
    for r, e in zip(kept, errors):
        by.setdefault(r[2], []).append(e)
    total = {x: fit(None if None in v else sum(v)) for x, v in by.items()}
    text = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in f), e, total[r[2]], text) for r, f, e in zip(kept, found, errors)), key=str)


def table(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(k, (rng.normal(size=width) * scale).tolist(), int(k % 3) if k % 7 else None) for k in range(n)]


ODD = [(3, [1.0] * 16, 1), (3, [1.0] * 16, 1), (None, [0.5] * 16, 2), (9, None, 1), (8, [NAN] + [0.0] * 15, 1), (7, [INF] + [0.0] * 15, 1), (6, [None] + [0.0] * 15, None), (5, [1.0] * 8, 1), (4, [-0.25] * 16, None)]
HUGE = [(k, [(-1.0) ** k * 10.0 ** (k % 40 * 7 + j) for j in range(16)], k % 2) for k in range(60)] + [(100, [5e-324] * 16, 0), (101, [1.7e308] * 16, 1)]
CASES = {"plain": table(300, 16, 1), "odd": ODD + table(40, 16, 2)[10:], "few": ODD, "huge": HUGE, "unequal parts": table(50, 13, 3), "narrow": table(30, 3, 4), "ties": [(k, [float(k % 4), 0.0] * 8, k % 2) for k in range(90)], "none": ODD[3:7], "wide": table(30, 16, 5, 1e7), "empty": []}


@pytest.mark.parametrize("case", CASES)
def test_codes(spark, case):
    rows = CASES[case]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    assert sorted((tuple(r) for r in exponion.vector_codes(d).collect()), key=str) == wanted(rows)


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(6)
    entries = rng.integers(-5, 6, (16, 3)) * 100
    entries[9] = entries[2]  # a tie in every place
    x = np.concatenate([rng.integers(-600, 600, (2000, 3)), entries.repeat(20, 0) + rng.integers(-9, 9, (320, 3))])
    d = ((x[:, None] - entries) ** 2).sum(2)
    for start in (np.zeros(len(x), np.int64), d.argmin(1)):
        best, least, seen = exponion.exponion(x, entries, start)
        assert (best == d.argmin(1)).all() and (least == d.min(1)).all()
    assert seen < 0.6 * d.size


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '/root/testdata/{sf}/embeddings.parquet'")
    want = db.execute(ORACLE["op12_exponion_codes"])
    names = [x[0] for x in want.description]
    assert sorted(tuple(r[n] for n in names) for r in exponion.op12_exponion_codes(spark, f"/root/testdata/{sf}").collect()) == sorted(want.fetchall())
