"""The Merkle manifest against a tree built by hand, and against its SQL."""

import hashlib
import zlib

import duckdb
import pytest

from inkspan.llm import merkle
from inkspan.llm.registry import ORACLE


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(r, text):
    parts = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in parts))


def tree(nodes):
    """The root, and for each node the (before, after) of each level."""
    level, paths, place = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, p in enumerate(place):
            run, at = runs[p // 8], p % 8
            paths[k].append(("".join(run[:at]), "".join(run[at + 1 :])))
            place[k] = p // 8
        level = [sha(*r) for r in runs]
    return level[0], paths


def wanted(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in names:
        langs[x].sort(key=lambda t: t[:3])
        trees[x] = tree([t[2] for t in langs[x]])
    root, above = tree([trees[x][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for (_, _, own, r), path in zip(langs[x], trees[x][1]):
            path, t = path + above[k], r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and t is not None:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            folded = leaf(r, t)
            for a, b in path:
                folded = sha(a, folded, b)
            out.append((r["doc_id"], own, trees[x][0], root, sha(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, idx int, bucket string"
ODD = [
    (7, "a", "en", 3, "Ab É"), (7, "a", "en", 3, "Ab É"), (None, None, None, None, None), (None, "s", "en", 0, ""), (0, "a", "de", 1, "X"), (3, "é", "de", 10, "ALL CAPS"), (-5, "a", "", 1, "x"),
    (12, "a", "ÿ", 1, "Y" * 30000), (13, "a", "zz", 1, "- 1:x"), (15, "", "-", 1, None), (16, "", "=", 1, "q"), (17, "a", "\U00010000", 1, "Z"), (18, "a", "\uffee", 1, "Z"), (19, "a", "x", None, "T"), (21, "a", "y", 2, "T"),
]


@pytest.mark.parametrize("rows", [ODD, [(k // 2, "s", "en", k % 5, f"Text {k // 3}") for k in range(9000)] + ODD[:3], ODD[:1], []])
def test_manifest(spark, rows):
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS).repartition(3)
    got = sorted((tuple(r) for r in merkle.merkle_manifest(d).collect()), key=str)
    assert got == (wanted([dict(zip(COLUMNS.replace(" long", "").replace(" string", "").split(", "), r)) for r in rows]) if rows else [])


def test_small_buckets(spark):
    """Small buckets, so that there are levels over levels of them; many groups, so that their roots have levels, too."""
    rows = [(k, "s", f"l{k % 70}" if k % 3 else "en", k, f"Text {k}") for k in range(1500)]
    got = sorted((tuple(r) for r in merkle.merkle_manifest(spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS), inner=1).collect()), key=str)
    assert got == wanted([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows])


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = db.execute(ORACLE["op11_merkle_manifest"])
    names = [x[0] for x in want.description]
    assert sorted(tuple(r[n] for n in names) for r in merkle.op11_merkle_manifest(spark, sf).collect()) == sorted(want.fetchall())
