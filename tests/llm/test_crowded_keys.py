"""Rows of crowded block keys, and of keys on both sides of a range's end: all pairs count."""

import numpy as np

from inkspan.llm import simhash


def pairs(n, seed):
    """2 n fingerprints of 64 bytes: each of the first n has one of the others that differs in 5 bits; else they are strangers."""
    rng = np.random.default_rng(seed)
    one = rng.integers(0, 256, (n, 64), np.uint8)
    other = one.copy()
    other[:, 3] ^= 0b11111
    return np.concatenate([one, other])


def test_crowded_key_links_all_pairs(spark, monkeypatch):
    n = 600
    monkeypatch.setattr(simhash, "CELL", 128)
    rows = [(7, i % 600 * 31 % 600 if i < n else 10_000 - i, i, bytes(x)) for i, x in enumerate(pairs(n, 1))]
    blocks = spark.createDataFrame(rows, "key long, near long, node long, s binary").repartition(3)
    got = {(r.node, r.root) for r in simhash.linked_families(blocks, 112, 64).collect()}
    assert got == {(i + n, i) for i in range(n)}


def test_keys_over_range_ends(spark):
    n = 40  # each key's rows: two families of alternating members, far apart in the order within the key
    rows = []
    for key in range(30):
        for i, x in enumerate(pairs(n, key)):
            rows.append((key, i, key * 1000 + i, bytes(x)))
    blocks = spark.createDataFrame(rows, "key long, near long, node long, s binary")
    got = {(r.node, r.root) for r in simhash.linked_families(blocks, 112, 4096).collect()}
    assert got == {(k * 1000 + i + n, k * 1000 + i) for k in range(30) for i in range(n)}
