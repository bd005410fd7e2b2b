"""Near copies in dense families near the limit, against exact similarities of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm import components, simhash


def family(words, edits, n, seed):
    """n texts that are one text with some words exchanged, each text on its own."""
    rng = np.random.default_rng(seed)
    base = [f"f{seed}w{i}" for i in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for i in rng.choice(words, edits, False):
            text[i] = f"x{seed}n{k}i{i}"
        out.append(text)
    return [" ".join(t) for t in out]


def groups(texts, least=0.8):
    """The number of groups of texts, by the exact similarity of all pairs."""
    sets = [{" ".join(x) for x in zip(*(w[i:] for i in range(5)))} for w in map(str.split, texts)]
    number = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    bits = np.zeros((len(sets), -(-len(number) // 64) * 64), bool)
    for row, s in zip(bits, sets):
        row[[number[x] for x in s]] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    size = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    for a in range(len(sets)):
        both = np.bitwise_count(packed[a] & packed[a + 1 :]).sum(1)
        for b in (a + 1 + np.flatnonzero(both >= (least - 1e-9) * (size[a] + size[a + 1 :] - both))).tolist():
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
    return len(set(root.tolist()))


#: Words and edits a text; in the first three, most pairs are just under the limit.
FAMILIES = [(400, 6), (1000, 14), (200, 3), (100, 2), (400, 5)]


def test_dense_families(spark):
    texts = [family(w, e, 600, k) for k, (w, e) in enumerate(FAMILIES)]
    rows = [(k * 1000 + i, t) for k, f in enumerate(texts) for i, t in enumerate(f)]
    kept = [r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id").collect()]
    got = np.bincount(np.array(kept) // 1000, minlength=len(FAMILIES)).tolist()
    want = [groups(f) for f in texts]
    assert got == want and want[0] > 100 and want[4] < 10


def chunks(spark, sets):
    return spark.createDataFrame([(0, k, np.array(sorted(s), np.uint32).tobytes()) for k, s in enumerate(sets)], "root long, node long, set binary")


@pytest.mark.parametrize("portion", [2048, 40])
def test_links_of_one_family(spark, portion, monkeypatch):
    """In one task or in portions and blocks: the same components, those of all pairs."""
    monkeypatch.setattr(simhash, "PORTION", portion)
    monkeypatch.setattr(simhash, "HUBS", 3)
    rng = np.random.default_rng(3)
    sets = []
    for k in range(6):  # six themes of 50 sets, linked within, with a few strangers
        base = rng.choice(1 << 30, 60, False)
        sets += [set(base[rng.random(60) < 0.93].tolist()) | set(rng.integers(0, 1 << 30, 2).tolist()) for _ in range(50)]
    sets += [set(rng.integers(0, 1 << 30, 50).tolist()) for _ in range(9)]
    links = simhash.verified_links(chunks(spark, sets), 0.8).collect()
    similar = lambda a, b: len(a & b) / len(a | b) >= 0.8 - 1e-9
    assert all(similar(sets[x.a], sets[x.b]) for x in links)
    pairs = np.array([(a, b) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])])
    want, got = (dict(zip(*map(np.ndarray.tolist, components.labels(p[:, 0], p[:, 1])))) for p in (pairs, np.array([(x.a, x.b) for x in links])))
    assert got == want and len(links) < len(pairs) // 2


def test_exact_links_at_the_limit():
    a, b, c = np.arange(8), np.arange(10), np.arange(10, 20)
    sets = [x.astype(np.uint32) for x in (a, b, c, np.arange(0), np.arange(7))]
    assert simhash.exact_links(sets, np.arange(5), np.arange(5), 0.8) == [(0, 1), (0, 4)]
    assert simhash.exact_links(sets, np.array([0, 0, 2, 3, 4]), np.array([1]), 0.8) == []
    assert simhash.exact_links([], np.arange(0), np.arange(0), 0.8) == []


def test_crowded_keys_keep_links(spark):
    """A family of more rows than a portion of a bucket holds."""
    texts = family(300, 2, 900, 7)
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert simhash.one_of_each(d, most=64).agg(F.count("*"), F.min("doc_id")).collect() == [(groups(texts), 0)]
