"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from inkspan.llm import chat, components, forest, mixing, multiset, packing, pii, quality, simhash, substrings, token_output, tokens
from inkspan.sources.scratch import scratch

LONG = "one two three four five six seven eight nine ten. " * 60
ROWS = [(8, "a <|endoftext|> b<|startoftext|>", "b"), (0, LONG, "a"), (1, LONG, "a"), (2, None, None), (3, "", "b"), (4, "Hello, World! naïve café", "b"), (5, "x " * 3000, "c"), (6, "para one\npara two\nlast", "a"), (7, LONG.replace("seven", "zeven"), "c"), (None, "no id here", "a"), (4, "Hello, World! naïve café", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, 1) for i, t, s in ROWS], "doc_id long, text string, source string, n_entities int").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


UNTOUCHED = tokenizers.Tokenizer.from_file(tokens.default_tokenizer())


def ids_of(t):
    return UNTOUCHED.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_exact():
    import pyarrow as pa

    texts = [t for _, t, _ in ROWS] + ["don't J̌ ǰ İx ΑΣ a\x00b <|endoftext|> !!x ﬁ é 42.1", "a <|endoftext|> b", "x<|startoftext|>y<|endoftext|><|ENDOFTEXT|>", "<|endoftext |>", "<|endoftext|>" * 50, "z" * 100_000, "\u3000a\u2028b\xa0c"]
    ids, at = tokens.encoder(tokens.default_tokenizer()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(t) for t in texts]


def test_packing(docs, empty):
    rows = packing.pack_documents(docs).collect()
    whole = {(i, crc([*ids_of(t), 1])) for i, t, _ in ROWS}
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append(r)
        assert r.doc_id is None or any(crc(([*ids_of(t), 1])[r.start : r.start + r.length]) == r.ids_crc32 for i, t, _ in ROWS if i == r.doc_id)
    for s in used.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist() and sum(r.length for r in s) <= 2048
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) + 1 for _, t, _ in ROWS) and whole
    assert packing.pack_documents(empty).count() == 0


def test_packing_of_instruction_data(spark):
    """Prompts bear no loss; each of the three limits binds somewhere; nothing is lost."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["ask"] * int(rng.integers(0, 40))) or None, " ".join(["say"] * int(rng.integers(0, 60)))) for i in range(300)] + [(300, "ask " * 500, "say " * 500), (301, None, None)]
    limits = packing.Limits(64, 3, 24)
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, question string, text string").repartition(2), limits=limits, prompt="question").collect()
    seq = {}
    for r in out:
        seq.setdefault(r.sequence_id, []).append(r)
    sums = [(sum(r.length for r in s), len(s), sum(r.loss for r in s)) for s in seq.values()]
    assert all(t <= 64 and k <= 3 and x <= 24 for t, k, x in sums) and {64} <= {t for t, _, _ in sums} and {3} <= {k for _, k, _ in sums} and {24} <= {x for _, _, x in sums}
    for i, q, a in rows:
        own = sorted((r.start, r.length, r.loss) for r in out if r.doc_id == i)
        n, m = len(ids_of(q)), len(ids_of(a)) + 1
        assert [s for s, _, _ in own] == np.cumsum([0, *(k for _, k, _ in own)])[:-1].tolist() and sum(k for _, k, _ in own) == n + m and sum(x for _, _, x in own) == m


def test_packer_limits():
    p = packing.VectorPacker(packing.Limits(10, 2, 6), cut=False)
    for k, (n, loss) in enumerate([(5, 5), (5, 1), (3, 3), (2, 0), (1, 1)]):
        p.add(k, 0, n, loss)
    while p.waiting:
        b = p.bin()
        assert sum(x[2] for x in b) <= 10 and len(b) <= 2 and sum(x[3] for x in b) <= 6


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, docs, empty, bits):
    for d, rows in ((docs, ROWS), (empty, [])):
        path = scratch(spark, "t")
        got = token_output.read_token_files(token_output.write_token_files(d, path, bits=bits, partitions=3), path).orderBy("start").collect()
        want, start = [], 0
        for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = [*ids_of(t), 2]
            want.append((i, start, len(ids), crc(ids)))
            start += len(ids)
        assert [tuple(r) for r in got] == want


def test_mixing(docs, empty):
    r = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    assert len(r) == len(ROWS) and all(x.taken <= 2 * x.size and x.source_size == sizes[x.source] for x in r)
    for s in sizes:
        own = [x for x in r if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= max(20, 0.01 * own[0].target)
    assert abs(sum({x.source: x.target for x in r}.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_simhash(docs, empty):
    r = simhash.near_duplicates(docs).collect()
    fp = [(x.doc_id, int(x.fingerprint, 16), x.component_id) for x in r]
    root = list(range(len(fp)))
    for _ in fp:
        for i, a in enumerate(fp):
            for j, b in enumerate(fp):
                if (a[1] ^ b[1]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    for i, a in enumerate(fp):
        assert a[2] == min((b[0] for j, b in enumerate(fp) if root[j] == root[i] and b[0] is not None), default=None)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_crowded(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 63))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(120)})
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")

    def parts(edges):
        root = {simhash._signed(x): simhash._signed(x) for x in fps}

        def f(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[f(a)] = f(b)
        return sorted(sorted(y for y in root if f(y) == x) for x in {f(x) for x in root})

    brute = [(simhash._signed(a), simhash._signed(b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert parts(brute) == parts([tuple(x) for x in simhash.near_edges(df).collect()]) == parts([tuple(x) for x in simhash.near_edges(df, hot=2).collect()])


def test_near_copies(docs, empty):
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert {0, 4, 5, 6} <= kept and not {1} & kept and len(kept & {2, 3}) == 1
    assert simhash.one_of_each(empty).count() == 0


def test_next_of_wide_and_uneven_ids(spark):
    """Ids at both ends of long, far out and repeated ones."""
    ids = [-(1 << 63), (1 << 63) - 1, 0, 5, 5, None, *range(1000, 1400), 1 << 60]
    d = spark.createDataFrame([(x, f"t{i:04}", 7, "o") for i, x in enumerate(ids)], "doc_id long, text string, _bucket int, _lead string")
    out = multiset.with_next(d, ["text"], per_bucket=4, steps=16)
    got = {r.text: r.next.text for r in out.collect()}
    order = [r[2] for r in sorted(((x is not None, x or 0, f"t{i:04}") for i, x in enumerate(ids)), reverse=True)]
    assert got == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)} and out.columns == [*d.columns, "next"]


def test_multiset(docs, empty, spark):
    d = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = multiset.with_multiset(multiset.with_multiset(spark.createDataFrame([("a\nb\nc. d", "c. d\na\nb", "a\nb", "c. d")], "x string, y string, p string, q string"), "x", "fx"), "y", "fy")
    t = multiset.with_multiset(multiset.with_multiset(t, "p", "fp"), "q", "fq")
    r = t.select((F.col("fx") == F.col("fy")).alias("order"), (multiset.combine(F.col("fp"), F.col("fq")) == F.col("fx")).alias("insert"), (multiset.combine(F.col("fx"), F.col("fq"), -1) == F.col("fp")).alias("delete")).first()
    assert tuple(r) == (True, True, True)
    got = multiset.with_next(d, ["text"], per_bucket=2).select("doc_id", "next.text").collect()
    order = sorted([(i, t or "") for i, t, _ in ROWS if i is not None], reverse=True)
    want = sorted((order[k][0], order[(k + 1) % len(order)][1]) for k in range(len(order)))
    assert sorted(tuple(x) for x in got) == want
    assert multiset.with_next(d.where("false"), ["text"]).count() == 0


def test_repeats(docs, empty):
    from collections import Counter

    texts = [(t or "").encode() for _, t, _ in ROWS]
    c = Counter(b[s : s + 200] for b in texts for s in range(len(b) - 199))
    want = []
    for (i, _, _), b in zip(ROWS, texts):
        m = [False] * len(b)
        for s in range(len(b) - 199):
            if c[b[s : s + 200]] > 1:
                m[s : s + 200] = [True] * 200
        want.append((i, len(b), sum(m), sum(m[k] and (k == 0 or not m[k - 1]) for k in range(len(m))), hashlib.sha256(bytes(x for x, q in zip(b, m) if not q)).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in substrings.remove_repeats(docs).collect()), key=key) == sorted(want, key=key)
    assert substrings.remove_repeats(empty).count() == 0


def test_pii(spark, docs, empty):
    text = "Mr. John Smith (j.smith@corp.org, +1 (988) 555-2485) met Frau Anna Berg; j.smith@corp.org at 44.161.181.40, 4041894974608795, password=b7db7aa4a5fcc78305"
    d = spark.createDataFrame([(1, text), (2, "j.smith@corp.org"), (3, "nothing"), (4, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in pii.replace_pii(d).collect()}
    for gone in ("John", "Smith", "Berg", "corp", "555", "44.161", "40418", "b7db7"):
        assert gone not in r[1].text
    assert r[2].text in r[1].text and r[1].text.startswith("Mr. ") and "Frau " in r[1].text and r[3].text == "nothing" and r[4].text is None and r[4].n_entities == 0
    assert pii.replace_pii(docs).columns.count("n_entities") == 1 and pii.replace_pii(empty).count() == 0
    many = spark.range(3000).select(F.lit("ip").alias("kind"), F.concat(F.lit("9.9."), (F.col("id") / 250).cast("int"), F.lit("."), F.col("id") % 250).alias("v"))
    s = pii.surrogates(many, "k")
    assert s.select("s").distinct().count() == s.count() == many.count()


def test_pii_coreference(spark):
    """Spellings of one person, address and number stay recognisable as one; others stay apart."""
    text = "Mr. John Smith and Mr Smith wrote. Mr. Smith, John Smith, Smith; Smithson stays. Mrs Eva Smith-Bond. Господин Иван Петров. J.Smith@corp.org j.smith@corp.org j.smith@corp.com 4041-8949-7460-8795 4041 8949 7460 8795 4041894974608796"
    d = spark.createDataFrame([(1, text, "a", "b", "c"), (2, "Mr. Smith alone", "a", "b", "c"), (3, "John Smith stays here", "a", "b", "c")], "doc_id long, text string, _md5 string, _found string, _map string")
    out = pii.replace_pii(d)
    r = {x.doc_id: x for x in out.collect()}
    assert out.columns == [*d.columns, "n_entities"] and r[1]._md5 == "a" and r[3].text == "John Smith stays here"
    w = r[1].text
    given, family = w.split()[1:3]
    assert w.startswith(f"Mr. {given} {family} and Mr {family} wrote. Mr. {family}, {given} {family}, {family}; Smithson stays. Mrs ") and r[2].text == f"Mr. {family} alone"
    assert "John" not in w and "Eva" not in w and "Bond" not in w and "Иван" not in w and "Господин " in w
    a, b, c, *numbers = w[w.index("Господин") :].split(". ")[1].split(" ")
    assert a != b and a.lower() == b.lower() and a[0].isupper() and a[:7].lower() == b[:7] and c.lower() != b.lower()
    one, two = "".join(numbers[0].split("-")), "".join(numbers[1:5])
    assert one == two and len(one) == 16 and numbers[0].count("-") == 3 and numbers[5] != one


def test_pii_hard_texts(spark):
    """Long runs neither crash nor take long."""
    texts = ["x@" + "a." * 6000, "x" * 200_000, "a@" * 50_000, "1" * 100_000, "1-" * 50_000, "Mr. " + "A" + "b" * 100_000, "+1" * 50_000, "password=" + "'" * 50_000, "AB12" * 30_000, "Mr " * 5_000, "x@b" + ".c" * 60 + ".com", "Mr. Ann Bo " * 3000]
    out = pii.replace_pii(spark.createDataFrame([(i, t + " end") for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(out) == len(texts) and all(r.text.endswith(" end") for r in out)


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok &lt;| &amp; \n x"
    rows = [(1, 0, "system", "be nice"), *[(1, k, ("user", "assistant")[k % 2 == 0], f"{said} {k} " * 40) for k in range(1, 9)], (2, 0, None, None), (None, 0, "assistant", "y"), (3, 0, "system", "only")]
    r = {x.conv_id: x for x in chat.read_windows(chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2, None, 3):
        own = [(ro or "", t or "") for i, _, ro, t in rows if i == c]
        assert [tuple(t) for t in r[c].turns] == own and r[c].loss_text == "".join(t for ro, t in own if ro == "assistant")
    assert r[1].n_windows > 1
    assert chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_long_conversations(spark):
    """Blocks of turns: every turn is new once, windows keep the budget, history is what directly precedes the span."""
    said = lambda i: " ".join(["w"] * (i * 7 % 23))
    for sys in (0, 1):
        rows = [(1, i, "system" if sys and not i else ("user", "assistant")[i % 2], f"t{i} {said(i)}") for i in range(700)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        w = sorted(chat.format_windows(df, budget=300, history=90).collect(), key=lambda r: r.window)
        assert len({r.window for r in w}) == len(w) and w[0].window == 0
        seen = 0
        for r in w:
            own = [x.split("<|im_end|>")[0].split("\n", 1)[1] for x in r.formatted.split("<|im_start|>")[1:]]
            assert sum(len(x.split()) + 4 for x in own) <= 300
            at = [int(x.split()[0][1:]) for x in own]
            new = at[r.first_new :]
            assert new == list(range(seen, seen + len(new))) and at[r.first_new - len(at[sys : r.first_new]) : r.first_new] == list(range(seen - len(at[sys : r.first_new]), seen)) if seen else r.first_new == 0
            if seen and (back := seen - len(at[sys : r.first_new]) - 1) >= sys:  # one turn more would not have fit
                assert sum(len(rows[k][3].split()) + 4 for k in range(back, seen)) > 90
            seen += len(new)
        assert seen == 700
        got = chat.read_windows(chat.format_windows(df, budget=300, history=90)).first()
        assert [tuple(t) for t in got.turns] == [(x[2], x[3]) for x in rows]
        assert got.loss_text == "".join(x[3] for x in rows if x[2] == "assistant")


def test_forest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (None, [1.0] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.search(v, v.where("vec_id % 20 = 0"), k=10, block=200).collect()
    hit = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:10].tolist()))
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
    assert hit / 300 >= 0.9


def test_quality(spark, empty):
    rows = [(i, "Good clean words here. And more of it." if i % 3 else "BUY!! NOW!! NOW!! $$$") for i in range(60)] + [(60, ""), (61, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(3, None)], "doc_id long, quality int")
    r = quality.score_quality(d, quality.fit_quality(d, labels)).collect()
    assert all((x.score >= 0.3) == (x.doc_id % 3 > 0) and 0 <= x.score <= 1 for x in r if x.doc_id < 60) and len(r) == 62
    assert quality.score_quality(d.withColumn("score", F.lit(1)), quality.fit_quality(d, labels.where("false"))).count() == 62


def test_wide_fingerprints_follow_similarity():
    """512 bits: the share that differs is near arccos(2s / (1 + s)) / pi for sets of Jaccard similarity s."""
    import math

    import numpy as np
    import xxhash

    from inkspan.llm.simhash import _widest_bits

    assert _widest_bits([]) == bytes(64)
    for s in (0.5, 0.7, 0.8, 0.9):
        shared = round(4000 * 2 * s / (1 + s))
        a = [xxhash.xxh3_128_digest(b"%d" % i) for i in range(4000)]
        b = a[:shared] + [xxhash.xxh3_128_digest(b"x%d" % i) for i in range(4000 - shared)]
        x, y = (np.frombuffer(_widest_bits(v), np.uint8) for v in (a, b))
        p = math.acos(2 * s / (1 + s)) / math.pi
        assert abs(int(np.bitwise_count(x ^ y).sum()) - 512 * p) < 4 * math.sqrt(512 * p * (1 - p))


def test_near_copies_share_a_block():
    """Sets of Jaccard similarity 0.8 share a block key; strangers don't."""
    rng = np.random.default_rng(5)
    for n in (9, 90, 900):
        for _ in range(100):
            x = rng.integers(0, 1 << 63, n * 10 // 9, np.uint64)
            a, b, c = x[:n], x[len(x) - n :], rng.integers(0, 1 << 63, n, np.uint64)
            ka, kb, kc = (simhash.min_hash_keys(v) for v in (a, b, c))
            assert set(ka) & set(kb) and not set(ka) & set(kc)


def test_near_copies_of_edited_texts(spark):
    """Copies with one word in sixty exchanged, so that most long words differ from those of the first: none is left."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(40):
        words = [f"word{x}" for x in rng.integers(0, 1 << 30, 600)]
        rows.append((k, " ".join(words)))
        for i in rng.choice(120, 11, False):
            words[i * 5] = f"other{i}{k}"
        rows.append((100 + k, " ".join(words)))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(40))


def test_near_copies_below_the_limit_stay(spark):
    """Chains of texts whose neighbours have a similarity of 0.7 stay whole; sets of 0.8 are found among many."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(k, " ".join(words[k * 53 : k * 53 + 304])) for k in range(40)]  # 300 shingles, 247 in common: 0.7
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(40))


def test_spanning_edges():
    """At every limit, the forest's edges under it link what all pairs under it link."""
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 1 << 6, (60, 8)).astype(np.uint64)
    edges = simhash.spanning_edges(fp, 24)
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    for limit in (4, 10, 16, 24):
        x, y = np.nonzero(np.triu((d <= limit) & (d > -1), 1))
        e = np.array([(a, b) for a, b, w in edges if w <= limit]).reshape(-1, 2)
        for a, b in ((x, y),) if not len(x) else ((x, y), (e[:, 0], e[:, 1])):
            node, root = components.labels(a.astype(np.int64), b.astype(np.int64))
            got = dict(zip(node.tolist(), root.tolist()))
            if a is x:
                want = got
        assert got == want
    assert simhash.spanning_edges(fp[:1], 24) == []


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components(spark, one_task):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (420, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long"), "t", one_task=one_task).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {x: got.get(x, x) for x in root} == root
    assert components.components(spark.createDataFrame([], "a long, b long"), "t", one_task=one_task).count() == 0


def test_near_copies_in_one_crowded_bucket(spark):
    """Many edits of one text, portions of few rows: one is left; texts beside them stay."""
    rng = np.random.default_rng(6)
    base = [f"word{x}" for x in rng.integers(0, 1 << 30, 300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        words = list(base)
        for i in rng.choice(300, 4, False):
            words[i] = f"other{i}{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"w{k}x{i}" for i in range(40))) for k in range(20)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _node int, _row int")
    out = simhash.one_of_each(df, most=50)
    assert sorted(r.doc_id for r in out.collect()) == [0, *range(1000, 1020)] and out.columns == df.columns


def _recall(spark, x, k=20):
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in forest.search(v, v.where("vec_id % 5 = 0"), k=k).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = n = 0
    for q in range(0, len(x), 5):
        s = x @ x[q]
        s[q] = -np.inf
        want = min(k, len(x) - 1)
        assert len(got[q]) == want
        least = np.sort(s)[-want]
        hit += sum(r.score >= least - 1e-9 for r in got[q])
        n += want
    return hit / n


def test_forest_small_tables_copies_and_lengths(spark):
    rng = np.random.default_rng(4)
    unit = rng.standard_normal((600, 64))
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    for n in (10, 60, 100, 200):  # all candidates, if fewer
        assert _recall(spark, unit[:n]) >= 0.9
    copies = unit.copy()
    copies[:120] = unit[0]
    assert _recall(spark, copies) >= 0.9
    for sigma in (0.5, 1):
        assert _recall(spark, unit * np.exp(sigma * rng.standard_normal(600))[:, None]) >= 0.9


def test_likeness_of_long_repetitive_texts(spark):
    """A clause that occurs more than 8192 times counts in full; insert and delete agree with the whole."""
    other = "".join(f"clause {i}.\n" for i in range(200))
    rows = [(n, other + "again and again.\n" * n, other + "again and again.\n" * (n // 2), "again and again.\n" * (n - n // 2)) for n in (8000, 9000, 12000, 40000)]
    d = spark.createDataFrame(rows, "n long, whole string, cut string, rest string")
    for c in ("whole", "cut", "rest"):
        d = multiset.with_multiset(d, c, f"f_{c}")
    d = multiset.with_likeness(d, {"near": ("f_whole", "f_cut")})
    f = lambda m: (m["counters"], m["n"])
    assert all(r.near > 0.99 for r in d.collect())
    less = d.select("n", multiset.combine(F.col("f_whole"), F.col("f_cut"), -1).alias("x"), multiset.combine(F.col("f_cut"), F.col("f_whole"), -1).alias("y"), "f_whole", "f_cut")
    back = less.select(multiset.combine(F.col("x"), F.col("f_cut")).alias("x"), multiset.combine(F.col("y"), F.col("f_whole")).alias("y"), "f_whole", "f_cut").collect()
    assert all(f(r.x) == f(r.f_whole) and f(r.y) == f(r.f_cut) for r in back)


EXTRA = "fp long, key long, size string, rank int, n string, _row int, _bucket int, _own_digests int, _key int, first string, score string, conv string"


def test_long_texts_empty_tables_and_extra_columns(spark):
    """Every operator on long unbroken texts, on no rows, and beside columns named as its own."""
    texts = ["x" * 300_000, "é" * 100_000, " " * 100_000, "a b " * 30_000, "\n" * 50_000, None, ""]
    d = spark.createDataFrame([(i, t, "s", *[None] * 12) for i, t in enumerate(texts)], f"doc_id long, text string, source string, {EXTRA}")
    turns = d.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), "text", "rank", "n", "first")
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0], 0, "r") for i in range(7)], "vec_id long, embedding array<double>, rank int, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")

    def marked(x):
        x = multiset.with_multiset(multiset.with_next(x, ["text"]), "text", "own")
        return multiset.with_likeness(x, {"near": ("own", "own")})

    for x, n in ((d, 7), (d.where("false"), 0)):
        assert quality.score_quality(x, quality.fit_quality(x, labels)).count() == n
        assert chat.read_windows(chat.format_windows(turns.limit(n))).count() == n
        assert pii.replace_pii(x).count() == n and pii.replace_pii(x).columns == [*d.columns, "n_entities"]
        packed = packing.pack_documents(x).collect()
        assert len({r.doc_id for r in packed}) == n and sum(r.length for r in packed) == sum(len(ids_of(t)) + 1 for t in texts[:n])
        assert marked(x).count() == n and marked(x).columns == [*d.columns, "next", "own", "near"]
        assert substrings.remove_repeats(x).count() == n
        assert simhash.near_duplicates(x).count() == n and simhash.one_of_each(x).columns == d.columns
        path = scratch(spark, "t")
        assert token_output.read_token_files(token_output.write_token_files(x, path), path).count() == n
        assert mixing.mix(x).count() == n and mixing.mixed(x).columns == d.columns
        v = vectors.limit(n)
        assert forest.search(v, v, k=3).count() == 3 * n
    assert {r.doc_id for r in simhash.one_of_each(d).collect()} >= {0, 1, 2, 3} and len(simhash.one_of_each(d).collect()) == 4


SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id held_out score predicted", "op2": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op3": "doc_id text", "op4": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op6": "doc_id n_bytes n_removed n_spans kept_sha256", "op7": "doc_id fingerprint component_id", "op8": "query_id rank vec_id score",
    "op9": "doc_id start n_tokens ids_crc32", "op10": "doc_id size source_size target taken",
}


@pytest.fixture(scope="module")
def results(spark):
    """Every registered query on the smallest tables, collected once."""
    from inkspan.llm.registry import QUERIES

    return {name.split("_")[0]: q(spark, SF).collect() for name, q in QUERIES.items()}


@pytest.fixture(scope="module")
def corpus(spark):
    return sorted((r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_columns_of_all_queries(results, corpus):
    for op, columns in COLUMNS.items():
        assert set(columns.split()) <= set(results[op][0].asDict()), op
        if op not in ("op2", "op4", "op8"):
            assert sorted(r.doc_id for r in results[op]) == [i for i, _, _ in corpus], op
    assert results["pipeline"]


def test_quality_query(results):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in results["op1"])


def test_quality_on_held_out_labels(spark):
    """On the next larger tables: the smallest hold out 19 labels only, too few for a share."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in quality.op1_nb_svm_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_chat_query(results, spark):
    said = "<|im_end|><|im_start|>assistant ok"
    convs = {-1: [(0, "user", said), (1, "assistant", said)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    want = set()
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want.add((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in results["op2"]} == want


def test_fingerprint_query(results, corpus):
    order = corpus[::-1]
    by = {}
    for k, (i, t, _) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        by[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited)
    prints = {}
    for r in results["op5"]:
        assert (r.n_chars, r.edited_sha256) == by[r.doc_id][:2] and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        for text, fp in ((by[r.doc_id][2], r.fingerprint), (by[r.doc_id][3], r.edited_fingerprint)):
            prints.setdefault("\n".join(sorted(text.split("\n"))), set()).add(fp)
    assert all(len(v) == 1 for v in prints.values()) and len({min(v) for v in prints.values()}) == len(prints)


def test_packing_and_token_queries(results, corpus):
    ids = {i: [*ids_of(t)] for i, t, _ in corpus}
    pieces = {}
    for r in results["op4"]:
        own = [*ids[r.doc_id], 1]
        assert r.doc_tokens == len(own) and crc(own[r.start : r.start + r.length]) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, _, _ in corpus:
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids[i]) + 1
    start = 0
    for r in sorted(results["op9"], key=lambda r: r.doc_id):
        own = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), crc(own))
        start += len(own)


def test_mixing_query_against_sql(results):
    """Sizes and totals in SQL; targets by filling the sources up to their caps step by step."""
    import duckdb

    sql = f"""WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size FROM '{SF}/documents.parquet')
        SELECT doc_id, size, cast(sum(size) OVER (PARTITION BY source) AS bigint), source FROM d"""
    rows = duckdb.sql(sql).fetchall()
    assert sorted((r.doc_id, r.size, r.source_size) for r in results["op10"]) == sorted(r[:3] for r in rows)
    total = {s: n for _, _, n, s in rows}
    target = _targets(total)
    source = {i: s for i, _, _, s in rows}
    taken = dict.fromkeys(total, 0)
    for r in results["op10"]:
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(50, 0.01 * target[s]) for s in total)


def _targets(total):
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(total.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * total[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_stop_at_their_caps(spark):
    """Small sources with large weights are capped, and what is over goes to the others by weight."""
    rows = [(f"s{k}", n) for k, n in enumerate((10, 1000, 5000, 3, 700, 20, 0))] + [(None, 40)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = _targets(dict(rows))
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want) and abs(sum(got.values()) - 1.5 * sum(n for _, n in rows)) < 1e-6
    assert got["s0"] == 20 and got["s3"] == 6


def test_repeats_query(results, corpus):
    from collections import Counter

    texts = {i: t.encode() for i, t, _ in corpus}
    c = Counter(b[s : s + 200] for b in texts.values() for s in range(len(b) - 199))
    for r in results["op6"]:
        b = texts[r.doc_id]
        m = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 199):
            if c[b[s : s + 200]] > 1:
                m[s : s + 200] = True
        kept = bytes(x for x, q in zip(b, m) if not q)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(m.sum()), int((m[1:] < m[:-1]).sum()), hashlib.sha256(kept).hexdigest())


def test_search_query(results, spark):
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None}
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids])
    hit = n = 0
    for q in ids[ids % 20 == 0]:
        s = x @ v[q]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        own = sorted((r.rank, r.vec_id) for r in results["op8"] if r.query_id == q)
        assert [k for k, _ in own] == list(range(1, min(20, len(ids) - 1) + 1))
        hit += len({i for _, i in own} & set(best.tolist()))
        n += len(best)
    assert hit >= 0.9 * n
