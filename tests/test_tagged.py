"""Tagged text in DataFrame functions against the record reader, row for row."""

import random

from inkspan.functions.records import _APS_SECTIONS, tagged_fields
from inkspan.operators import tagged
from inkspan.plans.corpus import corpus

ODD = [
    None, "", "\n\n", "PATN", "HHHHHT APS1 ISSUE\nPATN  \n\nWKU  1", "WKU  043757022 \r\nTTL  A\r\n     b\r\n\r\n     c\r\n", "TTL\n\n     first\n     \n      second ", "TTL  \n    x\n          y",
    " lost\nTTL  t", "ABST\nPAL  x\nBSUM\n     goes on with PAL\nPAC  H", "TBL  1   2 \n\n     3\nTBL3 a\n      b\nEQU  \n\n", "é", "abé", "abcé def", "abcdé x", "日本語テキスト", "TTLé x", "TTL é", "TTL  é\n     日本",
    "PATN\nWKU  1\nPATN\nINVT\nNAM  A; B\nCTY  C\nCTY  D\nSTA  E\nINVT\nCNT  F\nNAM  ;\nCLMS\nSTM  We claim\nPAR  0. before\nNUM  1.\nPAR  1. x\nPA1  y\nNUM  2.\nNUM  3.\nPAR  &lt;z&gt;\nDCLM\nPAL  design\nNUM  kept",
    "INVT\nCTY  nobody\nHHHHH later", "\u2003\u2003\nTTL  a\u2003\n\u2003\u2003\n     \u2003b", "\x85TTL  x", "A\nBB\nCCC\nDDDD\nEEEEE\nFFFFFF\nGGGGGGG",
]


def made(n):
    rng = random.Random(5)
    tags = [*sorted(_APS_SECTIONS), "TTL", "PAR", "TBL", "EQU", "NUM", "NAM", "PAL", "é", "xé", ""]
    texts = ["", " ", "word", "  two  words ", "é", "日本", "\u2003", "a;b"]
    line = lambda: rng.choice(["", "     ", f"     {rng.choice(texts)}", f"{rng.choice(tags):<4} {rng.choice(texts)}", rng.choice(tags), rng.choice(texts), "HHHHH", "\r"])
    return ["\n".join(line() for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_fields_are_those_of_the_reader(spark):
    raws = ODD + made(1500)
    df = spark.createDataFrame([(k, x, "key") for k, x in enumerate(raws)], "id int, raw string, tag_ string").repartition(4)
    out = tagged.fields(df, ["id"])
    got = {}
    for r in out.orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append([r.section, r.tag, r.value])
    for k, x in enumerate(raws):
        assert got.get(k, []) == tagged_fields(x or ""), repr(x)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_fields_of_the_corpus(spark):
    c = corpus(spark, "/root/testdata/sf0.001").where("doc_id % 6 = 4")
    got = {}
    for r in tagged.fields(c, ["doc_id", "shard"]).orderBy("doc_id", "pos").collect():
        got.setdefault((r.doc_id, r.shard), []).append([r.section, r.tag, r.value])
    assert got == {(r.doc_id, r.shard): tagged_fields(r.raw) for r in c.collect()}


def test_groups(spark):
    found = tagged.fields(spark.createDataFrame([(1, ODD[19]), (2, ODD[20]), (3, None)], "id int, raw string"), ["id"])
    people = [tuple(r) for r in tagged.inventors(found, ["id"]).orderBy("id", "pos").collect()]
    assert people == [(1, 0, "A", "B", "D", "E", "F", True), (1, 1, None, None, None, None, None, False)]
    said = [tuple(r) for r in tagged.claims(found, ["id"]).orderBy("id", "number").collect()]
    assert said == [(1, 1, "0. before"), (1, 2, "1. xy"), (1, 3, "<z>"), (1, 4, "designkept")]
