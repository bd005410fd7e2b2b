"""Elements as rows against the tree of the record reader."""

import random

from inkspan.functions.markup import Mark, Node, tree
from inkspan.operators import trees
from inkspan.plans.corpus import corpus

ODD = [
    None, "<a/>", "<a></a>", '<?xml version="1.0"?><!-- <b> --><a x="1" y=\'2 > 1\'>t<b/>u<b>v</b><!-- <c/> --><?p <d>?>w</a>', "<a>x<![CDATA[<b>&</b>]]>y</a>", "<a><a><a><a/></a></a><a/></a>",
    '<!DOCTYPE a [\n<!ENTITY e "<q>">\n]><a>\n <b a:b="c/d"  e = "f" /></a>', "<é><日本 ä='ö'>x</日本></é>", "<a><b></b><b/><b><c/></b><b/></a>",
]


def rows(raw):
    out = []

    def walk(e, depth):
        at = len(out)
        out.append(None)
        for k in e.kids:
            if isinstance(k, Node):
                walk(k, depth + 1)
        own = "".join(k for k in e.kids if not isinstance(k, (Node, Mark)))
        out[at] = (at + 1, len(out), depth, e.tag, [tuple(x) for x in e.attrs], own)

    walk(tree(raw)[0], 1)
    return out


def made(n):
    rng = random.Random(3)

    def element(depth):
        name, attrs = rng.choice("abc"), "".join(f' {k}="{rng.choice(["", "1", "a b", ">", "x/y"])}"' for k in rng.sample("xyz", rng.randrange(3)))
        kids = [element(depth + 1) if rng.random() < 0.6 and depth < 7 else rng.choice(["t", " ", "\n", "<!-- n -->", "é"]) for _ in range(rng.randrange(5))]
        return f"<{name}{attrs}/>" if not kids and rng.random() < 0.5 else f"<{name}{attrs}>{''.join(kids)}</{name}>"

    return [element(0) for _ in range(n)]


def test_elements_are_those_of_the_tree(spark):
    raws = ODD + made(300)
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(raws)], "id int, raw string, pre_ int").repartition(3)
    out = trees.elements(df, ["id"])
    got = {}
    for r in out.orderBy("id", "pre").collect():
        got.setdefault(r.id, []).append((r.pre, r.last, r.depth, r.name, [tuple(a) for a in r.attributes], r.own_text))
    for k, x in enumerate(raws):
        assert got.get(k, []) == ([] if x is None else rows(x)), x
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_elements_of_the_corpus(spark):
    c = corpus(spark, "/root/testdata/sf0.001").where("doc_id % 6 < 4").collect()
    df = spark.createDataFrame([(r.doc_id, r.raw) for r in c], "doc_id long, raw string")
    got = {}
    for r in trees.elements(df, ["doc_id"]).orderBy("doc_id", "pre").collect():
        got.setdefault(r.doc_id, []).append((r.pre, r.last, r.depth, r.name, [tuple(a) for a in r.attributes]))
    assert got == {r.doc_id: [x[:5] for x in rows(r.raw)] for r in c}


def test_below_and_paths(spark):
    found = trees.elements(spark.createDataFrame([(1, "<a><b><c/><b><c/></b></b><c/></a>"), (2, "<c><c/></c>")], "id int, raw string"), ["id"])
    look = lambda df, *c: sorted(tuple(r) for r in df.select("id", "pre", *c).collect())
    assert look(trees.below(found, ["id"], "b"), "above") == [(1, 3, 2), (1, 4, 2), (1, 5, 2), (1, 5, 4)]
    assert look(trees.below(found, ["id"], "b", child=True), "above") == [(1, 3, 2), (1, 4, 2), (1, 5, 4)]
    assert look(trees.path(found, ["id"], "a", "b", "b", "c")) == [(1, 5)] and look(trees.path(found, ["id"], "c", "c")) == [(2, 2)]


def test_prologs(spark):
    raws = [
        '<?xml version="1.0" encoding=\'UTF-8\' standalone="yes"?>\n<!-- x -->\n<!DOCTYPE a PUBLIC "-//P" "s.dtd" [\n<!ENTITY e "x">\n]>\n<a/>', "<!DOCTYPE b><b/>", "<c/>", None, '<d x="<!DOCTYPE"/>', " " * 5000 + "<e/>", "<!-- " * 3000,
    ]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "id int, raw string")
    got = [tuple(r.p) for r in df.select("id", trees.prolog(df.raw).alias("p")).orderBy("id").collect()]
    assert got[:2] == [("1.0", "UTF-8", "yes", "a", "-//P", "s.dtd", '\n<!ENTITY e "x">\n'), (None, None, None, "b", None, None, None)] and all(x == (None,) * 7 for x in got[2:])
