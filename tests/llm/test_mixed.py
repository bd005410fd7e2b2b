"""The mix as documents and pieces in the order of its slots."""

from pyspark.sql import functions as F

from inkspan.llm import mixing


def words(t):
    return len((t or "").split())


def test_sources_have_what_is_taken(spark):
    """Each source has exactly the words that are taken of it, one of a single long document, too."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(k % 60)), "many", k % 60) for k in range(1500)] + [(9000, "long " * 100_000, "one", 500_000), (9001, None, "none", None), (9002, "  \n", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").repartition(4)
    out = mixing.mixed(docs)
    got = out.collect()
    took = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    mine = {}
    for r in got:
        mine[r.source] = mine.get(r.source, 0) + words(r.text)
    assert mine == {s: n for s, n in took.items() if n}
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(n - target[s]) <= max(60, 0.01 * target[s]) for s, n in mine.items())
    assert out.columns == docs.columns and sorted(len((r.text or "").split()) for r in got if r.source == "one")[-1] == 100_000
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id].startswith(r.text) and (r.text == texts[r.doc_id] or r.n_chars == len(r.text)) for r in got)


def test_any_stretch_has_the_weights(spark):
    """In the order of the output, sources are interleaved, not one after another; reruns agree."""
    rows = [(k, "a b c d e f g h", "xyz"[k % 3]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    first, again = mixing.mixed(docs).collect(), mixing.mixed(docs.repartition(3)).collect()
    assert first == again
    share = {s: sum(r.source == s for r in first) / len(first) for s in "xyz"}
    for i in range(0, len(first) - 400, 200):
        part = [r.source for r in first[i : i + 400]]
        assert all(abs(part.count(s) / 400 - share[s]) < 0.06 for s in "xyz")


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three", "a")] * 50 + [(2, "four", "b")], "doc_id long, text string, source string")
    n = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = mixing.mixed(docs).collect()
    assert {s: sum(words(r.text) for r in got if r.source == s) for s in "ab"} == n
    assert mixing.mixed(docs.where("false")).count() == 0
