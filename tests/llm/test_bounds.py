"""What a budget and a bound promise, on inputs made to break them."""

from pyspark.sql import functions as F

from inkspan.llm import chat, quality


def test_unbroken_runs_have_their_price(spark):
    """Long runs without a space count by their length, signs of scripts without spaces one by one."""
    rows = [(1, i, ("user", "assistant")[i % 2], "\u6f22" * 900) for i in range(40)] + [(2, i, "assistant", "x" * 5000) for i in range(20)]
    w = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=1024).collect()
    assert all(len(r.formatted) < (1300 if r.conv_id == 1 else 5400) for r in w) and sum(r.conv_id == 1 for r in w) == 40
    n = spark.sql("SELECT '漢字 abc' AS t UNION ALL SELECT 'abcdefgh, 12' UNION ALL SELECT ''").select(chat.tokens(F.col("t")).alias("n")).collect()
    assert [r.n - 4 for r in n] == [3, 4, 0]


def test_prices_from_a_column(spark):
    rows = [(1, i, "user", f"t{i}", 100 if i % 2 else None) for i in range(20)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    w = chat.format_windows(d, budget=250, history=0, price="n").collect()
    assert sorted(r.formatted.count("<|im_start|>") for r in w) == [5] * 4 or max(r.formatted.count("<|im_start|>") for r in w) <= 5
    assert [tuple(t) for t in chat.read_windows(chat.format_windows(d, budget=250, history=60, price="n")).first().turns] == [("user", f"t{i}") for i in range(20)]


def test_fit_is_bounded_with_repeated_rows(spark, monkeypatch):
    """One doc_id two thousand times: no more rows and indicators come to the driver than the bounds allow."""
    rows = [(1, f"one two three four five {k}") for k in range(2000)] + [(k, "good words here" if k % 2 else "bad junk there") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    got = []
    monkeypatch.setattr(quality.NbSvm, "fit", lambda self, found, y: got.append((sum(map(len, found)), len(found))) or self)
    for most, bound in ((8000, 3000), (50, 10**9), (8000, 10**9), (8000, 1)):
        quality.fit_quality(docs, labels, most, bound)
        assert got[-1][0] <= bound and got[-1][1] <= most
    assert got[1][1] == 50 and got[2][1] > 2000 and got[3] == (0, 0) and got[0][1] > 0
    quality.fit_quality(docs.repartition(7), labels, 8000, 3000)
    assert got[-1] == got[0]
