"""Formats that are added at run time take part in detection and parsing; table functions for parties and records."""

import pytest
from pyspark.sql import functions as F

from inkspan import api
from inkspan.functions import formats
from inkspan.functions.records import StructureError
from inkspan.operators import project
from inkspan.operators.parse import detect, parse
from inkspan.plans.corpus import corpus


def pipes_adapter():
    """A class that executors can't import goes with the job as it is."""

    class Pipes:
        """number|kind|title|claim|claim..."""

        def matches(self, raw):
            return raw.startswith("PIPE|")

        def parse_row(self, raw, groups):
            _, number, kind, title, *claims = raw.split("|")
            if not number:
                raise StructureError("no number")
            if number == "x":
                raise ValueError("not a number")
            return {"country": "US", "doc_number": number, "kind_code": kind, "title": title, "claims": claims, "unknown": 1}

    return Pipes()


@pytest.fixture
def pipes():
    formats.add_format("Pipes", pipes_adapter())
    yield
    formats.remove_format("Pipes")


def test_an_added_format_is_parsed(spark, pipes):
    grant = "<us-patent-grant dtd-version=\"v4.5\"/>"
    df = spark.createDataFrame([(0, "PIPE|12|B2|A title|one|two"), (1, "PIPE||B2|t"), (2, "PIPE|x|B2|t"), (3, grant), (4, None), (5, "<other/>")], "id int, raw string")
    got = {r.id: r for r in parse(df).collect()}
    assert (got[0].source_format, got[0].doc_number, got[0].claims, got[0].error_kind, got[0].abstract) == ("Pipes", "12", ["one", "two"], None, None)
    assert [(got[k].error_kind, got[k].error_msg) for k in (1, 2)] == [("UnsupportedStructure", "no number"), ("MalformedXml", "not a number")]
    assert got[3].source_format == "UsptoGrantV45" and [got[k].error_kind for k in (4, 5)] == ["Malformed", "UnsupportedRoot"]
    assert project.biblio(parse(df, groups=("biblio",)), ["id"]).where("id = 0").first().patent_number == "US12B2"
    assert [tuple(r) for r in project.claims(parse(df, groups=("claims",)), ["id"]).where("id = 0").collect()] == [(0, 1, "one"), (0, 2, "two")]


def test_without_it_nothing_changes(spark):
    df = spark.createDataFrame([(0, "PIPE|12|B2|t")], "id int, raw string")
    assert detect(df).first().error_kind is not None
    with pytest.raises(ValueError):
        formats.add_format("UsptoGrantV45", pipes_adapter())
    with pytest.raises(ValueError):
        formats.remove_format("UsptoGrantV45")


def test_table_functions(spark):
    api.register(spark)
    c = corpus(spark, "/root/testdata/sf0.001").where("doc_id < 24").select("doc_id", "raw")
    c.createOrReplaceTempView("records_of_test")
    got = spark.sql("SELECT doc_id, p.* FROM records_of_test, LATERAL patent_parties(raw) p")
    want = project.parties(parse(c, groups=("biblio",)), ["doc_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    text = c.where("doc_id % 6 < 4").agg(F.array_join(F.array_sort(F.collect_list("raw")), "\n").alias("text"))
    text.createOrReplaceTempView("text_of_test")
    n = spark.sql("SELECT p.* FROM text_of_test, LATERAL patent_records(text) p").collect()
    assert [r.ordinal for r in n] == list(range(16)) and all(r.raw.startswith("<?xml") for r in n)
    tagged = spark.sql("SELECT p.* FROM VALUES ('HHHHH APS1\nPATN\nWKU  1\nPATN\nWKU  2\n'), (NULL) AS t(x), LATERAL patent_records(x) p").collect()
    assert [(r.ordinal, r.raw.split()[2]) for r in tagged] == [(0, "1"), (1, "2")]
