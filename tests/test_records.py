import zipfile

import pytest
from pyspark.sql import functions as F

from inkspan import api
from inkspan.functions import columns as C
from inkspan.functions import templates
from inkspan.operators import project
from inkspan.operators.parse import detect, parse
from inkspan.plans.queries import ORACLE, QUERIES
from inkspan.sources import archives, shards

GRANT = '<?xml version="1.0"?><us-patent-grant dtd-version="v4.7" file="K1.XML"><us-bibliographic-data-grant><publication-reference><document-id><country>US</country><doc-number>07654321</doc-number><kind>B2</kind></document-id></publication-reference><invention-title>A &ldquo;<i>b</i>&rdquo;</invention-title></us-bibliographic-data-grant><claims><claim><claim-text>One:<claim-text>two.</claim-text></claim-text></claim><claim> </claim></claims></us-patent-grant>'


def test_detection(spark):
    raws = [GRANT, "", "  ", None, "<html/>", "<us-patent-grant/>", '<!DOCTYPE us-patent-application><us-patent-grant dtd-version="v4.5"/>', "PATN\nWKU  043757022\n"]
    got = [(r.source_format, r.error_kind) for r in detect(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")).orderBy("i").collect()]
    assert got == [("UsptoGrantV47", None), (None, "Malformed"), (None, "Malformed"), (None, "Malformed"), (None, "UnsupportedRoot"), (None, "UnknownFormat"), (None, "ConflictingVersionMarkers"), ("UsptoGrantApsGreenBook", None)]


def test_parse_and_project(spark):
    p = parse(spark.createDataFrame([(0, GRANT), (1, "<us-patent-grant dtd-version=\"v4.7\"><a></us-patent-grant>")], "i int, raw string"))
    b = project.biblio(p, ["i"]).collect()
    assert len(b) == 1 and b[0].patent_number == "US7654321B2" and b[0].publication_number is None and b[0].invention_title == "A &ldquo;b&rdquo;"
    assert [tuple(r) for r in project.claims(p, ["i"]).collect()] == [(0, 1, "One:two.")]
    assert "```claim\nOne:\n  two.\n```" in project.markdown(p, ["i"]).first().markdown
    assert p.where("error_kind = 'MalformedXml'").count() == 1


def test_templates():
    assert templates.render_text({"title": "# T", "claims": "c"}, "{{ title }}\n\n{{abstract}}\n\n{{claims}}") == "# T\n\nc"
    for bad in ("{{nope}}", "{{title"):
        with pytest.raises(templates.TemplateError):
            templates.parse(bad)


def test_identifiers(spark):
    d = spark.createDataFrame([("500649&",), ("2745224",), ("25-04-80-8",), ("MI00O0404",)], "x string")
    assert [r[0] for r in d.select(C.normal_apn(F.col("x"))).collect()] == ["500649", "2745224", "25-04-80-8", "MI00O0404"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "ipg1.ZIP", "w") as z:
        z.writestr("a.txt", "no")
        z.writestr("a.xml", "junk" + GRANT + "\n" + '<?xml version="1.0"?>\n<sequence-cwu>é</sequence-cwu>'.encode("latin-1").decode("latin-1"))
    r = archives.read_archives(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [x.ordinal for x in r] == [0, 1] and r[0].raw.startswith(GRANT)
    assert archives.next_aps_record("x\nPATN  \nPATN", 0) == 2


def test_shards(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    docs = spark.createDataFrame([("s", 0, "US1", "alpha"), ("s", 1, "US2", "beta body"), ("t", 0, "US3", None)], "shard string, ordinal int, doc_key string, text string")
    assert sum(r.documents for r in shards.write_shards(docs, path).collect()) == 3
    assert shards.lookup(spark, path, "US2").first().text == "beta body"
    with pytest.raises(ValueError, match="line 2"):
        shards.parse_index("s", "a\t0\t1\nb\t1\n")


def test_queries_have_sql():
    assert set(ORACLE) == set(QUERIES)


def test_wku_and_keys(spark):
    """Identifiers lose their check character, whatever it is; Python and columns agree."""
    from inkspan.functions.records import wku

    want = {"043757022": ("4375702", "B1"), "D02681420": ("D268142", "S"), "RE0311677": ("RE31167", "E"), "PP0049883": ("PP4988", None), "06332220&": ("6332220", "B1"), "D0452361&": ("D452361", "S"), "H0000123&": ("H123", "B1"), "T1002003": ("T100200", "B1"), "0": ("0", "B1"), " P12 ": ("P1", None)}
    assert {k: wku(k) for k in want} == want
    d = spark.createDataFrame([(k,) for k in want], "x string").select("x", C.wku(F.col("x")).alias("w"), C.doc_key(F.concat(F.lit("PATN\nWKU\nWKU  "), "x", F.lit("\nWKU  9")), F.lit(4)).alias("k"))
    assert all((r.w.number, r.w.kind) == want[r.x] and r.k == r.w.number for r in d.collect())
    keys = [("<us-patent-grant file='a.b.XML'/>", "a.b"), ('<x xfile="q"/>', "q"), ("<x><doc-number> </doc-number><patent-number> 7 </patent-number></x>", "7"), ('<x><y file="n.x"/></x>', "5"), ('<!-- <z file="no"> --><!DOCTYPE x [ <!ENTITY a "b"> ]><x file="yes"/>', "yes"), ("", "5"), ("PATN\nTTL  x", "5"), ("<x><doc-number a='1'>3</doc-number></x>", "5")]
    got = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(keys)], "i int, raw string").select("i", C.doc_key(F.col("raw"), F.lit(4)).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [k for _, k in keys]


def test_hard_texts(spark, tmp_path):
    """Long doctypes, long unbroken texts, deep nesting, entity bombs and broken archives are rows, not crashes."""
    long_doctype = "<!DOCTYPE us-patent-grant " + "x [y" * 10_000 + " ]><us-patent-grant dtd-version=\"v4.7\"/>"
    many = '<?xml version="1.0"?>' + "<!-- c -->" * 20_000 + '<us-patent-grant dtd-version="v4.7"/>'
    deep = '<us-patent-grant dtd-version="v4.7"><claims><claim>' + "<b>" * 5000 + "x" + "</b>" * 5000 + "</claim></claims></us-patent-grant>"
    bomb = '<!DOCTYPE us-patent-grant [<!ENTITY a "' + "x" * 1000 + '">' + "".join(f'<!ENTITY {c} "{f"&{b};" * 30}">' for b, c in zip("abcdef", "bcdefg")) + ']><us-patent-grant dtd-version="v4.7"><abstract><p>&g;</p></abstract></us-patent-grant>'
    blank = '<us-patent-grant dtd-version="v4.7"><abstract><p>a' + " " * 1_000_000 + "b</p></abstract></us-patent-grant>"
    raws = [long_doctype, many, deep, bomb, blank, "x" * 1_000_000, "<" + "y" * 1_000_000, "\ufeff" + GRANT, " \n" * 100_000 + "<a/>"]
    d = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    assert [tuple(r) for r in detect(d).orderBy("i").select("source_format", "error_kind").collect()] == [api.detect(r)[:2] for r in raws]
    p = {r.i: r for r in parse(d).collect()}
    assert p[1].error_kind is None and p[2].error_kind == p[3].error_kind == "MalformedXml" and len(p[4].abstract) == 1_000_002 and p[7].error_kind == "Malformed"
    assert spark.createDataFrame([(0, raws[0])], "i int, raw string").select(C.doc_key(F.col("raw"), F.col("i"))).first()[0] == "1"
    (tmp_path / "ipg1.zip").write_bytes(b"no zip at all" * 10)
    r = archives.read_archives(spark, f"file://{tmp_path}").collect()
    assert len(r) == 1 and r[0].raw is None and "BadZipFile" in r[0].error
    with pytest.raises(FileNotFoundError):
        archives.read_files(spark, f"file://{tmp_path}")


def test_clashing_names_and_nulls(spark):
    d = spark.createDataFrame([(0, GRANT, "t", "x", "f", 1), (1, None, "t", None, "f", 2)], "i int, raw string, title string, _root string, source_format string, error_kind int")
    assert detect(d).columns == ["i", "raw", "title", "_root", "source_format", "error_kind", "error_msg"]
    p = parse(d)
    assert len(set(p.columns)) == len(p.columns) and [r.title for r in p.orderBy("i").collect()] == ["A &ldquo;b&rdquo;", None]
    assert parse(d.where("false")).count() == 0 and project.manifest(p, ["i"]).count() == 2


def test_inline_content():
    """Blank texts between marks go; unknown elements stay as markup; instructions too; comments don't."""
    raw = '<us-patent-grant dtd-version="v4.7"><abstract><p num=""><b>A</b> <i>B</i> a&eacute;&ldquo;<sub x="1&amp;2"> </sub><!-- c --><?z q?><figref><b>F</b></figref><![CDATA[&ldquo;<]]></p><q/> </abstract><claims><heading>H <i>h</i></heading><claim>x<b>y</b></claim></claims></us-patent-grant>'
    doc = api.parse(raw)
    assert doc.abstract_text == 'AB a&eacute;"<sub x="1&2"> </sub><?z q?>F"<'
    assert doc.to_markdown("{{abstract}}") == '## Abstract\n\n[] **A***B* a&eacute;"<sub x="1&2"> </sub><?z q?>F"<\n<q></q>'
    assert doc.to_markdown("{{claims}}") == "## Claims\nH *h*\n```claim\nxy\n```"


def test_party_fallbacks():
    """Names in parts without a fixed form."""
    head = '<us-patent-grant dtd-version="v4.7"><us-bibliographic-data-grant>%s</us-bibliographic-data-grant></us-patent-grant>'
    of = lambda x: api.parse(head % x)
    assert of("<a><us-applicant><addressbook><orgname>O &amp;mdash; P</orgname></addressbook></us-applicant></a>").applicants == ["O - P"]
    assert of("<assignee><organization-name>Org</organization-name></assignee>").assignees == ["Org"]
    assert of("<x><assignee><orgname> </orgname><addressbook><given-name>G</given-name><family-name>F</family-name></addressbook></assignee></x>").assignees == ["G F"]
    assert of("<x><y><inventor><z><name><first-name>A</first-name></name></z></inventor><inventor><NAM><FNM>B</FNM><SNM>C</SNM></NAM></inventor><inventor/></y></x>").inventors == ["A", "B C"]
    assert of("<x><B721><NAM><ONM>N</ONM><SNM>no</SNM></NAM></B721></x>").inventors == ["N"]
    typed = of("<parties><applicants><applicant><addressbook><name>T</name></addressbook></applicant></applicants></parties><x><applicant><orgname>no</orgname></applicant></x>")
    assert typed.applicants == ["T"]


APS = "HHHHHT   APS1   ISSUE\r\nPATN    \r\nWKU  043757022\nAPN  2745224\nTTL  Hat\n     band\nZZZZ\nISD  19830308\nINVT\nNAM  Lundin; Tord R.\nNAM  Two\nCLAS\nOCL    2423\nICL  A42B  300\nABST\nPAL  One\n     two.\nTBL  a   b\n\n       c\nBSUM\nZZZZ\nPAC  Head\nPAR  Text\nCLMS\nSTM  We claim\nPAR  Lead\nNUM  1.\nPAR  A\nPA1  B\nNUM  2.\nDCLM\nPAR  As shown\nPAR  here\n"


def test_tagged_text():
    """Unknown empty tags open nothing; text before the first number is a claim; design lines are one claim; tables stay."""
    doc = api.parse(APS)
    assert (doc.patent_number, doc.title, doc.publication_date, doc.inventors, doc.ipc_classifications, doc.us_classifications) == ("US4375702B1", "Hat band", "19830308", ["Tord R. Lundin", "Two"], ["A42B 300"], ["2423"])
    assert [c.text for c in doc.claims] == ["Lead", "AB", "As shownhere"] and doc.record["first_inventor"] == "Tord R. Lundin"
    assert doc.abstract_text == "One two.\n\n```\na   b\n\n  c\n```"
    assert doc.to_markdown("{{description}}") == "## Summary Of The Invention\n### Head\n\nText"
    with pytest.raises(ValueError, match="missing WKU"):
        api.parse("PATN\nSRC  5\nART  3\n")
    with pytest.raises(ValueError, match="does not support"):
        doc.to_xml()
