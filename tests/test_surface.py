import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from inkspan import api
from inkspan.__main__ import main
from inkspan.functions.formats import FORMATS
from inkspan.functions.records import record
from inkspan.operators import project
from inkspan.operators.parse import detect, parse
from inkspan.plans.corpus import corpus
from inkspan.sources import archives, sinks

GRANT = '<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE us-patent-grant SYSTEM "us-patent-grant-v47.dtd" [ ]><us-patent-grant dtd-version="v4.7" file="07654321.XML"><us-bibliographic-data-grant><publication-reference><document-id><country>US</country><doc-number>07654321</doc-number><kind>B2</kind><date>20100202</date></document-id></publication-reference><invention-title>A &lt;b&gt; &amp; c</invention-title><us-parties><inventors><inventor><addressbook><last-name>Byron</last-name><first-name>Ada</first-name></addressbook></inventor></inventors></us-parties></us-bibliographic-data-grant><abstract><p num="0001">One &amp; <b>two</b> x<sub>2</sub>.</p></abstract><claims><claim id="C1"><claim-text>One:<claim-text>two.</claim-text></claim-text></claim></claims><x a="&quot;"><!-- kept --></x></us-patent-grant>'


def test_write_back_reads_as_before(spark):
    """Every family, but tagged text: the record that is written reads as the one before, unknown parts included."""
    seen = set()
    for r in corpus(spark, "/root/testdata/sf0.001").where("doc_id < 96").collect():
        form = api.detect(r.raw)[0]
        if form in FORMATS and form != "UsptoGrantApsGreenBook" and api.is_parsable(r.raw):
            document = FORMATS[form].parse_document(r.raw)
            again = FORMATS[form].parse_document(xml := FORMATS[form].write_document(document))
            assert api.detect_format(xml) == form and record(again) == record(document)
            assert FORMATS[form].write_document(again) == xml or form == "UsptoGrantV25"  # whose edges gain a layer each time
            seen.add(form)
    assert len(seen) == 18


def test_write_back_keeps_what_it_does_not_know():
    xml = api.parse(GRANT).to_xml()
    assert xml.startswith('<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE us-patent-grant SYSTEM "us-patent-grant-v47.dtd" [ ]><us-patent-grant dtd-version="v4.7" file="07654321.XML">')
    assert '<x a="&quot;"><!-- kept --></x></us-patent-grant>' in xml and '<p num="0001">One &amp; <b>two</b> x<sub>2</sub>.</p>' in xml and '<claim id="C1"><claim-text>One:<claim-text>two.</claim-text></claim-text></claim>' in xml
    assert api.parse(xml).inventors == ["Ada Byron"]


def test_text_api_agrees_with_columns(spark):
    raws = [r.raw for r in corpus(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()] + ["", "  ", "<html/>", V4 % '<p num="0001">one</p><x a="1"/>', '<us-patent-grant dtd-version="v40"/>', GRANT]
    d = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    assert [tuple(r) for r in detect(d).orderBy("i").select("source_format", "error_kind", "error_msg").collect()] == [api.detect(r) for r in raws]
    p = parse(d).cache()
    md = {r.i: r.markdown for r in project.markdown(p, ["i"]).collect()}
    assert len(md) > 100 and all(api.parse_to_markdown(raws[i]) == m for i, m in md.items())
    b = {r.i: r for r in project.biblio(p, ["i"]).collect()}
    for i, r in b.items():
        doc = api.parse(raws[i])
        assert (doc.patent_number, doc.publication_number, doc.application_number, doc.title, doc.priority_date) == (r.patent_number, r.publication_number, r.application_number, r.invention_title, r.priority_date)


V4 = '<?xml version="1.0"?><us-patent-grant dtd-version="v4.7"><us-bibliographic-data-grant><us-related-documents><division><relation><parent-doc><document-id><doc-number>09/012</doc-number><date>20010101</date></document-id></parent-doc></relation></division></us-related-documents></us-bibliographic-data-grant><abstract><p num="0000">Ab H<sub>2</sub>O</p></abstract><description>%s</description><claims/></us-patent-grant>'


def test_description_parts():
    md = api.parse_to_markdown(V4 % '<heading>H</heading><p num="0001">one</p><?BRFSUM a="b" end="lead"?><p num="">two</p><?BRFSUM a="b" end="tail"?><description-of-drawings><p>fig</p></description-of-drawings>', "{{abstract}}\n\n{{description}}\n\n{{claims}}")
    assert md == '## Abstract\n\n[0000] Ab H<sub>2</sub>O\n\n## Description Of The Invention\n### H\n\n[0001] one\n\n<?BRFSUM a="b" end="lead"?>\n\n## Summary Of The Invention\n\n[] two\n\n<?BRFSUM a="b" end="tail"?>\n\n## Brief Description Of The Drawings\n\nfig\n\n## Claims'
    assert "priority_chain:\n  - relationship: division\n    parent_doc_number: 9012\n    parent_date: 20010101\n    child_doc_number: null\napplicants: []" in api.parse_to_markdown(V4 % "")
    assert api.detect_format('<us-patent-grant dtd-version="v40"/>') == "UsptoGrantV40"


def test_scalar_errors():
    assert repr(api.parse(GRANT)) == 'Document(publication_number=None, title="A <b> & c")' and repr(api.Claim(1, 'a"b')) == 'Claim(number=1, text="a\\"b")'
    with pytest.raises(ValueError, match="^malformed XML$"):
        api.detect_format(" ")
    for raw, says in (("", "source detection failed: malformed XML"), ("<table/>", "supplemental XML root 'table'"), ("<x/>", "unsupported XML root 'x'"), ("<us-patent-grant/>", "unknown XML format")):
        with pytest.raises(ValueError, match=says):
            api.parse(raw)
    assert repr(api.Claim(1, "x" * 80)).count("x") < 70


def test_sql_functions(spark):
    api.register(spark)
    spark.createDataFrame([(0, GRANT), (1, "<x/>"), (2, None)], "i int, raw string").createOrReplaceTempView("raws")
    r = spark.sql("SELECT patent_format(raw) AS f, parse_patent(raw) AS p, patent_to_markdown(raw) AS m, patent_to_xml(raw) AS x FROM raws ORDER BY i").collect()
    assert [x.f for x in r] == ["UsptoGrantV47", None, None] and r[0].p.title == "A <b> & c" and r[1].p.error_kind == "UnsupportedRoot"
    assert r[0].m.startswith("---") and "<us-patent-grant" in r[0].x and r[2].m is None
    t = spark.sql("SELECT patent_to_markdown(raw, '{{title}}') AS m FROM raws ORDER BY i").collect()
    assert [x.m for x in t] == ["# A <b> & c", None, None]
    c = spark.sql("SELECT i, c.* FROM raws, LATERAL patent_claims(raw) c").collect()
    assert [tuple(x) for x in c] == [(0, 1, "One:two.")] and spark.sql("SELECT p.* FROM raws, LATERAL patent_priority(raw) p").count() == 0
    with pytest.raises(Exception, match="unterminated"):
        spark.sql("SELECT patent_to_markdown(raw, '{{title') FROM raws").collect()


def test_json_escapes(spark):
    text = 'a"\\b\\\\b\b\f\n\x01\x7f\x85é'
    line = spark.createDataFrame([(text,)], "x string").select(sinks.json_escapes(F.to_json(F.struct("x")))).first()[0]
    assert json.loads(line) == {"x": text} and line == '{"x":"a\\"\\\\b\\\\\\\\b\\u0008\\u000c\\n\\u0001\\u007f\\u0085é"}'


def _archive(tmp_path):
    grant = GRANT
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "ipg1.zip", "w") as z:
        z.writestr("a.xml", grant + '<?xml version="1.0"?><other/>' + '<?xml version="1.0"?><table/>' + '<?xml version="1.0"?><us-patent-grant dtd-version="v4.7"><a></us-patent-grant>' + grant)
    return grant


def test_archive_set_and_command_line(spark, tmp_path, capsys):
    grant = _archive(tmp_path)
    out = tmp_path / "out"
    rows = sinks.write_archive_set(spark, f"file://{tmp_path}/in", f"file://{out}").collect()
    assert [(r.written, r.supplemental, r.unsupported, r.malformed) for r in rows] == [(2, 1, 1, 1)]
    assert json.loads((out / "ipg1.manifest.json").read_text()) == {"format_version": 1, "stem": "ipg1", "source_file": "ipg1.zip", "doc_kind": "grant", "patents_written": 2, "supplemental_skipped": 1, "unsupported_skipped": 1, "malformed_skipped": 1}
    lines = [json.loads(x) for x in (out / "ipg1.biblio.jsonl").read_text().splitlines()]
    assert len(lines) == 2 and list(lines[0]) == list(sinks.JSON_FIELDS) and lines[0]["patent_number"] == "US7654321B2" and lines[0]["publication_number"] is None
    assert (out / "ipg1.unsupported.tsv").read_text().splitlines() == ["doc_key\treason", "2\tsource detection failed: unsupported XML root 'other'"]
    assert main(["shard", "read", "--shard", str(out / "ipg1.zst"), "--key", "07654321"]) == 0
    assert capsys.readouterr().out == api.parse_to_markdown(grant) + "\n"
    assert main(["shard", "read", "--shard", str(out / "ipg1.zst"), "--key", "none"]) == 1
    limited = sinks.write_archive_set(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/few", 1).collect()
    assert [(r.written, r.unsupported) for r in limited] == [(1, 0)] and not (tmp_path / "few" / "ipg1.unsupported.tsv").exists()


def test_render_command(tmp_path, capsys):
    grant = GRANT
    (tmp_path / "b.XML").write_text(grant)
    (tmp_path / "a.xml").write_text(grant)
    assert main(["render", str(tmp_path)]) == 0
    one = api.parse_to_markdown(grant)
    assert capsys.readouterr().out == one + sinks.DOC_SEPARATOR + one + "\n"
    assert main(["render", str(tmp_path), "--output", str(tmp_path / "md")]) == 0 and sorted(x.name for x in (tmp_path / "md").iterdir()) == ["a.md", "b.md"]
    (tmp_path / "c.xml").write_text(" ")
    assert main(["render", str(tmp_path / "c.xml")]) == 1


def test_markdown_files(spark, tmp_path):
    d = spark.createDataFrame([("/x/b.xml", "B"), ("/x/a.xml", None)], "path string, markdown string")
    assert sorted(r.name for r in sinks.write_markdown_files(d, f"file://{tmp_path}/md").collect()) == ["a.md", "b.md"]
    sinks.write_concatenated(d, f"file://{tmp_path}/one").collect()
    assert "".join(p.read_text() for p in sorted((tmp_path / "one").glob("part*"))) == sinks.DOC_SEPARATOR + "B"


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 20])
def test_records_stream_as_they_split(chunk):
    one = '<?xml version="1.0"?>\n<!-- c --><!DOCTYPE a [<!ENTITY x "y">]>\n<a>é<?xml-stylesheet x?></a>\n'
    text = "junk" + one + '<?xml version="1.0"?><b>' + "z" * 3000 + "</b>" + one
    assert list(archives.stream_records(io.BytesIO(text.encode()), False, chunk)) == list(archives.split_records(text, False))
    mixed = one.encode() + one.encode("latin-1")
    assert list(archives.stream_records(io.BytesIO(mixed), False, chunk)) == [one, one]
    assert list(archives.stream_records(io.BytesIO(b""), False, chunk)) == []


def test_lookups_and_joins(spark, tmp_path):
    from inkspan.operators import joins
    from inkspan.sources import shards

    _archive(tmp_path)
    out = f"file://{tmp_path}/out"
    sinks.write_archive_set(spark, f"file://{tmp_path}/in", out).collect()
    keys = spark.createDataFrame([("07654321",), ("none",), ("07654321",)], "doc_key string")
    found = shards.lookup_many(spark, out, keys).collect()
    assert [r.doc_key for r in found] == ["07654321"] and found[0].text == api.parse_to_markdown(GRANT)
    biblio = spark.createDataFrame([("ipg1", "07654321", "1"), ("ipg1", "x", "2")], "shard string, doc_key string, application_number string")
    assert [r.offset for r in joins.with_pointers(biblio, shards.read_index(spark, out)).orderBy("offset").collect()][0] == 0
    other = spark.createDataFrame([(1, "a")], "n long, shard string")
    assert joins.by_application(biblio.withColumn("application_number", F.lpad("application_number", 8, "0")), other, "n").first().other_shard == "a"


def test_landing_streams(spark, tmp_path):
    from inkspan.streaming import landing

    _archive(tmp_path)
    (tmp_path / "in" / "one.xml").write_text(GRANT)
    for name, stream in (("files", landing.parsed_stream(spark, f"file://{tmp_path}/in")), ("zips", landing.parsed_archive_stream(spark, f"file://{tmp_path}/in"))):
        q = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
    assert [r.doc_number for r in spark.table("files").collect()] == ["07654321"]
    assert sorted(r.doc_key for r in spark.table("zips").where("error_kind IS NULL").collect()) == ["07654321", "07654321"] and spark.table("zips").count() == 5


def test_descriptions_of_many_lines(spark, tmp_path):
    spark.createDataFrame([(0, "\n".join(f"l{i}" for i in range(100010)), "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("orders", "lineitem", "customer", "part", "supplier"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    raw = corpus(spark, str(tmp_path)).first().raw
    assert raw.count('<p id="p-') == 100006 and ">l0</p>" in raw and ">l100009</p>" in raw
