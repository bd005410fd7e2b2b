"""Parts of a record that no asked column needs are checked, but not built; versions are found as by the plain functions."""

import pytest
from pyspark.sql import functions as F

from inkspan import api
from inkspan.functions import columns as C
from inkspan.functions import markup, records

BODY = "".join(f"<p id='{i}'>t<b>{i}</b><![CDATA[<x>]]><?i j?><!-- c --></p>" for i in range(50))
RECORD = f"""<?xml version="1.0"?><us-patent-grant dtd-version="v4.5"><us-bibliographic-data-grant><invention-title>A</invention-title></us-bibliographic-data-grant><abstract><p>{{}}</p></abstract><description>{BODY}</description> tail <claims><claim><claim-text>1. x</claim-text></claim></claims></us-patent-grant>"""


def test_unasked_parts_are_not_built(monkeypatch):
    whole = records.parse_record(RECORD, "UsptoGrantV45")
    made = []

    class Counted(markup.Node):
        __slots__ = ()

        def __init__(self, *args):
            made.append(args[0])
            super().__init__(*args)

    monkeypatch.setattr(markup, "Node", Counted)
    for groups in (("biblio",), ("claims",), ("biblio", "claims")):
        made.clear()
        got = records.parse_record(RECORD, "UsptoGrantV45", groups=groups)
        assert got == {k: whole[k] for k in got} and len(made) < 12


@pytest.mark.parametrize("inner", ["<a></b>", "<a>" * 254 + "</a>" * 254, "&#0;"])
def test_unasked_parts_are_checked(inner):
    raw = RECORD.replace("{}", inner)
    assert records.parse_record(raw, "UsptoGrantV45", groups=("claims",))["error_kind"] == "MalformedXml"
    assert records.parse_record(raw, "UsptoGrantV45")["error_kind"] == "MalformedXml"


def test_versions_as_the_plain_functions_find_them(spark):
    marks = ["", "pap-v16", "pap-v15-2001-01-31.dtd", "pap-v15-2001-01-31xdtd", 'DTD="2.5"', 'DTD="2x5"', "ST32-US-Grant-025xml.dtd", "<!DOCTYPE PATDOC>"]
    marks += [f"us-patent-{k}-v4{n}" for k in ("grant", "application") for n in range(9)] + [f'dtd-version="v4{d}{n}' for d in ("", ".") for n in range(9)]
    rows = [(f"<{r}/> {a} {b}",) for r in ("us-patent-grant", "us-patent-application", "PATDOC", "x") for i, a in enumerate(marks) for b in ("", a, marks[(i * 7 + 3) % len(marks)])]
    d = spark.createDataFrame([*rows, (None,)], "raw string").select("raw", C.source_format(F.col("raw")).alias("f")).collect()
    for r in d[:-1]:
        assert (r.f.format, r.f.error_kind) == api.detect(r.raw)[:2], r.raw
    assert d[-1].f.error_kind == "Malformed"
