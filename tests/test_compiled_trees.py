"""Trees of the compiled builder say what trees of events say, and what nobody asks for is not made at all."""

import pytest

from inkspan.functions import markup, records

ODD = ["", " a <!-- c --> b", "<?p d?> t", "<?p?>", "&foo;&lt;", "<b> </b>tail<i/>", "<![CDATA[ x ]]>y", "<x xmlns='u'/>", "<p xml:lang='en'/>", "<b>" * 255 + "</b>" * 255, "<b>" * 254 + "<?p?>" + "</b>" * 254, "<a:b/>", "<a>", "&#1;"]


def flat(n):
    if isinstance(n, markup.Mark):
        return "mark", str(n), n.target, n.data
    return n if isinstance(n, str) else (n.tag, n.attrs, [flat(k) for k in n.kids], n.text(), n.at("q", "r"), n.first_below("r"), n.get("z"))


def read(f):
    try:
        return flat(f())
    except ValueError as e:
        return str(e)


@pytest.mark.parametrize("odd", ODD)
@pytest.mark.parametrize("doctype", ["", "<!DOCTYPE r [ ]>", '<!DOCTYPE r [<!ENTITY foo "bar">]>'])
def test_trees_as_by_events(odd, doctype):
    raw = f"<?xml version='1.0'?>{doctype}<r z='1' y='&foo;'><q> u <r>v<!-- w --></r> </q>{odd}</r>"
    assert read(lambda: markup.tree(raw).root) == read(lambda: markup._by_events(markup._escaped(raw)))
    kind = records.parse_record(raw, "UsptoGrantV25", groups=("claims",))
    assert kind | {"claims": None, "md_claims": None} == records.parse_record(raw, "UsptoGrantV25", groups=()) | {"claims": None, "md_claims": None}


def test_nothing_is_made_for_the_error_alone(monkeypatch):
    monkeypatch.setattr(markup, "Node", None)
    raw = "<PATDOC><SDOBI><B100/></SDOBI></PATDOC>"
    assert records.parse_record(raw, "UsptoGrantV25", groups=()) == {"error_kind": None, "error_msg": None}
    wrong = records.parse_record("<x/>", "UsptoGrantV25", groups=())
    assert wrong == {"error_kind": "UnsupportedStructure", "error_msg": "UsptoGrantV25 requires PATDOC root"}
