"""Parsed records back to XML of the format they came from."""

from __future__ import annotations

import re

from .markup import Node, Run, element, escaped, source
from .records import Model, Part, adapter, model

_QUOTED = r"""("[^"]*"|'[^']*')"""
_DOCTYPE = re.compile(rf"(?s)<!DOCTYPE\s+([^\s>\[]+)\s*(?:PUBLIC\s+{_QUOTED}\s*{_QUOTED}?|SYSTEM\s+{_QUOTED})?\s*(?:\[(.*)\])?\s*>")


def prolog(text: str) -> str:
    """A record's declaration and doctype, without what stands around them."""
    out = ""
    if m := re.match(r"(?s)<\?xml\s(.*?)\?>", text):
        found = dict(re.findall(rf"(\w+)\s*=\s*{_QUOTED}", m[1]))
        out = "<?xml" + "".join(f' {k}="{found[k][1:-1]}"' for k in ("version", "encoding", "standalone") if k in found) + "?>"
    if m := _DOCTYPE.search(text):
        name, public, system, other, subset = m.groups()
        out += f"<!DOCTYPE {name}" + (f' PUBLIC "{public[1:-1]}"' if public else "")
        if place := system or other:
            out += f'{"" if public else " SYSTEM"} "{place[1:-1]}"'
        out += (f" [{subset}]" if subset is not None else "") + ">"
    return out


def _text(tag: str, value: str | None) -> str:
    """An element around a text; nothing for null."""
    return "" if value is None else element(tag, escaped(value))


class _Writer:
    """What the families share. names: element names of a record's parts and of inline content."""

    names: dict[str, str]
    literal = True

    def opaque(self, k) -> str:
        return source(k, self.literal)

    def runs(self, content: list[Run]) -> str:
        out = []
        for r in content:
            if r.kind == "text":
                out.append(self.piece(r.content))
            elif r.kind == "opaque":
                out.append(self.opaque(r.content))
            else:
                inner = self.runs(r.content)
                tag = self.names.get(r.kind, r.kind)
                out.append(element(tag, inner, attrs=r.attrs) if tag else inner)
        return "".join(out)

    def piece(self, text: str) -> str:
        return escaped(text)

    def block(self, p: Part) -> str:
        """A heading, paragraph or claim."""
        return self.opaque(p.value) if p.kind == "opaque" else element(self.names.get(p.kind, p.kind), self.runs(p.items), attrs=p.attrs)

    def part(self, p: Part) -> str:
        return self.opaque(p.value) if p.kind == "opaque" else getattr(self, p.kind)(p)

    def whole(self, p: Part, inner: str) -> str:
        return element(self.names.get(p.kind, p.kind), inner, attrs=p.attrs)

    def abstract(self, p: Part) -> str:
        return self.whole(p, "".join(map(self.block, p.items)))

    claims = abstract

    def biblio(self, p: Part) -> str:
        out = []
        for x in p.items:
            make = None if x.kind == "opaque" else getattr(self, "_" + x.kind.replace("-", "_"), None)
            out.append(self.opaque(x.value) if x.kind == "opaque" else make(x) if make else "")
        return self.whole(p, "".join(out))

    def drawings(self, p: Part) -> str:
        return self.whole(p, "".join(self.drawing(x) for x in p.items))

    def drawing(self, x: Part) -> str:
        if x.kind == "representative-figure":
            return _text(x.kind, x.value)
        return self.figure(x) if x.kind == "figure" else self.block(x)

    image = "image"

    def figure(self, x: Part) -> str:
        return element("figure", *(self.empty(y.value) if y.kind == "image" else self.opaque(y.value) for y in x.items), attrs=x.attrs)

    def empty(self, e: Node) -> str:
        return element(self.image, attrs=e.attrs).removesuffix(f"></{self.image}>") + "/>"


class _Modern(_Writer):
    image = "img"

    def __init__(self, kind: str):
        self.names = {"biblio": f"us-bibliographic-data-{kind}", "paragraph": "p", "figure": "figref", "claim-reference": "dependent-claim-reference", "bold": "b", "italic": "i"}

    def _id(self, x: Part) -> str:
        v = x.value
        return element("publication-reference", element("document-id", _text("country", v["country"]), _text("doc-number", v["doc_number"]), _text("kind", v["kind_code"]), _text("date", v["publication_date"])))

    def _filing(self, x: Part) -> str:
        return element("application-reference", self.ids(x.first("number"), x.first("date")), attrs=x.attrs) + _text("us-application-series-code", x.first("series"))

    def ids(self, number: str | None, date: str | None) -> str:
        return element("document-id", _text("doc-number", number), _text("date", date))

    def _technical(self, x: Part) -> str:
        out = []
        for y in x.items:
            if y.kind == "title":
                out.append(_text("invention-title", y.value))
            else:  # ipcr symbols become plain ones
                tags = ["main-classification", *["further-classification"] * len(y.value)]
                out.append(element("classification-ipc" if y.kind == "ipc" else "classification-national", *map(_text, tags, y.value), attrs=y.attrs))
        return "".join(out)

    def _continuity(self, x: Part) -> str:
        return element("us-related-documents", *map(self.related, x.items), attrs=x.attrs)

    def related(self, y: Part) -> str:
        if y.kind == "opaque":
            return self.opaque(y.value)
        v = y.value
        inner = self.ids(v["parent"], v["parent_date"])
        if v["child"] is not None:
            inner = element("relation", element("parent-doc", inner), element("child-doc", self.ids(v["child"], None)))
        return element(v["relationship"], inner, attrs=y.attrs)

    def people(self, x: Part, box: str, item: str) -> str:
        named = lambda n: "" if n is None else element("addressbook", _text("name" if " " in n else "orgname", n))
        return element(box, *(element(item, named(y.value), attrs=y.attrs) for y in x.items), attrs=x.attrs)

    def _applicants(self, x: Part) -> str:
        return element("parties", self.people(x, "applicants", "applicant"))

    def _assignees(self, x: Part) -> str:
        return self.people(x, "assignees", "assignee")

    def description(self, p: Part) -> str:
        return self.whole(p, "".join(self.opaque(s.value) if s.kind == "opaque" else "".join(map(self.block, s.items)) for s in p.items))


def _pdat(value: str | None, *tags: str) -> str:
    if value is None:
        return ""
    out = _text("PDAT", value)
    for tag in reversed(tags):
        out = element(tag, out)
    return out


class _Grant25(_Writer):
    names = {
        "biblio": "SDOBI", "abstract": "SDOAB", "description": "SDODE", "claims": "SDOCL", "drawings": "SDODR", "heading": "H", "paragraph": "PARA",
        "bold": "BOLD", "italic": "ITALIC", "highlight": "HIL", "figure": "FGREF", "claim-reference": "CLREF", "claim-text": "", "number": "", "cross-reference": "",
    }
    image = "EMI"

    def piece(self, text: str) -> str:
        return _text("PDAT", text)

    def block(self, p: Part) -> str:
        if p.kind == "opaque":
            return self.opaque(p.value)
        return element(self.names[p.kind], element("STEXT" if p.kind == "heading" else "PTEXT", self.runs(p.items)), attrs=p.attrs)

    def abstract(self, p: Part) -> str:
        return self.whole(p, element("BTEXT", *map(self.block, p.items)))

    def description(self, p: Part) -> str:
        tags = {"summary": "BRFSUM", "drawings": "DRWDESC", "detailed": "DETDESC"}
        return self.whole(p, "".join(self.opaque(s.value) if s.kind == "opaque" else element(tags[s.value], element("BTEXT", *map(self.block, s.items))) for s in p.items))

    def claims(self, p: Part) -> str:
        """Headings first; then all claims in one list."""
        own = "".join(element("CLM", *map(self.step, x.items), attrs=x.attrs) for x in p.items if x.kind == "claim")
        return self.whole(p, "".join(self.block(x) for x in p.items if x.kind != "claim") + (element("CL", own) if own else ""))

    def step(self, r: Run) -> str:
        if r.kind == "opaque":
            return self.opaque(r.content)
        return element("PARA" if any(k == "ID" for k, _ in r.attrs) else "CLMSTEP", element("PTEXT", self.runs(r.content)), attrs=r.attrs)

    def figure(self, x: Part) -> str:
        return "".join(self.empty(y.value) for y in x.items)

    def _id(self, x: Part) -> str:
        v = x.value
        return element("B100", _pdat(v["doc_number"], "B110", "DNUM"), _pdat(v["kind_code"], "B130"), _pdat(v["publication_date"], "B140", "DATE"), _pdat(v["country"], "B190"))

    def _filing(self, x: Part) -> str:
        return element("B200", _pdat(x.first("number"), "B210", "DNUM"), _pdat(x.first("series"), "B211US"), _pdat(x.first("date"), "B220", "DATE"), attrs=x.attrs)

    def _technical(self, x: Part) -> str:
        one = lambda y: y.value[0] if y.value else None
        forms = {"title": lambda y: _pdat(y.value, "B540", "STEXT"), "ipc": lambda y: element("B510", _pdat(one(y), "B511"), attrs=y.attrs), "us": lambda y: element("B520", _pdat(one(y), "B521"), attrs=y.attrs)}
        return element("B500", *(forms[y.kind](y) for y in x.items), attrs=x.attrs)

    def _continuity(self, x: Part) -> str:
        return element("B600", *map(self.related, x.items), attrs=x.attrs)

    def related(self, y: Part) -> str:
        if y.kind == "opaque":
            return self.opaque(y.value)
        v = y.value
        known = v["parent"] is not None or v["parent_date"] is not None
        doc = _pdat(v["parent"], "DNUM", "PDAT") + _pdat(v["parent_date"], "DATE")
        if v["relationship"] == "us-provisional-application":
            return element("B680US", element("DOC", doc, _pdat("00" if known else None, "KIND")), attrs=y.attrs)
        return element("B620", element("PARENT-US", _pdat(v["child"], "CDOC", "DOC", "DNUM"), element("PDOC", element("DOC", doc)) if known else ""), attrs=y.attrs)

    def people(self, x: Part, box: str, item: str) -> str:
        return element("B700", element(box, *(element(item, element("PARTY-US", element("NAM", _pdat(y.value, "ONM", "STEXT"))), attrs=y.attrs) for y in x.items), attrs=x.attrs))

    def _applicants(self, x: Part) -> str:
        return self.people(x, "B720", "B721")

    def _assignees(self, x: Part) -> str:
        return self.people(x, "B730", "B731")


class _Application15(_Writer):
    names = {"biblio": "subdoc-bibliographic-information", **{k: f"subdoc-{k}" for k in ("abstract", "description", "claims", "drawings")}, "figure": "figref", "claim-reference": "dependent-claim-reference"}
    literal = False

    def description(self, p: Part) -> str:
        tags = {"cross-reference": "cross-reference-to-related-applications", "summary": "summary-of-invention", "drawings": "brief-description-of-drawings", "detailed": "detailed-description"}
        group = lambda x: element("section", *map(self.block, x.items), attrs=x.attrs) if x.kind == "group" else self.block(x)
        return self.whole(p, "".join(self.opaque(s.value) if s.kind == "opaque" else element(tags[s.value], *map(group, s.items), attrs=s.attrs) for s in p.items))

    def _id(self, x: Part) -> str:
        v = x.value
        return element("document-id", _text("doc-number", v["doc_number"]), _text("kind-code", v["kind_code"]), _text("document-date", v["publication_date"]), _text("country-code", v["country"]))

    def _publication_filing_type(self, x: Part) -> str:
        return _text("publication-filing-type", x.value)

    def _filing(self, x: Part) -> str:
        forms = {"number": lambda y: element("application-number", _text("doc-number", y.value), attrs=y.attrs), "series": lambda y: _text("application-number-series-code", y.value), "date": lambda y: _text("filing-date", y.value), "opaque": lambda y: self.opaque(y.value)}
        return element("domestic-filing-data", *(forms[y.kind](y) for y in x.items), attrs=x.attrs)

    def _technical(self, x: Part) -> str:
        one = lambda y, *tags: "" if y.value[0] is None else self.nested(_text(tags[-1], y.value[0]), tags[:-1])
        forms = {
            "title": lambda y: _text("title-of-invention", y.value), "opaque": lambda y: self.opaque(y.value),
            "ipc": lambda y: element("classification-ipc", one(y, "classification-ipc-primary", "ipc"), attrs=y.attrs),
            "us": lambda y: element("classification-us", one(y, "classification-us-primary", "uspc", "class"), attrs=y.attrs),
        }
        return element("technical-information", *(forms[y.kind](y) for y in x.items), attrs=x.attrs)

    def nested(self, inner: str, tags) -> str:
        for tag in reversed(tags):
            inner = element(tag, inner)
        return inner

    def _continuity(self, x: Part) -> str:
        one = lambda v: element("document-id", _text("doc-number", v["parent"]), _text("document-date", v["parent_date"]))
        return element("continuity-data", *(self.opaque(y.value) if y.kind == "opaque" else element(y.value["relationship"], one(y.value), attrs=y.attrs) for y in x.items), attrs=x.attrs)

    def _inventors(self, x: Part) -> str:
        out = []
        for y in x.items:
            if y.kind == "opaque":
                out.append(self.opaque(y.value))
                continue
            v = y.value
            home = _text("city", v["city"]) + _text("state", v["state"]) + _text("country-code", v["country"])
            out.append(element(y.kind, element("name", _text("given-name", v["first"]), _text("family-name", v["last"])), self.nested(home, ("residence", "residence-us")) if home else "", attrs=y.attrs))
        return element("inventors", *out, attrs=x.attrs)

    def _correspondence_address(self, x: Part) -> str:
        return element("correspondence-address", *(self.opaque(y.value) if y.kind == "opaque" else self.address(y) if y.kind == "address" else _text(y.kind, y.value) for y in x.items), attrs=x.attrs)

    def address(self, y: Part) -> str:
        e: Node = y.value
        lines = [z.text() for z in e.elements() if z.tag.startswith("address-")]
        country = e.first_below("country-code")
        rest = [_text(t, e.at(t)) for t in ("city", "state", "postalcode")]
        return element("address", *(_text(f"address-{i}", t) for i, t in enumerate(lines, 1)), *rest, element("country", _text("country-code", country)) if country else "", attrs=y.attrs)


WRITERS = {"grant": _Modern("grant"), "application": _Modern("application"), "grant25": _Grant25(), "application15": _Application15()}


def write_model(m: Model) -> str:
    """XML of a parsed record in its own format; ValueError for tagged text, which has no way back."""
    a = adapter(m.form)
    if a is None:
        raise ValueError(f"{m.form} does not support serialization")
    w = WRITERS[getattr(a, "kind", {"PATDOC": "grant25"}.get(a.root, "application15"))]
    return prolog(m.prolog) + element(a.root, *map(w.part, m.parts), attrs=m.attrs)


def write_record(raw: str, form: str) -> str:
    return write_model(model(raw, form))
