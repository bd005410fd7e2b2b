"""Parsing one record into a model, and the model into the fixed row of RECORD; pure Python, called in Arrow batches."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

from .columns import SPACE
from .markup import V4, V15, V25, Mark, Node, Run, checked_root, claim_block, decoded, markup, reading, runs, squeezed, tree

_ITEM = "struct<bucket:string,kind:string,num:string,level:int,text:string>"
#: The columns of a parsed record, by what they need: the bibliographic part, or one part of the body.
GROUPS = {
    "biblio": "country string, doc_number string, kind_code string, publication_date string, application_number string, appl_type string, series string, filing_date string, title string, ipc array<string>, us array<string>, "
    "priority array<struct<relationship:string,parent:string,parent_date:string,child:string>>, applicants array<string>, assignees array<string>, inventors array<string>, first_inventor string",
    "abstract": "abstract string, md_abstract string",
    "description": f"description array<{_ITEM}>, md_description string",
    "claims": "claims array<string>, md_claims string",
    "drawings": "drawings array<struct<kind:string,num:string,file:string,text:string>>",
}
_ERRORS = "error_kind string, error_msg string"
RECORD = ", ".join([*GROUPS.values(), _ERRORS])


@cache
def names_of(ddl: str) -> list[str]:
    return [x.split()[0] for x in re.sub(r"<[^ ]*>", "", ddl).split(", ")]


FIELDS = names_of(RECORD)
#: Targets, in lower case, of the instructions that open a part of a description. Fixed values.
_SECTIONS = {"summary-of-invention": "summary", "brfsum": "summary", "brief-description-of-drawings": "drawings", "detailed-description": "detailed", "detdesc": "detailed"}
#: The heading of each part of a description. Fixed values.
HEADINGS = {
    "cross-reference": "## Cross-Reference To Related Applications",
    "summary": "## Summary Of The Invention",
    "drawings": "## Brief Description Of The Drawings",
    "detailed": "## Description Of The Invention",
}
#: Elements that name a party. Fixed values of the formats.
PARTIES = {"applicant": ("applicant", "us-applicant"), "assignee": ("assignee",), "inventor": ("inventor", "us-inventor", "first-named-inventor", "B721")}


class StructureError(ValueError):
    """A well-formed record without what its format requires."""


@dataclass
class Part:
    """A piece of a record: what it is, its attributes, its text or scalar values, and the pieces or runs in it."""

    kind: str
    attrs: list = field(default_factory=list)
    value: object = None
    items: list = field(default_factory=list)

    def first(self, kind: str):
        return next((x.value for x in self.items if x.kind == kind and x.value is not None), None)


def _opaque(e) -> Part:
    return Part("opaque", value=e)


def _number(v: str | None) -> int | None:
    return int(v) if v and re.fullmatch("[0-9]{1,9}", v) else None


class _Xml:
    """What the XML families share. A family gives element names to the methods below."""

    root: str
    #: What the root's children are; others are opaque.
    tops: dict[str, str]
    family: dict[str, str]
    levels: tuple[str, ...]
    paragraphs: tuple[str, ...]
    heading: str

    def part(self, e: Node) -> Part:
        return getattr(self, self.tops[e.tag])(e) if e.tag in self.tops else _opaque(e)

    def content(self, e: Node) -> list[Run]:
        return runs(e, self.family)

    def block(self, e: Node, kind: str) -> Part:
        level = next((e.get(x) for x in self.levels if e.get(x) is not None), None)
        return Part(kind, e.attrs, _number(level), self.content(e))

    def piece(self, k) -> Part:
        """A heading, a paragraph, or what the formats have no name for."""
        if isinstance(k, Node) and k.tag == self.heading:
            return self.block(k, "heading")
        return self.block(k, "paragraph") if isinstance(k, Node) and k.tag in self.paragraphs else _opaque(k)

    def abstract(self, e: Node) -> Part:
        return Part("abstract", e.attrs, items=[self.block(x, "paragraph") if x.tag in self.paragraphs else _opaque(x) for x in self.texts(e)])

    def texts(self, e: Node) -> list[Node]:
        return e.elements()

    def claims(self, e: Node) -> Part:
        return Part("claims", e.attrs, items=[self.claim(x) for x in e.elements()])

    def claim(self, e: Node) -> Part:
        if e.tag == "claim":
            return Part("claim", e.attrs, e.get("id"), self.content(e))
        return self.block(e, "heading") if e.tag == self.heading else _opaque(e)

    def drawings(self, e: Node) -> Part:
        return Part("drawings", e.attrs, items=[self.drawing(x) for x in e.elements()])

    images: tuple[str, ...] = ("image",)

    def drawing(self, e: Node) -> Part:
        if e.tag == "heading":
            return self.block(e, "heading")
        if e.tag == "representative-figure":
            return Part(e.tag, value=e.text())
        if e.tag == "figure":
            return Part("figure", e.attrs, items=[Part("image", x.attrs, x) if x.tag in self.images else _opaque(x) for x in e.elements()])
        return _opaque(e)


class _Modern(_Xml):
    """Version 4 grants and applications."""

    family, levels, paragraphs, heading, images = V4, ("level", "lvl"), ("p", "paragraph"), "heading", ("img", "image")

    def __init__(self, kind: str):
        self.root, self.kind = f"us-patent-{kind}", kind
        self.tops = {f"us-bibliographic-data-{kind}": "biblio"} | {x: x for x in ("abstract", "description", "claims", "drawings")}

    def missing(self) -> str:
        return f"v4.x {self.kind}s require {self.root} root"

    def biblio(self, b: Node) -> Part:
        out = Part("biblio", b.attrs)
        add = out.items.append

        def technical(p: Part) -> None:
            if not out.items or out.items[-1].kind != "technical":
                add(Part("technical"))
            out.items[-1].items.append(p)

        for e in b.elements():
            if e.tag == "publication-reference" and (x := e.child("document-id")) is not None:
                add(Part("id", value={"doc_number": x.at("doc-number") or "", "kind_code": x.at("kind"), "publication_date": x.at("date"), "country": x.at("country")}))
            elif e.tag == "application-reference":
                add(Part("filing", e.attrs, e.get("appl-type"), [Part("number", value=e.at("document-id", "doc-number")), Part("date", value=e.at("document-id", "date"))]))
            elif e.tag == "us-application-series-code":
                if not out.items or out.items[-1].kind != "filing":
                    add(Part("filing"))
                out.items[-1].items.append(Part("series", value=e.text()))
            elif e.tag == "us-related-documents":
                add(Part("continuity", e.attrs, items=[self.related(x) for x in e.elements()]))
            elif e.tag in ("parties", "us-parties"):
                for x in e.elements():
                    add(self.people(x, "applicants") if x.tag in ("applicants", "us-applicants") else self.people(x, "assignees") if x.tag == "assignees" else _opaque(x))
            elif e.tag == "assignees":
                add(self.people(e, "assignees"))
            elif e.tag in ("classification-ipc", "classification-national"):
                found = [e.at("main-classification"), *(x.text() or None for x in e.named("further-classification"))]
                technical(Part("ipc" if e.tag.endswith("ipc") else "us", e.attrs, found))
            elif e.tag == "classifications-ipcr":
                found = [x for c in e.named("classification-ipcr") if (x := self.symbol(c))]
                technical(Part("ipc", e.attrs, found))
            elif e.tag == "invention-title":
                technical(Part("title", value=e.text()))
            else:
                add(_opaque(e))
        return out

    def symbol(self, e: Node) -> str | None:
        parts = [e.at(x) for x in ("section", "class", "subclass", "main-group", "subgroup")]
        return "{}{}{}{}/{}".format(*parts) if all(parts) else None

    def related(self, e: Node) -> Part:
        if e.tag == "us-provisional-application":
            return Part("related", e.attrs, {"relationship": e.tag, "parent": e.at("document-id", "doc-number"), "parent_date": e.at("document-id", "date"), "child": None})
        if e.tag in ("continuation", "continuation-in-part", "division"):
            at = lambda who, what: e.at("relation", who, "document-id", what)
            return Part("related", e.attrs, {"relationship": e.tag, "parent": at("parent-doc", "doc-number"), "parent_date": at("parent-doc", "date"), "child": at("child-doc", "doc-number")})
        return _opaque(e)

    def people(self, e: Node, kind: str) -> Part:
        return Part(kind, e.attrs, items=[Part("party", x.attrs, self.party(x)) for x in e.named(*PARTIES[kind[:-1]])])

    def party(self, e: Node) -> str | None:
        if (book := e.child("addressbook")) is None:
            return None
        whole = book.child("orgname", "name")
        if whole is not None and whole.text():
            return whole.text()
        return " ".join(filter(None, (book.at(x) for x in ("first-name", "middle-name", "last-name")))) or None

    def description(self, e: Node) -> Part:
        """Instructions open and close the parts; a heading or paragraph outside opens one itself."""
        out, now = Part("description", e.attrs), None

        def opened(bucket: str) -> Part:
            out.items.append(Part("section", value=bucket))
            return out.items[-1]

        for k in e.kids:
            if isinstance(k, Mark):
                if k.target is None:
                    continue
                bucket = _SECTIONS.get(k.target.lower())
                if k.data and 'end="tail"' in k.data:
                    now = None
                    out.items.append(_opaque(k))
                elif bucket:
                    out.items.append(_opaque(k))
                    now = opened(bucket)
                else:
                    (now or out).items.append(_opaque(k))
            elif not isinstance(k, Node):
                if k.strip(SPACE):
                    (now or out).items.append(_opaque(k))
            elif k.tag == "description-of-drawings":
                now = now or opened("drawings")
                now.items += [self.piece(x) for x in k.kids if isinstance(x, (Node, Mark)) or x.strip(SPACE)]
            else:
                p = self.piece(k)
                if p.kind != "opaque":
                    now = now or opened("detailed")
                (now or out).items.append(p)
        return out


class _Grant25(_Xml):
    """Version 2.5 grants."""

    family, levels, paragraphs, heading, root = V25, ("LVL",), ("PARA",), "H", "PATDOC"
    tops = {"SDOBI": "biblio", "SDOAB": "abstract", "SDODE": "description", "SDOCL": "claims", "SDODR": "drawings"}

    def missing(self) -> str:
        return "UsptoGrantV25 requires PATDOC root"

    def content(self, e: Node) -> list[Run]:
        return runs(e.child("PTEXT") or e.child("STEXT") or e, V25)

    def texts(self, e: Node) -> list[Node]:
        return (e.child("BTEXT") or e).elements()

    def biblio(self, b: Node) -> Part:
        out = Part("biblio", b.attrs)
        for e in b.elements():
            if e.tag == "B100":
                out.items.append(Part("id", value={"doc_number": e.at("B110", "DNUM", "PDAT") or "", "kind_code": e.at("B130", "PDAT"), "publication_date": e.at("B140", "DATE", "PDAT"), "country": e.at("B190", "PDAT")}))
            elif e.tag == "B200":
                n = e.at("B210", "DNUM", "PDAT")
                n = (n.lstrip("0") or "0") if n and re.fullmatch("[0-9]+", n) else n
                out.items.append(Part("filing", e.attrs, items=[Part("number", value=n), Part("date", value=e.at("B220", "DATE", "PDAT"))]))
            elif e.tag == "B600":
                out.items.append(Part("continuity", e.attrs, items=[self.related(x) for x in e.elements()]))
            elif e.tag == "B500":
                technical, rest = Part("technical", e.attrs), []
                for x in e.elements():
                    if x.tag in ("B510", "B520"):
                        technical.items.append(Part("ipc" if x.tag == "B510" else "us", x.attrs, [x.at("B511" if x.tag == "B510" else "B521", "PDAT")]))
                    elif x.tag == "B540":
                        if title := x.at("STEXT", "PDAT"):
                            technical.items.append(Part("title", value=title))
                    else:
                        rest.append(_opaque(x))
                out.items += [technical] * bool(technical.items) + rest
            elif e.tag == "B700":
                for box, item, kind in (("B720", "B721", "applicants"), ("B730", "B731", "assignees")):
                    if (x := e.child(box)) is not None:
                        out.items.append(Part(kind, x.attrs, items=[Part("party", y.attrs, self.party(y)) for y in x.named(item)]))
            else:
                out.items.append(_opaque(e))
        return out

    def related(self, e: Node) -> Part:
        if e.tag == "B620":
            at = lambda who, what: e.at("PARENT-US", who, "DOC", what, "PDAT")
            return Part("related", e.attrs, {"relationship": "parent-us", "parent": at("PDOC", "DNUM"), "parent_date": at("PDOC", "DATE"), "child": at("CDOC", "DNUM")})
        if e.tag == "B680US":
            return Part("related", e.attrs, {"relationship": "us-provisional-application", "parent": e.at("DOC", "DNUM", "PDAT"), "parent_date": e.at("DOC", "DATE", "PDAT"), "child": None})
        return _opaque(e)

    def party(self, e: Node) -> str | None:
        at = lambda *path: e.at("PARTY-US", "NAM", *path, "PDAT")
        return at("ONM", "STEXT") or " ".join(filter(None, (at("FNM"), at("SNM", "STEXT")))) or None

    def description(self, e: Node) -> Part:
        buckets = {"BRFSUM": "summary", "DRWDESC": "drawings", "DETDESC": "detailed"}
        return Part("description", e.attrs, items=[Part("section", x.attrs, buckets[x.tag], [self.piece(y) for y in self.texts(x)]) if x.tag in buckets else _opaque(x) for x in e.elements()])

    def claims(self, e: Node) -> Part:
        return Part("claims", e.attrs, items=[self.claim(y) for x in e.elements() for y in (x.elements() if x.tag == "CL" else [x])])

    def claim(self, e: Node) -> Part:
        if e.tag == "CLM":
            return Part("claim", e.attrs, e.get("ID"), [Run("claim-text", self.content(x), x.attrs) if x.tag in ("PARA", "CLMSTEP") else Run("opaque", x) for x in e.elements()])
        return self.block(e, "heading") if e.tag == "H" else _opaque(e)

    def drawing(self, e: Node) -> Part:
        return Part("figure", [], items=[Part("image", e.attrs, e)]) if e.tag == "EMI" else _opaque(e)


class _Application15(_Xml):
    """Applications of versions 1.5 and 1.6."""

    family, levels, paragraphs, heading, root = V15, ("lvl",), ("paragraph",), "heading", "patent-application-publication"
    tops = {"subdoc-bibliographic-information": "biblio"} | {f"subdoc-{x}": x for x in ("abstract", "description", "claims", "drawings")}

    def missing(self) -> str:
        return "UsptoApplicationV15 requires patent-application-publication root"

    def biblio(self, b: Node) -> Part:
        out = Part("biblio", b.attrs)
        for e in b.elements():
            if e.tag == "document-id":
                p = Part("id", value={"doc_number": e.at("doc-number") or "", "kind_code": e.at("kind-code"), "publication_date": e.at("document-date"), "country": e.at("country-code")})
            elif e.tag == "publication-filing-type":
                p = Part(e.tag, value=e.text())
            elif e.tag == "domestic-filing-data":
                p = Part("filing", e.attrs, next((x.get("appl-type") for x in e.named("application-number")), None), [self.filing(x) for x in e.elements()])
            elif e.tag == "technical-information":
                p = Part("technical", e.attrs, items=[self.technical(x) for x in e.elements()])
            elif e.tag == "continuity-data":
                p = Part("continuity", e.attrs, items=[self.related(x) for x in e.elements()])
            elif e.tag == "inventors":
                p = Part("inventors", e.attrs, items=[Part(x.tag, x.attrs, {k: x.first_below(n) for k, n in (("first", "given-name"), ("last", "family-name"), ("city", "city"), ("state", "state"), ("country", "country-code"))}) if x.tag in ("first-named-inventor", "inventor") else _opaque(x) for x in e.elements()])
            elif e.tag == "correspondence-address":
                p = Part(e.tag, e.attrs, items=[Part(x.tag, value=x.text()) if x.tag in ("name-1", "name-2") else Part("address", x.attrs, x) if x.tag == "address" else _opaque(x) for x in e.elements()])
            else:
                p = _opaque(e)
            out.items.append(p)
        return out

    def filing(self, e: Node) -> Part:
        if e.tag == "application-number":
            return Part("number", e.attrs, e.at("doc-number"))
        kind = {"application-number-series-code": "series", "filing-date": "date"}.get(e.tag)
        return Part(kind, value=e.text()) if kind else _opaque(e)

    def technical(self, e: Node) -> Part:
        if e.tag == "title-of-invention":
            return Part("title", value=e.text())
        names = {"classification-ipc": ("ipc",), "classification-us": ("class", "subclass")}.get(e.tag)
        return Part(e.tag.removeprefix("classification-"), e.attrs, [e.first_below(*names)]) if names else _opaque(e)

    def related(self, e: Node) -> Part:
        if e.tag not in ("continuations", "a-371-of-international", "continuation-of", "continuation-in-part-of"):
            return _opaque(e)
        return Part("related", e.attrs, {"relationship": e.tag, "parent": e.first_below("doc-number"), "parent_date": e.first_below("document-date"), "child": None})

    def description(self, e: Node) -> Part:
        out = Part("description", e.attrs)
        buckets = {"cross-reference-to-related-applications": "cross-reference", "summary-of-invention": "summary", "brief-description-of-drawings": "drawings", "detailed-description": "detailed"}
        for x in e.elements():
            if (bucket := buckets.get(x.tag)) is None:
                out.items.append(_opaque(x))
            elif bucket == "cross-reference":
                out.items.append(Part("section", x.attrs, bucket, [self.piece(y) for y in x.elements()]))
            else:
                groups = [Part("group", y.attrs, items=[self.piece(z) for z in y.elements()]) if y.tag == "section" else _opaque(y) for y in x.elements()]
                out.items.append(Part("section", x.attrs, bucket, groups))
        return out


#: Section tags of tagged text, and those whose values keep their layout. Fixed values of the format.
_APS_SECTIONS = frozenset("PATN INVT ASSG PRIR REIS RLAP PARN CLAS UREF FREF OREF LREP PCTA ABST GOVT BSUM DRWD DETD CLMS DCLM".split())
_VERBATIM = frozenset(("TBL", "EQU", "TBL3"))


def tagged_fields(raw: str) -> list[list[str]]:
    """[section, tag, value] of a tagged-text record: tags in columns 1 to 4, values from column 6; lines that begin with a
    blank go on with the value before."""
    out: list[list[str]] = []
    section, head = "PATN", True
    for line in raw.replace("\r\n", "\n").split("\n"):
        blank = not line.strip(SPACE)
        if head and (blank or line.strip(SPACE) == "PATN" or line.strip(SPACE).startswith("HHHHH")):
            continue
        head = False
        last = out[-1] if out else None
        keeps = last is not None and last[1] in _VERBATIM
        if blank:
            if keeps:
                last[2] += "\n"
            continue
        # columns are bytes: a tag field that ends inside a character makes the whole line the tag
        if line[:6].isascii():  # the columns are characters, too
            tag, value = line[:4].rstrip(SPACE), line[5:].rstrip(SPACE)
        else:
            data = line.encode()
            tag = (line if len(data) < 4 or _inside(data, 4) else data[:4].decode()).rstrip(SPACE)
            value = "" if len(data) < 5 or _inside(data, 5) else data[5:].decode(errors="ignore").rstrip(SPACE)
        if line[0] == " " or not tag:
            if keeps:
                last[2] += "\n" + value
            elif last is not None:
                more = value.lstrip(SPACE)
                last[2] = f"{last[2]} {more}" if last[2] else more
        elif tag in _APS_SECTIONS:
            section = tag
        else:
            out.append([section, tag, value])
    return out


def _inside(data: bytes, at: int) -> bool:
    """Whether a cut at this byte would split a character."""
    return at < len(data) and data[at] & 0xC0 == 0x80


def wku(value: str) -> tuple[str, str | None]:
    """(number, kind) of an identifier: letters, zero-padded digits and one check character at the end."""
    prefix, body = re.fullmatch(r"(?s)([A-Za-z]*)(.*)", value.strip(SPACE)).groups()
    digits = re.sub("[^0-9]", "", body[:-1] if len(body) > 1 else body).lstrip("0") or "0"
    return prefix + digits, {"D": "S", "RE": "E", "PP": None, "P": None}.get(prefix, "B1")


def application_serial(value: str) -> str:
    """A serial without the sign that may follow its digits."""
    v = value.strip(SPACE)
    return v[:-1] if re.fullmatch(r"[0-9]+[^A-Za-z0-9]", v) else v


def _aps(raw: str, groups: tuple[str, ...] | None = None) -> list[Part]:
    """The parts of some groups, or all; what is missing is an error in any case."""
    asked = lambda group: groups is None or group in groups
    fields = tagged_fields(raw)
    if not fields:
        raise StructureError("APS record has no recognizable tagged fields")
    one = lambda tag: next((v for s, t, v in fields if s == "PATN" and t == tag), None) or None
    many = lambda section, tag: [v for s, t, v in fields if s == section and t == tag and v]
    if not one("WKU"):
        raise StructureError("APS record missing WKU (patent number)")
    parts = [_aps_biblio(fields, one, many)] if asked("biblio") else []

    def paragraph(t: str, v: str) -> Part:
        return Part("paragraph", [], int(t[2]) if re.fullmatch("PA[0-3]", t) else None, [Run("text", f"```\n{v}\n```" if t in _VERBATIM else v)])

    if asked("abstract") and (own := [paragraph(t, v) for s, t, v in fields if s == "ABST" and v]):
        parts.append(Part("abstract", items=own))
    sections = []
    for tag, bucket in (("BSUM", "summary"), ("DRWD", "drawings"), ("DETD", "detailed")) if asked("description") else ():
        if inside := [(t, v) for s, t, v in fields if s == tag]:
            sections.append(Part("section", value=bucket, items=[Part("heading", items=[Run("text", v)]) if t == "PAC" else paragraph(t, v) for t, v in inside if t == "PAC" or v]))
    if sections:
        parts.append(Part("description", items=sections))
    if asked("claims") and (claims := _aps_claims(fields)):
        parts.append(Part("claims", items=[Part("claim", items=c) for c in claims]))
    return parts


def _aps_biblio(fields: list[list[str]], one, many) -> Part:
    number, kind = wku(one("WKU"))
    filing = [Part("number", value=application_serial(one("APN")))] if one("APN") else []
    filing += [Part("date", value=one("APD"))] if one("APD") else []
    technical = [Part("title", value=one("TTL"))] if one("TTL") else []
    technical += [Part("ipc", value=x)] if (x := [squeezed(v) for v in many("CLAS", "ICL")]) else []
    technical += [Part("us", value=x)] if (x := [squeezed(v) for v in many("CLAS", "OCL") + many("CLAS", "XCL")]) else []
    biblio = Part("biblio", items=[Part("id", value={"doc_number": number, "kind_code": kind, "publication_date": one("ISD"), "country": "US"})])
    biblio.items += [Part("filing", value=one("APT"), items=filing)] if filing else []
    biblio.items += [Part("technical", items=technical)] if technical else []
    people: list[Part] = []
    for s, t, v in fields:
        if s == "INVT" and t == "NAM":
            last, _, first = v.partition(";")
            people.append(Part("inventor" if people else "first-named-inventor", value={"first": first.strip(SPACE) or None, "last": last.strip(SPACE) or None, "city": None, "state": None, "country": None}))
        elif s == "INVT" and t in ("CTY", "STA", "CNT") and people:
            people[-1].value[{"CTY": "city", "STA": "state", "CNT": "country"}[t]] = v
    biblio.items += [Part("inventors", items=people)] if people else []
    held = [Part("party", value=v) for s, t, v in fields if s == "ASSG" and t == "NAM"]
    biblio.items += [Part("assignees", items=held)] if held else []
    return biblio


def _aps_claims(fields: list[list[str]]) -> list[list[Run]]:
    claims: list[list[Run]] = []
    now: list[Run] | None = None
    for s, t, v in fields:
        if s != "CLMS" or t == "STM":
            continue
        if t == "NUM":
            now = None
        elif v:
            if now is None:
                claims.append(now := [])
            now.append(Run("claim-text", [Run("text", v)]))
    if design := [Run("claim-text", [Run("text", v)]) for s, t, v in fields if s == "DCLM" and v]:
        claims.append(design)
    return claims


ADAPTERS = {"grant": _Modern("grant"), "application": _Modern("application"), "grant25": _Grant25(), "application15": _Application15()}


def adapter(form: str) -> _Xml | None:
    """The reader of an XML format; null for tagged text."""
    if form == "UsptoGrantApsGreenBook":
        return None
    family = "grant" if form.startswith("UsptoGrant") else "application"
    return ADAPTERS[family if "V4" in form else {"grant": "grant25", "application": "application15"}[family]]


@dataclass
class Model:
    form: str
    prolog: str
    attrs: list
    parts: list[Part]


def model(raw: str, form: str, groups: tuple[str, ...] | None = None) -> Model:
    """The parts of a record in order (all, or those of some groups). StructureError or ValueError if it can't be read as
    that format."""
    a = adapter(form)
    if a is None:
        return Model(form, "", [], _aps(raw, groups))
    if groups is not None and not groups:
        if checked_root(raw) != a.root:
            raise StructureError(a.missing())
        return Model(form, "", [], [])
    root, prolog = tree(raw, None if groups is None else lambda tag: a.tops.get(tag) in groups)
    if root.tag != a.root:
        raise StructureError(a.missing())
    return Model(form, prolog, root.attrs, [a.part(e) for e in root.elements() if groups is None or a.tops.get(e.tag) in groups])


def _unique(items) -> list[str]:
    return list(dict.fromkeys(items))


def _name_in(e: Node) -> str | None:
    """A party's name in an element that has no fixed form: organisations first, then people."""
    at = lambda n, *path: _path(n, path)
    box = lambda name: next((x for x in e.walk() if x.tag == name), None)
    found = at(e, "addressbook", "orgname") or at(e, "organization-name") or at(e, "orgname")
    for name in () if found else ("addressbook", "name"):
        if (x := box(name)) is not None:
            found = found or " ".join(filter(None, (at(x, "first-name") or at(x, "given-name"), at(x, "last-name") or at(x, "family-name"))))
    if not found and (x := box("NAM")) is not None:
        found = at(x, "ONM") or " ".join(filter(None, (at(x, "FNM"), at(x, "SNM"))))
    return (found or "").strip(SPACE) or None


def _path(e: Node, path: tuple[str, ...]) -> str | None:
    """The text of the first element on a path of children, marks included, entities decoded."""
    if not path:
        out, todo = [], e.kids[::-1]
        while todo:
            k = todo.pop()
            if isinstance(k, Node):
                todo += k.kids[::-1]
            else:
                out.append(k)
        return decoded("".join(out).strip(SPACE)) or None
    deep = [x for x in e.named(path[0]) if len(path) == 1 or any(y.tag == path[1] for y in x.elements())]
    return _path(deep[0], path[1:]) if deep else None


def _named(biblio: Part, who: str) -> list[str]:
    """Names from the typed parts; if there are none, from elements of that name in the opaque ones."""
    if who == "inventor":
        typed = [" ".join(filter(None, (x.value["first"], x.value["last"]))).strip(SPACE) for p in biblio.items if p.kind == "inventors" for x in p.items if x.kind != "opaque"]
    else:
        typed = [x.value for p in biblio.items if p.kind == f"{who}s" for x in p.items]
    if found := _unique(x for x in typed if x) if who == "inventor" else _unique(x for x in typed if x is not None):
        return found
    todo, out = [p.value for p in biblio.items if p.kind == "opaque"][::-1], []
    while todo:
        e = todo.pop()
        if e.tag in PARTIES[who]:
            out.append(_name_in(e))
        else:
            todo += e.elements()[::-1]
    return _unique(x for x in out if x)


def _biblio(parts: list[Part]) -> dict:
    b = next((p for p in parts if p.kind == "biblio"), None)
    out = dict.fromkeys(names_of(GROUPS["biblio"])) | {k: [] for k in ("ipc", "us", "priority", "applicants", "assignees", "inventors")}
    if b is None:
        return out
    ids = next((p.value for p in b.items if p.kind == "id"), None)
    filing = [p for p in b.items if p.kind == "filing"]
    filed = next((p for p in filing if p.first("number") is not None), None)
    technical = [x for p in b.items if p.kind == "technical" for x in p.items]
    out |= ids or {}
    out["appl_type"] = next((p.value for p in filing if p.value is not None), None)
    if filed is not None:
        out |= {"application_number": filed.first("number"), "series": filed.first("series")}
    out["filing_date"] = next((x for p in filing if (x := p.first("date")) is not None), None)
    out["title"] = next((x.value for x in technical if x.kind == "title"), None)
    for kind in ("ipc", "us"):
        out[kind] = _unique(v for x in technical if x.kind == kind for v in x.value if v is not None)
    out["priority"] = [x.value for p in b.items if p.kind == "continuity" for x in p.items if x.kind == "related"]
    out |= {f"{who}s": _named(b, who) for who in PARTIES}
    lead = next((x.value for p in b.items if p.kind == "inventors" for x in p.items if x.kind == "first-named-inventor"), None)
    out["first_inventor"] = " ".join(filter(None, (lead["first"], lead["last"]))) or None if lead else None
    return out


def _paragraph_text(p: Part) -> str:
    """A paragraph in Markdown, its number in front where that is of digits only and not there already."""
    text = reading(p.items, True)
    num = next((v for k, v in p.attrs if k == "num"), None)
    if num is None or not re.fullmatch("[0-9]*", num):
        return text
    rest = text.lstrip(SPACE)
    return text if rest.startswith(f"[{num}]") else f"[{num}] {rest}"


class _Lines:
    """Lines of a block of Markdown; paragraphs stand apart."""

    def __init__(self, *lines: str):
        self.lines = list(lines)

    def put(self, text: str) -> None:
        if text := text.strip(SPACE):
            self.lines.append(text)

    def paragraph(self, p: Part) -> None:
        if text := _paragraph_text(p).strip(SPACE):
            if self.lines and self.lines[-1]:
                self.lines.append("")
            self.lines.append(text)

    def whole(self) -> str:
        a, b = 0, len(self.lines)
        while a < b and not self.lines[a]:
            a += 1
        while b > a and not self.lines[b - 1]:
            b -= 1
        return "\n".join(self.lines[a:b])


def _flat(section: Part) -> list[Part]:
    return [y for x in section.items for y in (x.items if x.kind == "group" else [x])]


def _abstract_block(part: Part) -> str:
    out = _Lines("## Abstract")
    for p in part.items:
        out.put(markup(p.value)) if p.kind == "opaque" else out.paragraph(p)
    return out.whole()


def _description_block(part: Part) -> str:
    out = _Lines()
    for section in part.items:
        if section.kind == "opaque":
            out.put(markup(section.value))
        else:
            out.lines.append(HEADINGS[section.value])
            for p in _flat(section):
                if p.kind == "opaque":
                    out.put(markup(p.value))
                elif p.kind == "paragraph":
                    out.paragraph(p)
                elif section.value != "cross-reference":
                    out.put("### " + reading(p.items, True).strip(SPACE))
        out.lines.append("")
    return out.whole()


def _claims_block(part: Part) -> str:
    out = _Lines("## Claims")
    for p in part.items:
        if p.kind == "claim":
            out.lines += ["```claim", claim_block(p.items), "```"]
        else:
            out.put(markup(p.value) if p.kind == "opaque" else reading(p.items, True))
    return out.whole()


def _blocks(parts: list[Part], block) -> str:
    return "\n\n".join(filter(None, map(block, parts)))


def _abstract_text(parts: list[Part]) -> str | None:
    for part in parts:
        text = "\n\n".join(t for p in part.items if p.kind == "paragraph" and (t := reading(p.items, False)).strip(SPACE))
        if text:
            return text
    return None


def _items(parts: list[Part]) -> list[dict] | None:
    out = []
    for part in parts:
        for section in part.items:
            for p in [section] if section.kind == "opaque" else [Part("section", value=section.value), *_flat(section)]:
                bucket = "other" if section.kind == "opaque" else section.value
                text = markup(p.value) if p.kind == "opaque" else HEADINGS[p.value] if p.kind == "section" else reading(p.items, True)
                out.append({"bucket": bucket, "kind": p.kind, "num": next((v for k, v in p.attrs if k == "num"), None), "level": p.value if p.kind in ("heading", "paragraph") else None, "text": text.strip(SPACE)})
    return out if parts else None


def _drawings(parts: list[Part]) -> list[dict] | None:
    out = []
    for p in (x for part in parts for x in part.items):
        one = lambda kind, num=None, file=None, text=None: out.append({"kind": kind, "num": num, "file": file, "text": text})
        if p.kind == "figure":
            for x in p.items:
                if x.kind == "image":
                    one("figure", next((v for k, v in p.attrs if k == "num"), None), x.value.get("file") or x.value.get("FILE"))
        elif p.kind != "opaque":
            one(p.kind, text=p.value if p.kind == "representative-figure" else reading(p.items, False))
    return out if parts else None


def record(m: Model, groups=tuple(GROUPS)) -> dict:
    """The columns of the wanted groups."""
    out: dict = {}
    of = lambda kind: [p for p in m.parts if p.kind == kind]
    if "biblio" in groups:
        out |= _biblio(m.parts)
    if "abstract" in groups:
        out |= {"abstract": _abstract_text(of("abstract")), "md_abstract": _blocks(of("abstract"), _abstract_block)}
    if "description" in groups:
        out |= {"description": _items(of("description")), "md_description": _blocks(of("description"), _description_block)}
    if "claims" in groups:
        texts = (reading(p.items, False).strip(SPACE) for part in of("claims") for p in part.items if p.kind == "claim")
        out |= {"claims": [t for t in texts if t], "md_claims": _blocks(of("claims"), _claims_block)}
    if "drawings" in groups:
        out["drawings"] = _drawings(of("drawings"))
    return out


def parse_record(raw: str | None, form: str | None, error_kind: str | None = None, error_msg: str | None = None, groups=tuple(GROUPS), read=None) -> dict:
    """One row of the wanted groups, by read(raw, groups) if it is given. What fails is in error_kind and error_msg; nothing
    is raised."""
    empty = {n: None for g in groups for n in names_of(GROUPS[g])} | {"error_kind": None, "error_msg": None}
    if form is None:
        return empty | {"error_kind": error_kind or "Malformed", "error_msg": error_msg or ""}
    try:
        found = read(raw or "", groups) if read else record(model(raw or "", form, groups), groups)
        return empty | {k: v for k, v in found.items() if k in empty}
    except StructureError as e:
        return empty | {"error_kind": "UnsupportedStructure", "error_msg": str(e)}
    except ValueError as e:
        return empty | {"error_kind": "MalformedXml", "error_msg": str(e)}
