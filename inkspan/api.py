"""One record at a time in plain Python, and the same as SQL functions: detect, parse, Markdown, write-back."""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import templates
from .functions.records import GROUPS, RECORD, Model, StructureError, model, parse_record, record
from .functions.writeback import write_model
from .sources.archives import split_records

_ROOT = re.compile(C.ROOT_PATTERN)
_FAMILY = {"patent-application-publication": "application", "us-patent-application": "application", "us-patent-grant": "grant", "PATDOC": "grant"}
_DOCTYPES = (("application", "<!DOCTYPE us-patent-application"), ("grant", "<!DOCTYPE us-patent-grant"), ("grant", "<!DOCTYPE PATDOC"))
#: What a failed detection says. Fixed values.
_MESSAGES = {
    "Malformed": "malformed XML",
    "Supplemental": "supplemental XML root '{}'",
    "UnsupportedRoot": "unsupported XML root '{}'",
    "UnknownFormat": "unknown XML format",
    "ConflictingVersionMarkers": "conflicting XML version markers",
}


def detect(raw: str | None) -> tuple[str | None, str | None, str | None]:
    """(format, error kind, root): what columns.source_format gives for one text."""
    text = raw or ""
    first = re.match(r"\s*+([^\r\n]*)", text, re.A)[1]
    line = re.match(r"(?:[^\S\n]*+\n)*+([^\r\n]*)", text, re.A)[1]
    if first.rstrip(" ") == "PATN" or (line.startswith("HHHHH") and "APS" in first):
        return "UsptoGrantApsGreenBook", None, None
    m = _ROOT.match(text)
    if not m:
        return None, "Malformed", ""
    family = _FAMILY.get(m[1])
    if family is None:
        return None, "UnsupportedRoot", m[1]
    found = {(name, fam) for name, fam, mark in C.MARKERS if mark in text}
    for fam, name, most in (("application", "UsptoApplicationV4", 7), ("grant", "UsptoGrantV4", 8)):
        found |= {(f"{name}{n}", fam) for n in range(most) if family == fam and f'dtd-version="v4{"." if n or fam == "application" else ""}{n}' in text}
    families = {fam for _, fam in found} | {fam for fam, mark in _DOCTYPES if mark in text}
    names = {name for name, _ in found}
    if families - {family} or len(names) > 1:
        return None, "ConflictingVersionMarkers", m[1]
    return (names.pop(), None, None) if names else (None, "UnknownFormat", m[1])


def is_aps_text(raw: str) -> bool:
    return detect(raw)[0] == "UsptoGrantApsGreenBook"


def detect_format(raw: str) -> str:
    form, kind, root = detect(raw)
    if form is None:
        kind = "Supplemental" if kind == "UnsupportedRoot" and root in ("sequence-cwu", "table") else kind
        raise ValueError(_MESSAGES[kind].format(root))
    return form


class Claim(NamedTuple):
    number: int
    text: str

    def __repr__(self) -> str:
        return f"Claim(number={self.number}, text={_quoted(self.text[:60])}{'…' if len(self.text) > 60 else ''})"


def _quoted(text: str | None) -> str:
    """A string in double quotes with its controls escaped; None as it is."""
    if text is None:
        return "None"
    signs = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(signs.get(c, c) for c in text) + '"'


def _is_grant(kind: str | None) -> bool:
    return bool(kind) and (kind[0] in "BE" or kind == "S")


def _compact(number: str | None) -> str | None:
    t = None if number is None else number.strip(C.SPACE)
    return (t.replace("/", "").lstrip("0") or "0") if t and re.fullmatch("[0-9]+/[0-9]+", t) else t


class Document:
    """A parsed record with its derived fields."""

    def __init__(self, parsed: Model):
        self.model, self.record, self.source_format = parsed, record(parsed), parsed.form

    def _compact(self, grant: bool) -> str | None:
        r = self.record
        if r["doc_number"] is None or _is_grant(r["kind_code"]) != grant:
            return None
        n = r["doc_number"]
        return (r["country"] or "US") + ((n.lstrip("0") or "0") if grant and re.fullmatch("[0-9]*", n) else n) + (r["kind_code"] or "")

    @property
    def publication_number(self) -> str | None:
        return self._compact(False)

    @property
    def patent_number(self) -> str | None:
        return self._compact(True)

    @property
    def application_number(self) -> str | None:
        n, s = self.record["application_number"], self.record["series"]
        n = n.strip(C.SPACE) if n is not None else None
        return s + n if n is not None and s is not None and re.fullmatch("[0-9]*", s) and re.fullmatch("[0-9]*", n) and len(n) < 8 else n

    @property
    def application_label(self) -> str | None:
        n, s = self.record["application_number"], (self.record["series"] or "").strip(C.SPACE)
        n = n.strip(C.SPACE) if n is not None else None
        return n if not s or n is None else f"{s}/{n.removeprefix(s) if len(n) >= 8 else n}"

    @property
    def title(self) -> str | None:
        return self.record["title"]

    @property
    def filing_date(self) -> str | None:
        return self.record["filing_date"]

    @property
    def publication_date(self) -> str | None:
        return self.record["publication_date"]

    @property
    def priority_date(self) -> str | None:
        return min((e["parent_date"] for e in self.record["priority"] if e["parent_date"]), default=None)

    @property
    def applicants(self) -> list[str]:
        return self.record["applicants"]

    @property
    def assignees(self) -> list[str]:
        return self.record["assignees"]

    @property
    def inventors(self) -> list[str]:
        return self.record["inventors"]

    @property
    def ipc_classifications(self) -> list[str]:
        return self.record["ipc"]

    @property
    def us_classifications(self) -> list[str]:
        return self.record["us"]

    @property
    def abstract_text(self) -> str | None:
        return self.record["abstract"]

    @property
    def claims(self) -> list[Claim]:
        return [Claim(i, t) for i, t in enumerate(self.record["claims"], 1)]

    def sections(self) -> dict[str, str | None]:
        """The five sections, as operators.project.sections makes them."""
        r = self.record
        pairs = lambda e: (("relationship", e["relationship"] or "unknown"), ("parent_doc_number", _compact(e["parent"])), ("parent_date", e["parent_date"]), ("child_doc_number", _compact(e["child"])))
        chain = ["\n    ".join(f"{k}: {'null' if v is None else v}" for k, v in pairs(e)) for e in r["priority"]]
        scalars = (("filing_date", r["filing_date"]), ("application_number", self.application_label), ("publication_number", self.publication_number), ("publication_date", r["publication_date"]), ("patent_number", self.patent_number), ("priority_date", self.priority_date))
        lists = (("ipc_classifications", self.ipc_classifications), ("us_classifications", self.us_classifications), ("priority_chain", chain), ("applicants", self.applicants), ("assignees", self.assignees))
        front = ["---", *(f"{k}: {'null' if v is None else v}" for k, v in scalars)]
        front += [f"{k}:" + ("".join(f"\n  - {x}" for x in v) or " []") for k, v in lists]
        return {"frontmatter": "\n".join([*front, "---"]), "title": None if r["title"] is None else f"# {r['title']}", "abstract": r["md_abstract"], "description": r["md_description"], "claims": r["md_claims"]}

    def to_markdown(self, template: str | None = None) -> str:
        return templates.render_text(self.sections(), templates.DEFAULT if template is None else template)

    def to_xml(self) -> str:
        return write_model(self.model)

    def __repr__(self) -> str:
        return f"Document(publication_number={_quoted(self.publication_number)}, title={_quoted(self.title)})"


def parse(raw: str, form: str | None = None) -> Document:
    """The record of one text, of the given or the detected format; ValueError where it can't be parsed."""
    if form is None:
        try:
            form = detect_format(raw)
        except ValueError as e:
            raise ValueError(f"source detection failed: {e}") from None
    return Document(model(raw, form))


def parse_aps(raw: str) -> Document:
    """A tagged-text record, whatever its text looks like."""
    return Document(model(raw, "UsptoGrantApsGreenBook"))


def parse_to_markdown(raw: str, template: str | None = None) -> str:
    return parse(raw).to_markdown(template)


def is_parsable(raw: str) -> bool:
    form, _, _ = detect(raw)
    if form is None:
        return False
    try:
        model(raw, form, ())
    except (StructureError, ValueError):
        return False
    return True


def _each(column: pa.Array, f) -> list:
    out = []
    for x in column.to_pylist():
        try:
            out.append(None if x is None else f(x))
        except ValueError:
            out.append(None)
    return out


def register(spark: SparkSession) -> None:
    """SQL functions patent_format(xml), patent_to_markdown(xml[, template]), patent_to_xml(xml), parse_patent(xml), and table
    functions patent_claims(xml), patent_priority(xml), patent_parties(xml) and patent_records(text), the records of a file's text.

    Arrow batches; null for null and for what can't be parsed, but parse_patent gives such rows with error_kind. A
    template that can't be read fails the query.
    """

    @F.arrow_udf("string")
    def patent_format(xml: pa.Array) -> pa.Array:
        return pa.array(_each(xml, detect_format), pa.string())

    @F.arrow_udf("string")
    def patent_to_markdown(xml: pa.Array, template: pa.Array = None) -> pa.Array:
        if template is None:
            return pa.array(_each(xml, parse_to_markdown), pa.string())
        wanted = template.to_pylist()
        for t in set(wanted) - {None}:
            templates.parse(t)
        out = []
        for x, t in zip(xml.to_pylist(), wanted):
            out += _each(pa.array([x], pa.string()), lambda raw, t=t: parse_to_markdown(raw, t))
        return pa.array(out, pa.string())

    @F.arrow_udf("string")
    def patent_to_xml(xml: pa.Array) -> pa.Array:
        return pa.array(_each(xml, lambda x: parse(x).to_xml()), pa.string())

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    whole = to_arrow_type(StructType.fromDDL(RECORD))

    @F.arrow_udf(StructType.fromDDL(RECORD))
    def parse_patent(xml: pa.Array) -> pa.Array:
        return pa.array([parse_record(x, *detect(x), tuple(GROUPS)) for x in xml.to_pylist()], whole)

    @F.udtf(returnType="number int, text string")
    class PatentClaims:
        def eval(self, xml: str):
            if xml is not None:
                yield from enumerate(parse_record(xml, *detect(xml), ("claims",))["claims"] or [], 1)

    @F.udtf(returnType="pos int, relationship string, parent string, parent_date string, child string")
    class PatentPriority:
        def eval(self, xml: str):
            for i, e in enumerate((parse_record(xml, *detect(xml), ("biblio",))["priority"] or []) if xml is not None else []):
                yield i, e["relationship"], e["parent"], e["parent_date"], e["child"]

    @F.udtf(returnType="role string, pos int, name string, first_named boolean")
    class PatentParties:
        def eval(self, xml: str):
            row = parse_record(xml, *detect(xml), ("biblio",)) if xml is not None else {}
            for role in ("applicant", "assignee", "inventor"):
                for i, name in enumerate(row.get(f"{role}s") or []):
                    yield role, i, name, role == "inventor" and name == row["first_inventor"]

    @F.udtf(returnType="ordinal int, raw string")
    class PatentRecords:
        def eval(self, text: str):
            tagged = text is not None and detect(text)[0] == "UsptoGrantApsGreenBook"
            yield from enumerate(split_records(text or "", tagged))

    for name, f in (("patent_format", patent_format), ("patent_to_markdown", patent_to_markdown), ("patent_to_xml", patent_to_xml), ("parse_patent", parse_patent)):
        spark.udf.register(name, f)
    spark.udtf.register("patent_claims", PatentClaims)
    spark.udtf.register("patent_priority", PatentPriority)
    spark.udtf.register("patent_parties", PatentParties)
    spark.udtf.register("patent_records", PatentRecords)
