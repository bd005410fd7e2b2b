"""Scalar functions over raw records and parsed fields, as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, by which the formats' texts are trimmed.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Version markers: (format, family, substring). Fixed values of the formats.
MARKERS = (
    ("UsptoApplicationV15", "application", "pap-v15-2001-01-31.dtd"),
    ("UsptoApplicationV16", "application", "pap-v16"),
    ("UsptoGrantV25", "grant", "ST32-US-Grant-025xml.dtd"),
    ("UsptoGrantV25", "grant", 'DTD="2.5"'),
    *((f"UsptoApplicationV4{n}", "application", f"us-patent-application-v4{n}") for n in range(7)),
    *((f"UsptoGrantV4{n}", "grant", f"us-patent-grant-v4{n}") for n in range(8)),
)
#: Of these, those of version 4 as patterns: kind, name, last version.
_VERSIONS = (("application", "UsptoApplicationV4", 6), ("grant", "UsptoGrantV4", 7))
#: Named entities that are decoded in text, in this order. Fixed values.
ENTITIES = (
    ("&lsqb;", "["), ("&rsqb;", "]"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&lsquo;", "'"), ("&rsquo;", "'"),
    ("&mdash;", "-"), ("&ndash;", "-"), ("&apos;", "'"), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ("&Prime;", '"'), ("&prime;", "'"), ("&equals;", "="), ("&deg;", " deg"),
)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def decode_bytes(data: Column) -> Column:
    """UTF-8, or ISO-8859-1 for the whole unit if any byte isn't."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, "ISO-8859-1"))


#: What may stand before the root: instructions, comments and doctypes, of which each ends at the next "]>" or else ">".
#: Possessive, so that no text of any length is tried twice or held on the stack.
_BEFORE = r"(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE(?:.*?\]>|[^>]*+>))"
ROOT_PATTERN = rf"(?s)\A\s*+(?:{_BEFORE}\s*+)*+<([^\s>/!?][^\s>/]*+)"
_ROOT_TAG = rf"(?s)\A[^<]*+(?:{_BEFORE}[^<]*+)*+(<[^!/?][^>]*+>)"


def root_name(raw: Column) -> Column:
    """The first element's name: declarations, doctype, processing instructions and comments are passed over."""
    return F.nullif(F.regexp_extract(raw, ROOT_PATTERN, 1), F.lit(""))


def is_aps(raw: Column) -> Column:
    """A tagged-text record: its first line that isn't blank is PATN, or a header line that names APS."""
    first = F.regexp_extract(raw, r"\A\s*+([^\r\n]*)", 1)
    named = (F.rtrim(first) == "PATN") | (F.regexp_extract(raw, r"\A(?:[^\S\n]*+\n)*+([^\r\n]*)", 1).startswith("HHHHH") & first.contains("APS"))
    return (raw.contains("PATN") | raw.contains("HHHHH")) & named  # most records have neither, which costs no pattern


def _family(root: Column) -> Column:
    return F.when(root.isin("patent-application-publication", "us-patent-application"), "application").when(root.isin("us-patent-grant", "PATDOC"), "grant")


def version_formats(raw: Column, root: Column) -> Column:
    """The formats that a record's markers name, distinct. Fixed texts are looked for as such, and a pattern is searched only
    where the text that it begins with is there, so that a record is seldom decoded."""
    family = _family(root)
    none = F.array().cast("array<string>")
    versions = lambda pattern, name: F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), lambda n: F.concat(F.lit(name), F.replace(n, F.lit("."))))
    fixed = F.array_compact(F.array(*[F.when(raw.contains(mark), name) for name, _, mark in MARKERS if not mark.startswith("us-patent")]))
    some = [F.when(raw.contains(f"us-patent-{kind}-v4"), versions(rf"us-patent-{kind}-v4([0-{last}])", name)).otherwise(none) for kind, name, last in _VERSIONS]
    own = F.when(family == "application", versions(r'dtd-version="v4(\.[0-6])', "UsptoApplicationV4")).when(family == "grant", versions(r'dtd-version="v4(0|\.[1-7])', "UsptoGrantV4"))
    return F.array_distinct(F.concat(fixed, *some, F.coalesce(F.when(raw.contains('dtd-version="v4'), own), none)))


def version_families(raw: Column, found: Column) -> Column:
    """The families of the formats that markers name, and of doctypes, distinct."""
    doctypes = (("application", "<!DOCTYPE us-patent-application"), ("grant", "<!DOCTYPE us-patent-grant"), ("grant", "<!DOCTYPE PATDOC"))
    named = F.transform(found, lambda x: F.when(x.startswith("UsptoApplication"), "application").otherwise("grant"))
    return F.array_distinct(F.concat(F.coalesce(named, F.array().cast("array<string>")), F.array_compact(F.array(*[F.when(raw.contains(m), fam) for fam, m in doctypes]))))


def resolved_format(raw: Column, root: Column, aps: Column, found: Column, families: Column) -> Column:
    """source_format from its parts, which callers over many rows make as columns first, so that each is made once."""
    family = _family(root)
    foreign = F.exists(families, lambda x: x != family)
    kind = (
        F.when(aps, None)
        .when(F.coalesce(raw, F.lit("")).rlike(r"\A\s*\z") | root.isNull(), "Malformed")
        .when(family.isNull(), "UnsupportedRoot")
        .when(foreign | (F.size(found) > 1), "ConflictingVersionMarkers")
        .when(F.size(found) == 0, "UnknownFormat")
    )
    form = F.when(aps, "UsptoGrantApsGreenBook").when(kind.isNull(), F.get(found, F.lit(0)))
    return F.struct(form.alias("format"), kind.alias("error_kind"), F.when(kind.isNotNull(), F.coalesce(root, F.lit(""))).alias("error_msg"))


def source_format(raw: Column) -> Column:
    """struct(format, error_kind, error_msg): exactly one of format and error_kind is set."""
    root = root_name(raw)
    found = version_formats(raw, root)
    return resolved_format(raw, root, is_aps(raw), found, version_families(raw, found))


def skip_class(kind: Column, root: Column) -> Column:
    """Why a record that failed is skipped: Supplemental, Unsupported or Malformed; null for none."""
    return F.when(kind.isNull(), None).when((kind == "UnsupportedRoot") & root.isin("sequence-cwu", "table"), "Supplemental").when(kind.isin("UnsupportedRoot", "UnknownFormat", "ConflictingVersionMarkers", "UnsupportedStructure"), "Unsupported").otherwise("Malformed")


def is_grant(kind_code: Column) -> Column:
    return F.coalesce(kind_code.startswith("B") | kind_code.startswith("E") | (kind_code == "S"), F.lit(False))


def decode_entities(c: Column) -> Column:
    for name, value in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def strip_zeros(c: Column) -> Column:
    """Leading zeros go from all-digit identifiers; all zeros: 0."""
    return F.when(c.rlike(r"\A[0-9]*\z"), F.coalesce(F.nullif(F.regexp_replace(c, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(c)


def document_number(number: Column, kind_code: Column) -> Column:
    return F.when(is_grant(kind_code), strip_zeros(number)).otherwise(number)


def compact_number(country: Column, number: Column, kind_code: Column) -> Column:
    return F.concat(F.coalesce(country, F.lit("US")), document_number(number, kind_code), F.coalesce(kind_code, F.lit("")))


def application_label(number: Column, series: Column) -> Column:
    """series/serial; a series that the number starts with already (8 digits and more) is taken off first."""
    number, series = trimmed(number), F.nullif(trimmed(series), F.lit(""))
    inside = series.isNotNull() & (F.length(number) >= 8) & F.startswith(number, series)
    return F.when(series.isNull(), number).otherwise(F.concat(series, F.lit("/"), F.when(inside, F.substr(number, F.length(series) + 1)).otherwise(number)))


def bare_application_number(number: Column, series: Column) -> Column:
    """The trimmed number; the series goes in front if both are digits and the number has under 8."""
    number = trimmed(number)
    return F.when(number.rlike(r"\A[0-9]*\z") & series.rlike(r"\A[0-9]*\z") & (F.length(number) < 8), F.concat(series, number)).otherwise(number)


def compact_application_number(c: Column) -> Column:
    """series/number of digits as one number without zeros in front; others trimmed."""
    t = trimmed(c)
    return F.when(t.rlike(r"\A[0-9]+/[0-9]+\z"), strip_zeros(F.replace(t, F.lit("/"), F.lit("")))).otherwise(t)


def doc_kind(file_name: Column) -> Column:
    base = F.lower(F.element_at(F.split(file_name, "/"), -1))
    grant = base.startswith("ipg") | base.startswith("pg") | base.startswith("pftaps")
    return F.when(grant, "grant").when(base.startswith("ipa") | base.startswith("pa"), "application").otherwise(F.raise_error(F.concat(F.lit("Cannot derive doc_kind from source file '"), file_name, F.lit("'"))))


def is_aps_entry(name: Column) -> Column:
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    return base.startswith("pftaps") & base.endswith(".txt")


def doc_key(raw: Column, ordinal: Column) -> Column:
    """The stem of the root's file attribute, else the first number element, else the ordinal and 1. Tagged text: the number
    of the first line with an identifier."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*\z", "")
    of = lambda tag: F.when(tag.rlike('file="[^"]*"'), stem(F.regexp_extract(tag, 'file="([^"]*)"', 1))).when(tag.rlike("file='[^']*'"), stem(F.regexp_extract(tag, "file='([^']*)'", 1)))
    # by way of a list of one, so that the root's tag is searched for once
    file = F.when(raw.contains("file="), F.get(F.transform(F.array(F.regexp_extract(raw, _ROOT_TAG, 1)), of), F.lit(0)))
    none = lambda c: F.nullif(c, F.lit(""))
    numbers = [F.when(raw.contains(f"<{t}>"), none(trimmed(F.regexp_extract(raw, f"<{t}>([^<]*)<", 1)))) for t in ("doc-number", "publication-number", "patent-number")]
    own = none(F.regexp_extract(raw, r"(?m)^WKU[^\S\r\n]*+([^\r\n]*[^\s])", 1))
    return F.coalesce(F.when(is_aps(raw), wku(own)["number"]).otherwise(F.coalesce(file, *numbers)), (ordinal + 1).cast("string"))


def normal_apn(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), r"\A([0-9]+)[^A-Za-z0-9]\z", "$1")


def wku(c: Column) -> Column:
    """struct(prefix, number, kind) of an identifier: letters, zero-padded digits, and a check character at the end."""
    t = trimmed(c)
    prefix = F.regexp_extract(t, r"\A([A-Za-z]*)", 1)
    body = F.substr(t, F.length(prefix) + 1)
    digits = F.regexp_replace(F.when(F.length(body) > 1, F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body), "[^0-9]", "")
    kind = F.when(prefix == "D", "S").when(prefix == "RE", "E").when(prefix.isin("PP", "P"), None).otherwise("B1")
    return F.struct(prefix.alias("prefix"), F.concat(prefix, strip_zeros(digits)).alias("number"), kind.alias("kind"))


def squeeze(c: Column) -> Column:
    """At most one blank line in turn; no white space around."""
    return trimmed(F.regexp_replace(c, r"\n{3,}+", "\n\n"))
