"""XML records as trees in columns: each element with its place in document order and that of its last descendant, so that
descendants are a range. All in DataFrame functions; parts that no model knows are found like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_QUOTED = r"""(?:"[^"]*+"|'[^']*+')"""
#: What a document consists of. Possessive or lazy without groups, so that no text is held on the stack.
_TOKEN = rf"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^\[>]*+(?:\[[^\]]*+\][^>]*+)?>|</?[^\s<>/!?\"']++[^<>\"'/]*+(?:(?:{_QUOTED}|/(?!>))[^<>\"'/]*+)*+/?>|[^<]++"
_ATTRIBUTE = rf"""([^\s=<>"'/]++)\s*+=\s*+({_QUOTED})"""


def prolog(raw: Column) -> Column:
    """What stands before the root: xml_version, encoding, standalone, doctype, public_id, system_id, subset; null where it
    is missing."""
    head = F.regexp_extract(raw, r"(?s)\A\s*+<\?xml\s(.*?)\?>", 1)
    doc = F.regexp_extract(raw, r"(?s)\A(?:\s|<\?.*?\?>|<!--.*?-->){0,64}+(<!DOCTYPE[^\[>]*+(?:\[[^\]]*+\][^>]*+)?>)", 1)
    some = lambda c: F.nullif(c, F.lit(""))
    declared = lambda n: some(F.regexp_extract(head, rf"""(?:^|\s){n}\s*=\s*["']([^"']*)["']""", 1))
    public, system = r"""PUBLIC\s+["']([^"']*)["']""", r"""(?:SYSTEM|PUBLIC\s+(?:"[^"]*"|'[^']*'))\s+["']([^"']*)["']"""
    subset = F.when(doc.contains("["), F.regexp_extract(doc, r"(?s)\[(.*)\][^\]]*>\z", 1))
    return F.struct(
        declared("version").alias("xml_version"), declared("encoding").alias("encoding"), declared("standalone").alias("standalone"), some(F.regexp_extract(doc, r"<!DOCTYPE\s+([^\s>\[]+)", 1)).alias("doctype"),
        some(F.regexp_extract(doc, public, 1)).alias("public_id"), some(F.regexp_extract(doc, system, 1)).alias("system_id"), subset.alias("subset"),
    )


def elements(df: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys, pre, last, depth, name, attributes, own_text: one row for each element of well-formed records. Null: none.

    pre counts elements in document order from 1; the descendants of an element are those with pre above its own up to its
    last. depth of a root: 1. attributes: array of (name, value) in order, entities as written. own_text: the texts
    directly in the element, put together, with CDATA, entities as written. Records whose tags don't match up give rows
    that mean nothing; take those that parse.

    Tags are dealt out by record once, and numbered by running counts; a task holds the tags of one record at a time."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("none"))
    numbered = df.select(key.alias("key"), F.monotonically_increasing_id().alias("record"), F.regexp_extract_all(raw, F.lit(_TOKEN), F.lit(0)).alias("tokens"))
    t = numbered.select("key", "record", F.posexplode("tokens").alias("n", "token"))
    token = F.col("token")
    kind = F.when(token.startswith("</"), "close").when(token.startswith("<![CDATA["), "cdata").when(token.startswith("<!") | token.startswith("<?"), "other").when(~token.startswith("<"), "text").when(token.endswith("/>"), "empty").otherwise("open")
    t = t.withColumn("kind", kind).where("kind <> 'other'")
    so_far = Window.partitionBy("record").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("kind").isin("open", "empty"), F.col("kind").isin("close", "empty")
    t = t.withColumn("pre", F.sum(opens.cast("int")).over(so_far)).withColumn("ended", F.sum(closes.cast("int")).over(so_far))
    inside = F.col("pre") - F.col("ended")
    # the level of a tag is that of its element, the level of a text that of the element it is in
    t = t.withColumn("depth", F.when(F.col("kind").isin("close", "empty"), inside + 1).otherwise(inside))
    level = Window.partitionBy("record", "depth").orderBy("n")
    t = t.withColumn("turn", F.sum(opens.cast("int")).over(level.rowsBetween(Window.unboundedPreceding, 0)))
    # an element with its end and its own texts: what has its level and its turn
    text = F.when(F.col("kind") == "text", token).when(F.col("kind") == "cdata", F.substr(token, F.lit(10), F.length(token) - 12))
    tag = F.max(F.when(opens, token))
    pieces = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("n", text.alias("text")))))
    g = t.where("depth > 0").groupBy("record", "depth", "turn").agg(F.first("key").alias("key"), tag.alias("tag"), F.min(F.when(opens, F.col("pre"))).alias("pre"), F.max("pre").alias("last"), pieces.alias("pieces"))
    values = F.transform(F.regexp_extract_all("tag", F.lit(_ATTRIBUTE), F.lit(2)), lambda v: F.substr(v, F.lit(2), F.length(v) - 2))
    pairs = F.zip_with(F.regexp_extract_all("tag", F.lit(_ATTRIBUTE), F.lit(1)), values, lambda a, b: F.struct(a.alias("name"), b.alias("value")))
    name = F.regexp_extract("tag", r"^<([^\s/>]+)", 1)
    own = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return g.where("tag IS NOT NULL").select(*[F.col(f"key.{k}").alias(k) for k in keys], "pre", "last", "depth", name.alias("name"), pairs.alias("attributes"), own.alias("own_text"))


def below(found: DataFrame, keys: list[str], name: str, child: bool = False) -> DataFrame:
    """Of elements(): those below an element of that name (child: directly below), with its place as `above`; below
    several of them, one row each. A join by record with a range of places. Keys name a record."""
    a = found.where(F.col("name") == name).select(*keys, F.col("pre").alias("above"), F.col("last").alias("_last"), F.col("depth").alias("_depth"))
    inside = (F.col("pre") > F.col("above")) & (F.col("pre") <= F.col("_last"))
    both = found.join(a, keys).where(inside & (F.col("depth") == F.col("_depth") + 1) if child else inside)
    return both.drop("_last", "_depth")


def path(found: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """Of elements(): those at a path of names from the root down."""
    at = found.where((F.col("name") == names[0]) & (F.col("depth") == 1)).select(*keys, "pre", "last", "depth")
    for n in names[1:]:
        up = at.select(*keys, F.col("pre").alias("_pre"), F.col("last").alias("_last"), F.col("depth").alias("_depth"))
        at = found.where(F.col("name") == n).join(up, keys).where("pre > _pre AND pre <= _last AND depth = _depth + 1").select(*keys, "pre", "last", "depth")
    return found.join(at.select(*keys, "pre"), [*keys, "pre"], "left_semi")
