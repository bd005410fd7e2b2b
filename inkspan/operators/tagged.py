"""Tagged-text records as fields, inventors and claims: lines, windows over them and groups, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.records import _APS_SECTIONS, _VERBATIM


def _cut_inside(data: Column, at: int) -> Column:
    """Whether a cut after so many bytes would split a character."""
    return F.hex(F.substring(data, at + 1, 1)).rlike("^[89AB]")


def lines(df: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """key (struct of keys), record (a number), n, line, blank, tag, value: one row for each line of a record from its first
    one that is neither blank nor PATN nor a header. Tags are columns 1 to 4, values from column 6; columns are bytes, and a
    tag field that ends inside a character makes the whole line the tag."""
    trim = F.lit(C.SPACE)
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("none"))
    numbered = df.select(key.alias("key"), F.monotonically_increasing_id().alias("record"), F.split(raw, "\r?\n").alias("lines"))
    d = numbered.select("key", "record", F.posexplode("lines").alias("n", "line"))
    data, short = F.col("line").cast("binary"), F.octet_length("line")
    bare = C.trimmed(F.col("line"))
    tag = F.when((short < 4) | _cut_inside(data, 4), F.col("line")).otherwise(F.substring(data, 1, 4).cast("string"))
    value = F.when((short < 5) | _cut_inside(data, 5), "").otherwise(F.substring(data, 6, (1 << 31) - 1).cast("string"))
    d = d.select("key", "record", "n", "line", (bare == "").alias("blank"), ((bare == "") | (bare == "PATN") | bare.startswith("HHHHH")).alias("head"), F.rtrim(tag, trim).alias("tag"), F.rtrim(value, trim).alias("value"))
    so_far = Window.partitionBy("record").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("started", F.max(~F.col("head")).over(so_far)).where("started").drop("head", "started")


def fields(df: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys, pos, section, tag, value: one row for each tagged field of a record, continuation lines folded in. Null: none.

    Lines of a record are dealt out by it once; the section in force is carried over them (the last one seen), fields are
    numbered by a running count, and each gathers its lines: those that begin with a blank go on with the value before, after
    one space, or as they are where the field keeps its layout. A task holds the lines of one record at a time."""
    d = lines(df, keys, raw)
    goes_on = ~F.col("blank") & (F.col("line").startswith(" ") | (F.col("tag") == ""))
    d = d.withColumn("kind", F.when(F.col("blank"), "blank").when(goes_on, "more").when(F.col("tag").isin(*sorted(_APS_SECTIONS)), "section").otherwise("field"))
    so_far = Window.partitionBy("record").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce(F.last(F.when(F.col("kind") == "section", F.col("tag")), ignorenulls=True).over(so_far), F.lit("PATN"))
    d = d.withColumn("section", section).withColumn("field", F.sum((F.col("kind") == "field").cast("int")).over(so_far))
    d = d.where("field > 0 AND kind <> 'section'")
    own = lambda c: F.first(F.when(F.col("kind") == "field", F.col(c)), ignorenulls=True)
    parts = F.array_sort(F.collect_list(F.struct("n", "blank", "value")))
    g = d.groupBy("record", "field").agg(F.first("key").alias("key"), own("section").alias("section"), own("tag").alias("tag"), own("value").alias("first"), parts.alias("parts"))
    rest = F.slice("parts", 2, F.size("parts"))
    kept = F.concat("first", F.array_join(F.transform(rest, lambda p: F.concat(F.lit("\n"), F.when(p["blank"], "").otherwise(p["value"]))), ""))
    folded = F.transform(F.filter(rest, lambda p: ~p["blank"]), lambda p: F.ltrim(p["value"], F.lit(C.SPACE)))
    joined = F.array_join(F.concat(F.array("first"), folded), " ")
    # what goes on with nothing begins the value
    folded = F.when(F.col("first") == "", F.ltrim(joined, F.lit(" "))).otherwise(joined)
    value = F.when(F.col("tag").isin(*sorted(_VERBATIM)), kept).otherwise(folded)
    names = [F.col(f"key.{k}").alias(k) for k in keys]
    return g.select(*names, (F.col("field") - 1).cast("int").alias("pos"), "section", "tag", value.alias("value"))


def _opened(found: DataFrame, keys: list[str], opens: Column, out: str) -> DataFrame:
    """found with out: how many fields have opened a group so far."""
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn(out, F.sum(opens.cast("int")).over(so_far))


def inventors(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of fields(): keys, pos (from 0), last_name, first_name, city, state, country, first_named. Each NAM of a section INVT
    opens an inventor; of repeated places the last counts. Keys name a record."""
    own = _opened(found.where("section = 'INVT'"), keys, F.col("tag") == "NAM", "inventor").where("inventor > 0")
    name = F.max(F.when(F.col("tag") == "NAM", F.col("value")))
    at = lambda tag: F.max_by("value", F.when(F.col("tag") == tag, F.col("pos")))
    g = own.groupBy(*keys, "inventor").agg(name.alias("name"), at("CTY").alias("city"), at("STA").alias("state"), at("CNT").alias("country"))
    cut = F.instr("name", ";")
    some = lambda c: F.nullif(C.trimmed(c), F.lit(""))
    last = some(F.when(cut > 0, F.substr("name", F.lit(1), cut - 1)).otherwise(F.col("name")))
    first = some(F.when(cut > 0, F.substr("name", cut + 1)))
    return g.select(*keys, (F.col("inventor") - 1).cast("int").alias("pos"), last.alias("last_name"), first.alias("first_name"), "city", "state", "country", (F.col("inventor") == 1).alias("first_named"))


def claims(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of fields(): keys, number (from 1), text. In CLMS, NUM opens a claim, whose further fields are its text; statements
    (STM) are left out; all of DCLM is one claim behind them. Claims without text are neither kept nor numbered."""
    own = found.where("(section = 'CLMS' AND tag <> 'STM') OR section = 'DCLM'")
    own = _opened(own, keys, (F.col("section") == "CLMS") & (F.col("tag") == "NUM"), "claim")
    own = own.withColumn("claim", F.when(F.col("section") == "DCLM", (1 << 31) - 1).otherwise(F.col("claim")))
    parts = F.array_sort(F.collect_list(F.when((F.col("tag") != "NUM") | (F.col("section") == "DCLM"), F.struct("pos", "value"))))
    text = C.trimmed(C.decode_entities(F.array_join(F.transform("parts", lambda p: p["value"]), "")))
    g = own.groupBy(*keys, "claim").agg(parts.alias("parts")).withColumn("text", text).where("text <> ''")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("claim"))
    return g.select(*keys, number.alias("number"), "text")
