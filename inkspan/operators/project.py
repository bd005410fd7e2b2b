"""Projections of parsed rows: bibliographic rows, claims, priority edges, sections and Markdown, skip counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import templates
from .parse import free_name


def _numbers() -> dict[str, Column]:
    whole = C.compact_number(F.col("country"), F.col("doc_number"), F.col("kind_code"))
    grant = C.is_grant(F.col("kind_code"))
    return {"publication_number": F.when(~grant, whole), "patent_number": F.when(grant, whole), "application_number": C.bare_application_number(F.col("application_number"), F.col("series"))}


def priority_date() -> Column:
    return F.array_min(F.filter(F.transform("priority", lambda e: F.nullif(e["parent_date"], F.lit(""))), lambda d: d.isNotNull()))


def biblio_columns() -> list[Column]:
    """The flat analytic row of a parsed record."""
    return [
        F.col("source_format"), F.col("country").alias("country_code"), F.col("doc_number"), F.col("kind_code"), *[c.alias(n) for n, c in _numbers().items()],
        F.col("publication_date"), F.col("filing_date"), F.col("title").alias("invention_title"), F.col("applicants"), F.col("assignees"), F.col("inventors"),
        F.col("ipc").alias("ipc_classifications"), F.col("us").alias("us_classifications"), priority_date().alias("priority_date"),
    ]


def biblio(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """The flat analytic row of each parsed record."""
    return parsed.where("error_kind IS NULL").select(*keys, *biblio_columns())


def claims(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per claim, numbered from 1; blank claims are neither kept nor numbered."""
    return parsed.where("error_kind IS NULL").select(*keys, F.posexplode("claims")).select(*keys, (F.col("pos") + 1).alias("number"), F.col("col").alias("text"))


def parties(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per applicant, assignee and inventor: role, pos from 0, name, and whether an inventor is the first named."""
    ok = parsed.where("error_kind IS NULL")
    roles = F.map_from_arrays(F.array(*map(F.lit, ("applicant", "assignee", "inventor"))), F.array("applicants", "assignees", "inventors"))
    each = ok.select(*keys, "first_inventor", F.explode(roles).alias("role", "names")).select(*keys, "first_inventor", "role", F.posexplode("names").alias("pos", "name"))
    return each.select(*keys, "role", "pos", "name", F.coalesce((F.col("role") == "inventor") & (F.col("name") == F.col("first_inventor")), F.lit(False)).alias("first_named"))


def priority_edges(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.where("error_kind IS NULL").select(*keys, F.posexplode("priority")).select(*keys, "pos", F.coalesce("col.relationship", F.lit("unknown")).alias("relationship"), F.col("col.parent").alias("parent_doc_number"), F.col("col.parent_date").alias("parent_date"), F.col("col.child").alias("child_doc_number"))


def _yaml(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("null")))


def _yaml_list(name: str, value: Column) -> Column:
    items = F.array_join(F.transform(value, lambda x: F.concat(F.lit("  - "), x)), "\n")
    return F.concat(F.lit(f"{name}:"), F.when(F.size(value) > 0, F.concat(F.lit("\n"), items)).otherwise(F.lit(" []")))


def sections() -> dict[str, Column]:
    """The five sections of a parsed row. Body sections come rendered from the parser, as their content is recursive."""
    n = _numbers()
    number = C.compact_application_number
    pairs = lambda e: (("relationship", F.coalesce(e["relationship"], F.lit("unknown"))), ("parent_doc_number", number(e["parent"])), ("parent_date", e["parent_date"]), ("child_doc_number", number(e["child"])))
    chain = F.transform("priority", lambda e: F.concat_ws("\n    ", *[_yaml(k, v) for k, v in pairs(e)]))
    front = F.concat_ws(
        "\n", F.lit("---"), _yaml("filing_date", F.col("filing_date")), _yaml("application_number", C.application_label(F.col("application_number"), F.col("series"))),
        _yaml("publication_number", n["publication_number"]), _yaml("publication_date", F.col("publication_date")), _yaml("patent_number", n["patent_number"]), _yaml("priority_date", priority_date()),
        _yaml_list("ipc_classifications", F.col("ipc")), _yaml_list("us_classifications", F.col("us")), _yaml_list("priority_chain", chain), _yaml_list("applicants", F.col("applicants")), _yaml_list("assignees", F.col("assignees")), F.lit("---"),
    )
    return {"frontmatter": front, "title": F.concat(F.lit("# "), F.col("title")), "abstract": F.col("md_abstract"), "description": F.col("md_description"), "claims": F.col("md_claims")}


def groups_of(template: str) -> tuple[str, ...]:
    """What a template needs of the parser."""
    used = {name for kind, name in templates.parse(template) if kind == "section"}
    return tuple(g for g in ("biblio", "abstract", "description", "claims") if g in used or (g == "biblio" and used & {"frontmatter", "title"}))


def markdown(parsed: DataFrame, keys: list[str], template: str = templates.DEFAULT) -> DataFrame:
    """Each record that parsed in Markdown; parsed holds the groups of groups_of(template) at least."""
    return parsed.where("error_kind IS NULL").select(*keys, templates.render(sections(), template).alias("markdown"))


def manifest(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Written and skipped records of each shard."""
    skip = C.skip_class(F.col("error_kind"), F.col("error_msg"))
    return parsed.groupBy(*by).agg(F.count_if(F.col("error_kind").isNull()).alias("written"), *[F.count_if(skip == k).alias(k.lower()) for k in ("Supplemental", "Unsupported", "Malformed")])


def limited(df: DataFrame, by: list[str], order: list[str], ok: Column, limit: int) -> DataFrame:
    """Rows of each group up to the one that makes `limit` successes."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = free_name(df, "_n")
    return df.withColumn(n, F.coalesce(F.sum(ok.cast("int")).over(w), F.lit(0))).where(F.col(n) < limit).drop(n)
