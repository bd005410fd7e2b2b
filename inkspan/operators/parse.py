"""Raw records to parsed rows: format detection as columns, parsing in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.columns import is_aps, resolved_format, root_name, version_families, version_formats
from ..functions.formats import FORMATS
from ..functions.records import _ERRORS, GROUPS, parse_record
from ..sources.scratch import lean, slices

def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def detect(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with source_format, error_kind, error_msg; columns of these names give way. Null and blank: Malformed. Formats that
    were added are asked first, in the order in which they were."""
    kept = [c for c in df.columns if c not in ("source_format", "error_kind", "error_msg")]
    root, aps, found, families, done = (free_name(df, f"_{x}") for x in ("root", "aps", "found", "families", "done"))
    # one select a step: in one expression, the markers would be searched anew for each use of what they give
    d = df.select(*kept, root_name(F.col(raw)).alias(root), is_aps(F.col(raw)).alias(aps))
    d = d.select("*", version_formats(F.col(raw), F.col(root)).alias(found))
    d = d.select("*", version_families(F.col(raw), F.col(found)).alias(families))
    d = d.withColumn(done, resolved_format(F.col(raw), F.col(root), F.col(aps), F.col(found), F.col(families)))
    own = [F.when(m, F.lit(n)) for n, a in FORMATS.items() if (m := a.matches(F.col(raw))) is not None]
    added = F.coalesce(*own, F.lit(None).cast("string")) if own else F.lit(None).cast("string")
    d = d.withColumn(aps, added)
    unless = lambda c: F.when(F.col(aps).isNull(), F.col(f"{done}.{c}")) if own else F.col(f"{done}.{c}")
    return d.select(*kept, F.coalesce(aps, f"{done}.format").alias("source_format"), unless("error_kind").alias("error_kind"), unless("error_msg").alias("error_msg"))


def parse(df: DataFrame, raw: str = "raw", keep: list[str] | None = None, groups: tuple[str, ...] = tuple(GROUPS)) -> DataFrame:
    """Parsed rows beside the columns in `keep` (all but raw by default): the columns of the wanted groups and the error.

    groups: biblio, abstract, description, claims, drawings; a parser builds no column that isn't asked for. Map-only;
    failures are rows with error_kind. Kept columns that a parsed one would clash with give way.
    """
    record = StructType.fromDDL(", ".join([*(GROUPS[g] for g in groups), _ERRORS]))
    keep = [c for c in (df.columns if keep is None else keep) if c != raw and c not in record.names and c != "source_format"]
    d = detect(df, raw).select(*keep, "source_format", F.col(raw), "error_kind", "error_msg")
    out = StructType([*d.select(*keep, "source_format").schema.fields, *record.fields])
    arrow, readers = to_arrow_schema(record), {n: a.parse_row for n, a in FORMATS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, raw):
            rows = [parse_record(*x, groups, readers.get(x[1])) for x in zip(*(b.column(c).to_pylist() for c in (raw, "source_format", "error_kind", "error_msg")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*keep, "source_format"]), *(pa.array([r[f.name] for r in rows], f.type) for f in arrow)], out.names)

    return d.mapInArrow(lean(run), out)


def write_back(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with each record written back as XML from its model; those that can't be parsed, or whose format can't be written
    (tagged text), are left out. Map-only, in one pass of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .. import api

        for b in slices(batches, raw):
            found = []
            for x in b.column(raw).to_pylist():
                try:
                    found.append(None if x is None else api.parse(x).to_xml())
                except ValueError:
                    found.append(None)
            xml = pa.array(found, pa.string())
            yield pa.RecordBatch.from_arrays([xml if c == raw else b.column(c) for c in b.schema.names], b.schema.names).filter(xml.is_valid())

    return df.mapInArrow(lean(run), df.schema)
