"""Sinks beside the frame archives: JSON lines, manifests, lists of unsupported records, folders of Markdown files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import templates
from ..operators import project
from ..operators.parse import parse
from .archive_format import SET_SCHEMA, archive_list, register
from .archives import read_archives
from .scratch import kept
from .shards import compressed

#: Between documents that are put into one text.
DOC_SEPARATOR = "\n\n\n\n"
#: The fields of a line of bibliographic JSON, in this order. Fixed values of the format.
JSON_FIELDS = (
    "doc_key", "doc_kind", "source_file", "country_code", "doc_number", "kind_code", "publication_number", "patent_number", "publication_date",
    "application_number", "filing_date", "invention_title", "applicant_names", "assignee_names", "inventor_names", "ipc_classifications", "us_classifications", "priority_date",
)


def json_escapes(line: Column) -> Column:
    """Control characters in JSON text as \\u00xx in lower case only: no \\b and \\f, and none of U+007F to U+009F as they are."""
    pair = F.lit("\x01")  # stands for an escaped backslash meanwhile: no control character is in JSON text as it is
    out = F.replace(line, F.lit("\\\\"), pair)
    upper = [(f"u00{c:02X}", c) for c in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))]
    for sign, c in (("b", 8), ("f", 12), *upper):
        out = F.replace(out, F.lit(f"\\{sign}"), F.lit(f"\\u{c:04x}"))
    for c in range(0x7F, 0xA0):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.replace(out, pair, F.lit("\\\\"))


_LIST_NAMES = {"applicants": "applicant_names", "assignees": "assignee_names", "inventors": "inventor_names"}


def _json_line() -> Column:
    """The line of a row that has all JSON_FIELDS."""
    lists = (*_LIST_NAMES.values(), "ipc_classifications", "us_classifications")
    values = [(F.coalesce(F.col(n), F.array().cast("array<string>")) if n in lists else F.col(n)).alias(n) for n in JSON_FIELDS]
    return json_escapes(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}))


def biblio_json(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys and line: one JSON object per record that parsed, nulls written out. parsed has doc_key, doc_kind, source_file."""
    extra = [c for c in ("doc_key", "doc_kind", "source_file") if c not in keys]
    return project.biblio(parsed, [*keys, *extra]).withColumnsRenamed(_LIST_NAMES).select(*keys, _json_line().alias("line"))


def skip_reason() -> Column:
    """What the list of unsupported records says."""
    kind, said = F.col("error_kind"), F.lit("source detection failed: ")
    return (
        F.when(kind == "UnsupportedRoot", F.concat(said, F.lit("unsupported XML root '"), F.col("error_msg"), F.lit("'")))
        .when(kind == "UnknownFormat", F.concat(said, F.lit("unknown XML format")))
        .when(kind == "ConflictingVersionMarkers", F.concat(said, F.lit("conflicting XML version markers")))
        .otherwise(F.col("error_msg"))
    )


def unsupported(parsed: DataFrame) -> DataFrame:
    """shard, ordinal, line of the records that are skipped as unsupported."""
    skip = C.skip_class(F.col("error_kind"), F.col("error_msg"))
    return parsed.where(skip == "Unsupported").select("shard", "ordinal", F.concat_ws("\t", "doc_key", skip_reason()).alias("line"))


def manifest_json(parsed: DataFrame) -> DataFrame:
    """shard, ordinal, line: the manifest of each shard as indented JSON, without its last line's end."""
    m = project.manifest(parsed, ["shard", "source_file", "doc_kind"])
    quoted = lambda c: F.get(F.regexp_extract_all(F.to_json(F.struct(F.col(c).alias("x"))), F.lit(r'^\{"x":(.*)\}$'), 1), F.lit(0))
    fields = [
        ("format_version", F.lit("1")), ("stem", quoted("shard")), ("source_file", quoted("source_file")), ("doc_kind", quoted("doc_kind")),
        ("patents_written", F.col("written").cast("string")), *((f"{k}_skipped", F.col(k).cast("string")) for k in ("supplemental", "unsupported", "malformed")),
    ]
    body = F.concat_ws(",\n", *[F.concat(F.lit(f'  "{n}": '), c) for n, c in fields])
    return m.select("shard", F.lit(0).alias("ordinal"), F.concat(F.lit("{\n"), body, F.lit("\n}")).alias("line"))


def write_markdown_files(docs: DataFrame, path: str) -> DataFrame:
    """docs (path, markdown) as <stem of path>.md under path; returns the names. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for b in batches:
            names = []
            for source, text in zip(b.column("path").to_pylist(), b.column("markdown").to_pylist()):
                names.append(source.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".md")
                with store.open_output_stream(f"{root}/{names[-1]}") as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return docs.select("path", "markdown").mapInArrow(run, "name string")


def write_concatenated(docs: DataFrame, path: str) -> DataFrame:
    """docs (path, markdown) in the order of paths as part files under path, which make one text if put together in the
    order of their names: four line ends stand between documents, none before the first or after the last. Returns the
    names of the parts. Ranges of paths are written by a task each. The documents are made once, and kept to be sorted."""
    docs = kept(docs.select("path", "markdown"), "concatenated")
    lowest = docs.agg(F.min("path")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name, sink = f"part-{TaskContext.get().partitionId():06d}.md", None
        tmp = f"{root}/.{name}-{uuid.uuid4().hex}"
        for b in batches:
            for source, text in zip(b.column("path").to_pylist(), b.column("markdown").to_pylist()):
                apart = DOC_SEPARATOR if sink is not None or source != lowest else ""
                sink = sink or store.open_output_stream(tmp)
                sink.write(f"{apart}{text or ''}".encode())
        if sink is not None:
            sink.close()
            store.move(tmp, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return docs.select("path", "markdown").orderBy("path").mapInArrow(run, "name string")


def archive_set_rows(raw: DataFrame, limit: int | None = None, template: str = templates.DEFAULT) -> DataFrame:
    """raw (shard, source_file, ordinal, raw, error) as rows of the format patent_archive_set: each record is parsed once, and
    becomes a frame with its line of JSON, or what it is skipped for. Rows without ordinal name their shard.

    Archives are few and large: their records are dealt out to be parsed, rendered and compressed, and only frames are
    brought together again by shard. An archive that couldn't be opened makes the job fail."""
    spread = raw.repartition(4 * raw.sparkSession.sparkContext.defaultParallelism)
    broken = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "source_file", "error"))).otherwise(F.col("ordinal"))
    keyed = spread.select("shard", "source_file", broken.cast("int").alias("ordinal"), "raw", C.doc_kind(F.col("source_file")).alias("doc_kind"))
    keyed = keyed.withColumn("doc_key", C.doc_key(F.col("raw"), F.col("ordinal")))
    kept = ["shard", "source_file", "ordinal", "doc_kind", "doc_key"]
    p = parse(keyed, keep=kept, groups=tuple({"biblio": 0} | dict.fromkeys(project.groups_of(template))))
    ok = F.col("error_kind").isNull()
    text = F.when(ok, templates.render(project.sections(), template)).alias("text")
    p = p.select(*kept, "error_kind", "error_msg", text, *project.biblio_columns()).withColumnsRenamed(_LIST_NAMES)
    skip = F.when(F.col("ordinal").isNotNull() & ~ok, C.skip_class(F.col("error_kind"), F.col("error_msg")))
    p = p.select(*kept, "text", F.when(ok, _json_line()).alias("biblio"), skip.alias("skip"), F.when(skip == "Unsupported", skip_reason()).alias("reason"))
    out = compressed(p, "text", "frame")
    if limit is not None:
        out = project.limited(out, ["shard"], ["ordinal"], F.col("frame").isNotNull(), limit)
    return out.select(*(x.split()[0] for x in SET_SCHEMA.split(", "))).repartition("shard").sortWithinPartitions("shard", "ordinal")


def write_set(rows: DataFrame, out: str, replace: bool = False) -> None:
    """Commits rows of archive_set_rows to out as a whole, or leaves out as it was. replace: what is there goes."""
    register(rows.sparkSession)
    rows.write.format("patent_archive_set").mode("overwrite" if replace else "append").option("path", out).save()


def read_manifests(spark: SparkSession, out: str) -> DataFrame:
    """shard, source_file, doc_kind, written, supplemental, unsupported, malformed of all shards below out."""
    names = "patents_written long, supplemental_skipped long, unsupported_skipped long, malformed_skipped long"
    m = spark.read.schema(f"stem string, source_file string, doc_kind string, {names}").option("multiLine", "true")
    m = m.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.manifest.json").json(out)
    counts = [F.col("patents_written").alias("written"), *[F.col(f"{k}_skipped").alias(k) for k in ("supplemental", "unsupported", "malformed")]]
    return m.select(F.col("stem").alias("shard"), "source_file", "doc_kind", *counts)


def write_archive_set(spark: SparkSession, source: str, out: str, limit: int | None = None, template: str = templates.DEFAULT) -> DataFrame:
    """Reads the archives below source and writes each one's .zst, .idx, .biblio.jsonl, .manifest.json and, if it has any,
    .unsupported.tsv under out, in one pass and one commit: all of them or, if an archive can't be read, none (ValueError).
    Archives without records have their files, too; equal names in different folders stay apart by their folders.
    limit: so many written records per archive at most. Returns the manifest rows, by shard."""
    shards = [s for _, s, _ in archive_list(source)]
    try:
        write_set(archive_set_rows(read_archives(spark, source, limit, headers=True), limit, template), out)
    except PySparkException as e:
        raise ValueError(str(e).split("\n")[0]) from e
    return read_manifests(spark, out).where(F.col("shard").isin(shards)).orderBy("shard")
