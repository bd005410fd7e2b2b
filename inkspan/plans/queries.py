"""Queries over records that are made from the driver's tables; oracle.py computes the same from the tables in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins, project, tagged, trees
from ..operators.parse import detect, parse, write_back
from ..sources import archives, keys, shards, sinks
from ..sources.scratch import kept, scratch
from .corpus import corpus
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

_LISTS = ("applicant_names", "assignee_names", "inventor_names", "ipc_classifications", "us_classifications")
_SCALARS = ("doc_number", "kind_code", "publication_number", "patent_number", "publication_date", "application_number", "filing_date", "invention_title")


def _parsed(spark: SparkSession, sf_dir: str, *groups: str) -> DataFrame:
    return parse(corpus(spark, sf_dir), groups=groups)


def _rendered(spark: SparkSession, sf_dir: str, template: str, name: str = "markdown") -> DataFrame:
    return project.markdown(_parsed(spark, sf_dir, *project.groups_of(template)), ["doc_id"], template).withColumnRenamed("markdown", name)


def _keyed(spark: SparkSession, sf_dir: str, *groups: str, key: bool = True) -> DataFrame:
    """Parsed records with what the sinks need: ordinal, doc_key (if it is asked for: it is searched for in the whole record),
    source_file, doc_kind."""
    source = F.concat("shard", F.lit(".zip"))
    d = corpus(spark, sf_dir).select("shard", "raw", F.col("doc_id").alias("ordinal"), source.alias("source_file"), C.doc_kind(source).alias("doc_kind"))
    return parse(d.withColumn("doc_key", C.doc_key(F.col("raw"), F.col("ordinal"))) if key else d, groups=groups)


def _joined(names) -> list:
    return [F.array_join(n, "|").alias(n) for n in names]


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(corpus(spark, sf_dir)).select("doc_id", "source_format", "error_kind")


def page_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html").groupBy("error_kind", "error_msg").agg(F.count("*").alias("pages"))


def biblio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.biblio(_parsed(spark, sf_dir, "biblio"), ["doc_id"]).select("doc_id", "source_format", "country_code", *_SCALARS)


def party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.parties(_parsed(spark, sf_dir, "biblio"), ["doc_id"])


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = project.biblio(_parsed(spark, sf_dir, "biblio"), ["doc_id"])
    return b.select("doc_id", F.array_join("ipc_classifications", "|").alias("ipc"), F.array_join("us_classifications", "|").alias("us"))


def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.priority_edges(_parsed(spark, sf_dir, "biblio"), ["doc_id"])


def priority_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.biblio(_parsed(spark, sf_dir, "biblio"), ["doc_id"]).select("doc_id", "priority_date")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.claims(_parsed(spark, sf_dir, "claims"), ["doc_id"])


def claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = _parsed(spark, sf_dir, "claims").where("error_kind IS NULL").withColumn("n", F.size("claims").cast("long"))
    return ok.groupBy("source_format").agg(F.sum("n").alias("claims"), F.max("n").alias("most"))


def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "abstract").where("error_kind IS NULL").select("doc_id", F.col("abstract").alias("abstract_text"))


def abstract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "{{abstract}}", "abstract")


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "{{description}}", "description")


def description_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _parsed(spark, sf_dir, "description").where("error_kind IS NULL").select("source_format", F.explode("description").alias("x"))
    return d.groupBy("source_format", F.col("x.bucket").alias("bucket"), F.col("x.kind").alias("kind")).agg(F.count("*").alias("items"))


def claim_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "{{claims}}", "claims")


def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "{{frontmatter}}", "frontmatter")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "{{ title }}\n\n{{abstract}}")


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default template."""
    groups = project.groups_of(project.templates.DEFAULT)
    return project.markdown(_parsed(spark, sf_dir, *groups), ["doc_id"])


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "drawings").where("error_kind IS NULL").select("doc_id", F.explode("drawings").alias("x")).select("doc_id", "x.*")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.manifest(_parsed(spark, sf_dir), ["shard"])


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _parsed(spark, sf_dir).select("shard", "doc_id", "error_kind")
    return project.limited(d, ["shard"], ["doc_id"], F.col("error_kind").isNull(), 5).select("shard", "doc_id")


def doc_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", C.doc_key(F.col("raw"), F.col("doc_id")).alias("doc_key"))


def unsupported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.unsupported(_keyed(spark, sf_dir))


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest_json(_keyed(spark, sf_dir, key=False)).select("shard", "line")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the JSON lines, read back from them."""
    lines = sinks.biblio_json(_keyed(spark, sf_dir, "biblio"), ["shard", "ordinal"])
    j = lines.select("shard", "ordinal", F.from_json("line", ", ".join(f"{n} {'array<string>' if n in _LISTS else 'string'}" for n in sinks.JSON_FIELDS)).alias("j")).select("shard", "ordinal", "j.*")
    return j.select("shard", "ordinal", *[c for c in j.columns if c not in ("shard", "ordinal", *_LISTS)], *_joined(_LISTS))


def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", sinks.json_escapes(F.to_json(F.struct(F.concat(F.lit("\b\f\x1f\x7f\x85\\b\\"), F.coalesce("text", F.lit(""))).alias("x")))).alias("line"))


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written back as XML and parsed again: they say what they said."""
    again = write_back(corpus(spark, sf_dir).select("doc_id", "raw"))
    p = parse(again, groups=("biblio", "abstract", "description", "claims"))
    b = project.biblio(p, ["doc_id", "abstract", "claims", "md_description"]).withColumnsRenamed({"applicants": "applicant_names", "assignees": "assignee_names", "inventors": "inventor_names"})
    return b.select("doc_id", "source_format", *_SCALARS, *_joined(_LISTS), "priority_date", F.col("abstract").alias("abstract_text"), F.size("claims").cast("long").alias("claims"), F.col("md_description").alias("description"))


def _files(spark: SparkSession, sf_dir: str, aps: bool) -> DataFrame:
    """Sixty records to a file, one after another: file, text."""
    c = corpus(spark, sf_dir)
    has = C.is_aps(F.col("raw")) if aps else F.col("raw").startswith("<?xml")
    parts = F.sort_array(F.collect_list(F.struct("doc_id", "raw")))  # ten to fifty records
    return c.where(has).groupBy(F.concat(F.lit("pftaps" if aps else "ipg"), F.floor(F.col("doc_id") / 60).cast("string")).alias("file")).agg(F.concat(F.lit("junk\n"), F.array_join(F.transform(parts, lambda x: x["raw"]), "\n")).alias("text"))


def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = archives.split(_files(spark, sf_dir, False), F.lit(False))
    return r.select("file", "ordinal", F.nullif(C.doc_key(F.col("raw"), F.lit(-2)), F.lit("-1")).alias("doc_key"))


def split_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = archives.split(_files(spark, sf_dir, True), C.is_aps_entry(F.concat("file", F.lit(".txt"))))
    return r.select("file", "ordinal", C.doc_key(F.col("raw"), F.col("ordinal")).alias("doc_key"))


def tagged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).groupBy("doc_id", "section", "tag").agg(F.count("*").alias("n"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return tagged.fields(c.where(C.is_aps(F.col("raw"))), ["doc_id"])


def tagged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded values: fields that go on over lines, as they are and where layout is kept."""
    return _tagged(spark, sf_dir).where("tag IN ('PAR', 'PAL', 'TBL', 'ICL')").groupBy("doc_id", "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), "|").alias("joined"))


def tagged_inventors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged.inventors(_tagged(spark, sf_dir), ["doc_id"])


def tagged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged.claims(_tagged(spark, sf_dir), ["doc_id"])


def _elements(spark: SparkSession, sf_dir: str, own: bool = False) -> DataFrame:
    """The elements of the families of XML that parse, made once, as each step of a path reads them. own: with their texts."""
    found = trees.elements(corpus(spark, sf_dir).where("doc_id % 6 < 4"), ["doc_id"])
    return kept(found if own else found.select("doc_id", "pre", "last", "depth", "name"), "elements")


def elements_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each name are below the claims, of all forms of claims."""
    found = _elements(spark, sf_dir)
    both = [trees.below(found, ["doc_id"], n) for n in ("claims", "subdoc-claims", "CL")]
    return both[0].unionByName(both[1]).unionByName(both[2]).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


def element_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by their paths, entities as written, and attributes of the root."""
    found = _elements(spark, sf_dir, True)
    title = [
        ("us-patent-grant", "us-bibliographic-data-grant", "invention-title"), ("us-patent-application", "us-bibliographic-data-application", "invention-title"),
        ("PATDOC", "SDOBI", "B500", "B540", "STEXT", "PDAT"), ("patent-application-publication", "subdoc-bibliographic-information", "technical-information", "title-of-invention"),
    ]
    at = [trees.path(found, ["doc_id"], *p).select("doc_id", F.col("own_text").alias("title")) for p in title]
    root = found.where("depth = 1").select("doc_id", F.col("name").alias("root"), F.array_join(F.transform("attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"])), " ").alias("attributes"))
    return root.join(at[0].unionByName(at[1]).unionByName(at[2]).unionByName(at[3]), "doc_id")


def prologs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).select("doc_id", trees.prolog(F.col("raw")).alias("p"))
    return c.select("doc_id", "p.*")


def _written(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    path = scratch(spark, "archives")
    p = _keyed(spark, sf_dir, *project.groups_of(project.templates.DEFAULT))
    docs = project.markdown(p, ["shard", "ordinal", "doc_key"]).withColumnRenamed("markdown", "text")
    shards.write_shards(docs, path).count()
    return path, shards.read_index(spark, path)


def shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to archives, and read from them through the index."""
    path, index = _written(spark, sf_dir)
    return shards.read_documents(index, path).select("doc_key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def shard_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards whose frames are written by several tasks each, held against those written by one."""
    docs = _keyed(spark, sf_dir, *project.groups_of("{{title}}\n\n{{abstract}}"))
    docs = kept(project.markdown(docs, ["shard", "ordinal", "doc_key"], "{{title}}\n\n{{abstract}}").withColumnRenamed("markdown", "text"), "texts")
    one, many = scratch(spark, "one-task"), scratch(spark, "many-tasks")
    shards.write_shards(docs, one).count()
    done = shards.write_shards_in_parts(docs, many, 32)
    name = F.regexp_extract("path", r"([^/]*)\.(?:zst|idx)$", 1)
    read = lambda p: spark.read.format("binaryFile").option("pathGlobFilter", "*.{zst,idx}").load(p).select(name.alias("shard"), F.sha2("content", 256).alias("digest"))
    same = read(one).join(read(many), ["shard", "digest"]).groupBy("shard").agg(F.count("*").alias("same_files"))
    return done.join(same, "shard", "left").select("shard", "documents", "same_files")


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliographic rows joined with the index of written archives; offsets as the number of documents before."""
    _, index = _written(spark, sf_dir)
    rows = project.biblio(_keyed(spark, sf_dir, "biblio"), ["shard", "doc_key"]).select("shard", "doc_key", "patent_number")
    before = F.row_number().over(project.Window.partitionBy("shard").orderBy("offset")) - 1
    return joins.with_pointers(rows, index).select("shard", "doc_key", "patent_number", before.cast("long").alias("documents_before"))


def bucketed_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join, of tables that are written in buckets of its keys."""
    _, index = _written(spark, sf_dir)
    rows = project.biblio(_keyed(spark, sf_dir, "biblio"), ["shard", "doc_key"]).select("shard", "doc_key", "patent_number")
    put = lambda df, name: joins.write_bucketed(df, f"{name}_{uuid.uuid4().hex}", scratch(spark, name), buckets=16)
    both = joins.with_pointers(put(rows, "biblio_rows"), put(index, "index_rows"))
    return both.select("shard", "doc_key", "patent_number", (F.col("length") > 0).alias("has_frame"))


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the keys that customers' numbers make, through the sorted index."""
    path, _ = _written(spark, sf_dir)
    keys.write_key_index(spark, path)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    wanted = customers.select(F.concat(F.lit("US"), F.lpad((F.col("c_custkey") + 1000000).cast("string"), 8, "0"), F.lit("-X")).alias("doc_key"))
    return keys.documents_of(spark, path, wanted).select("doc_key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _zipped(spark: SparkSession, sf_dir: str) -> str:
    """The corpus as ZIP archives, with equal names in two folders; some of the records that are skipped are an archive of
    their own, and each region makes an archive without any record."""
    path, id_ = scratch(spark, "zips"), F.col("doc_id")
    apart, tagged_text = (id_ % 6 == 5) & (F.floor(id_ / 6) % 5 < 4) & (F.floor(id_ / 30) % 2 == 0), id_ % 6 == 4
    name = F.when(apart, "ipgskipped.zip").otherwise(F.concat(F.when(tagged_text, "pftaps").otherwise("ipg"), (id_ % 4).cast("string"), F.lit(".zip")))
    folder = F.when(apart, "odd").otherwise(F.concat(F.lit("week"), (F.floor(id_ / 4) % 2).cast("string")))
    # in an archive, a record of XML begins with a declaration
    bare = ~tagged_text & ~F.col("raw").startswith("<?xml")
    raw = F.concat(F.when(bare, '<?xml version="1.0"?>').otherwise(""), "raw", F.lit("\n"))
    entry = F.when(tagged_text, "pftaps.txt").otherwise("all.xml")
    records = corpus(spark, sf_dir).select(folder.alias("folder"), name.alias("name"), entry.alias("entry"), id_.alias("ordinal"), raw.alias("raw"))
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    key = F.concat(F.lit("ipa"), F.col("r_regionkey").cast("string"), F.lit(".zip"))
    empty = region.select(F.lit("odd").alias("folder"), key.alias("name"), F.lit("none.xml").alias("entry"), F.lit(0).cast("long").alias("ordinal"), F.col("r_name").alias("raw"))
    archives.write_archives(records.withColumn("ordinal", F.col("ordinal").cast("long")).unionByName(empty), path).count()
    return path


def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of archives by the data source."""
    r = archives.read_archives(spark, _zipped(spark, sf_dir))
    return r.select("shard", "source_file", "ordinal", F.nullif(C.doc_key(F.col("raw"), F.lit(-2)), F.lit("-1")).alias("doc_key"))


def archive_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written as a set of shards: their manifests, and how much their indexes and lists of unsupported records hold."""
    out = scratch(spark, "archive-set")
    m = sinks.write_archive_set(spark, _zipped(spark, sf_dir), out)
    index = shards.read_index(spark, out).groupBy("shard").agg(F.count("*").alias("frames"))
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.unsupported.tsv").text(out)
    place = F.regexp_extract("_metadata.file_path", r"archive-set-[0-9a-f]+/(.*)\.unsupported\.tsv$", 1)
    listed = lines.groupBy(place.alias("shard")).agg((F.count("*") - 1).alias("listed"))  # less the header
    some = [F.coalesce(c, F.lit(0)).alias(c) for c in ("frames", "listed")]
    return m.join(index, "shard", "left").join(listed, "shard", "left").select(*m.columns, *some)


def by_application_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project.biblio(_parsed(spark, sf_dir, "biblio"), ["doc_id"]).select("doc_id", "application_number")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") + 1000000).alias("number"), F.date_format("o_orderdate", "yyyyMMdd").alias("other_filed"))
    return joins.by_application(rows, o, "number").select("doc_id", "application_number", "other_filed")


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    prefix = F.element_at(F.array(*map(F.lit, ("", "D", "RE", "PP", "H"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    w = C.wku(F.concat(F.lit(" "), prefix, F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.when(F.col("l_linenumber") % 2 == 0, "&").otherwise("7")))
    serial = C.normal_apn(F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "&").otherwise("7")))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", w["number"].alias("number"), w["kind"].alias("kind"), serial.alias("serial"))


def labels_of_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    s = F.element_at(F.array(*map(F.lit, (" ", "14", "1", "08"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    n = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("14"), F.lpad(key, 6, "0"))).otherwise(key)
    o = o.select("o_orderkey", "o_custkey", s.alias("s"), n.alias("n"))
    compact = C.compact_application_number(F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")))
    return o.select("o_orderkey", C.application_label(F.col("n"), F.col("s")).alias("label"), C.bare_application_number(F.col("n"), C.trimmed(F.col("s"))).alias("bare"), compact.alias("compact"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", C.decode_entities(F.concat(F.lit("&ldquo;"), F.coalesce("text", F.lit("")), F.lit("&rdquo;&amp;lt;&Prime;&deg;&eacute;"))).alias("text"))


def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    apart = F.concat(F.lit("."), F.repeat(F.lit("\n"), (F.col("doc_id") % 4 + 2).cast("int")))
    return d.select("doc_id", C.squeeze(F.concat(F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), apart), F.lit(" "))).alias("text"))


def decoded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes decoded as UTF-8, or as Latin-1 where one byte isn't."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 2 == 0, data).otherwise(F.concat(data, F.unhex(F.lit("E9")))).alias("data"))
    return d.select("doc_id", F.length(C.decode_bytes(F.col("data"))).cast("long").alias("n_chars"))


def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    stem = F.element_at(F.array(*map(F.lit, ("ipg", "PG", "pftaps", "ipa", "pa"))), (key % 5 + 1).cast("int"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("x/"), stem, key.cast("string")).alias("name"))
    return o.select("o_orderkey", C.doc_kind(F.concat("name", F.lit(".ZIP"))).alias("doc_kind"), C.is_aps_entry(F.concat("name", F.when(key % 2 == 0, ".TXT").otherwise(".xml"))).alias("is_aps"))


def concatenated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put into one text, in parts; their lengths and separators."""
    path = scratch(spark, "concatenated")
    docs = _rendered(spark, sf_dir, "{{title}}").select(F.col("doc_id").cast("string").alias("path"), "markdown")
    sinks.write_concatenated(docs, path).count()
    parts = spark.read.text(path, wholetext=True)
    n = F.size(F.split("value", sinks.DOC_SEPARATOR)) - F.when(F.col("value").startswith(sinks.DOC_SEPARATOR), 1).otherwise(0)
    return parts.agg(F.sum(F.length("value")).alias("n_chars"), F.sum(n).alias("n_documents"))


QUERIES = {f.__name__: f for f in (
    biblio, formats, page_formats, party_names, classifications, priority, priority_dates, claims, claim_counts, abstracts, abstract_blocks, descriptions, description_parts, claim_blocks, frontmatter, markdown, whole_documents, drawings,
    manifest, limited, doc_keys, unsupported_lines, manifest_lines, json_lines, json_strings, rewritten, split_records, split_tagged, tagged_fields, tagged_values, tagged_inventors, tagged_claims, elements_below, element_paths, prologs, shard_roundtrip, shard_parts, pointers, bucketed_pointers, looked_up, archive_records, archive_set, by_application_number, identifiers, labels_of_applications,
    entities, blank_lines, decoded_lengths, archive_names, concatenated_titles,
)}
