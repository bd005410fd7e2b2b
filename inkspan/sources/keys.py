"""A sorted index over the keys of all shards, so that a lookup reads the one file that can hold its key."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shards import read_documents, read_index

#: Beside the shards: files of pointers, sorted by key and apart by ranges of keys, and a catalog of one row a file.
FILES, CATALOG = "keys.index", "keys.catalog"
#: So many keys at most are looked for as a list; more by a join.
LISTED = 10_000


def write_key_index(spark: SparkSession, path: str, files: int | None = None) -> None:
    """Builds the index of all shards below path anew. Keys are dealt out by ranges and sorted, so that each file has a range of
    keys of its own (a key that is in many shards may end one and begin the next), with their bounds and a Bloom filter."""
    rows = read_index(spark, path)
    order = ["doc_key", "shard", "offset"]
    ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    out = ranged.sortWithinPartitions(*order).write.mode("overwrite")
    out.option("parquet.bloom.filter.enabled#doc_key", "true").parquet(f"{path}/{FILES}")
    found = spark.read.parquet(f"{path}/{FILES}").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("doc_key").alias("low"), F.max("doc_key").alias("high"), F.count("*").alias("keys"))
    found.coalesce(1).write.mode("overwrite").parquet(f"{path}/{CATALOG}")  # one row a file


def files_for(spark: SparkSession, path: str, keys: list[str]) -> list[str]:
    """The files of the index that can hold one of some keys (UTF-8 order), by the catalog alone."""
    wanted = sorted(k.encode() for k in set(keys))
    some = []
    for r in spark.read.parquet(f"{path}/{CATALOG}").collect():  # one row a file of the index
        at = bisect_left(wanted, r.low.encode())
        if at < len(wanted) and wanted[at] <= r.high.encode():
            some.append(r.file)
    return sorted(some)


def pointers(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The first pointer (doc_key, shard, offset, length) of each key in keys (doc_key); keys that are nowhere have no row.

    Up to LISTED keys: only files whose range holds one are read, and the keys go to their row groups as a filter (bounds,
    Bloom filters). More: the sorted index is joined with them. Null keys: none. Repeated keys: one row."""
    wanted = keys.select("doc_key").where("doc_key IS NOT NULL").distinct()
    listed = [r.doc_key for r in wanted.limit(LISTED + 1).collect()]
    schema = "doc_key string, shard string, offset long, length long"
    if len(listed) > LISTED:
        found = spark.read.schema(schema).parquet(f"{path}/{FILES}").join(wanted, "doc_key")
    else:
        files = files_for(spark, path, listed)
        if not files:
            return spark.createDataFrame([], schema)
        found = spark.read.schema(schema).parquet(*files).where(F.col("doc_key").isin(listed))
    first = found.groupBy("doc_key").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return first.select("doc_key", "at.*")


def documents_of(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_key, text of the first document of each key in keys."""
    return read_documents(pointers(spark, path, keys), path)
