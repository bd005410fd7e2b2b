"""Files and archives that land in a folder, taken in as they come. Every record stands by itself, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..functions import templates
from ..operators.parse import parse
from ..sources.archives import open_archives
from ..sources.sinks import archive_set_rows, write_set


def landing(spark: SparkSession, path: str) -> DataFrame:
    """A stream of XML files: path, raw."""
    return spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.[xX][mM][lL]").schema("value string").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def landing_paths(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the paths of *.zip archives; their contents are not read."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path")


def landing_archives(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the records of *.zip archives: path, shard, source_file, ordinal, raw, error. A task opens an archive by its
    path and reads it as a stream."""
    return open_archives(landing_paths(spark, path))


def parsed_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parsed rows as files land."""
    return parse(landing(spark, path))


def parsed_archive_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parsed rows with shard, source_file, ordinal, doc_key as archives land; archives that can't be opened have error."""
    d = landing_archives(spark, path)
    return parse(d.withColumn("doc_key", C.doc_key(F.col("raw"), F.col("ordinal"))))


def write_archive_stream(spark: SparkSession, path: str, out: str, checkpoint: str, template: str = templates.DEFAULT) -> StreamingQuery:
    """Archives that have landed in path so far, written as sets of shards: <out>/batch-<number>/<shard>.*; returns the query.

    A batch is one commit under its number, and replaces what an earlier attempt at it has left; so a stream that was broken
    off and is started again on its checkpoint has each archive's records once. An archive that can't be opened stops it."""

    def write(batch: DataFrame, number: int) -> None:
        write_set(archive_set_rows(open_archives(batch, headers=True), None, template), f"{out}/batch-{number:08d}", replace=True)

    return landing_paths(spark, path).writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
