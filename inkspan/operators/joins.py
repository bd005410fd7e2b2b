"""Joins by the keys that the outputs share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_pointers(biblio: DataFrame, index: DataFrame) -> DataFrame:
    """Bibliographic rows (shard, doc_key, ...) with offset and length of their documents in the archives. Keys may repeat
    within a shard: each pointer makes a row, as in the index. Rows without a pointer are not kept. Null keys: none."""
    return biblio.join(index.select("shard", "doc_key", "offset", "length"), ["shard", "doc_key"])


def by_application(biblio: DataFrame, other: DataFrame, number: str = "application_number") -> DataFrame:
    """Bibliographic rows with the rows of another record set that has application numbers as digits (8 with zeros in front).
    Columns of the other set whose names clash get the prefix other_."""
    right = other.select(F.lpad(F.col(number).cast("string"), 8, "0").alias("application_number"), *[F.col(c).alias(f"other_{c}" if c in biblio.columns else c) for c in other.columns if c != number])
    return biblio.join(right, "application_number")


def write_bucketed(df: DataFrame, table: str, path: str, by: tuple[str, ...] = ("shard", "doc_key"), buckets: int = 64) -> DataFrame:
    """df as a table whose files are dealt out by the keys and sorted by them: two of them with as many buckets are joined
    without moving a row. One file a bucket: rows are dealt out once, by the buckets' own hash. Choose buckets so that one of
    them fits a task (about a thousand for a terabyte)."""
    dealt = df.repartition(buckets, *by)
    dealt.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def drop_bucketed(spark: SparkSession, table: str) -> None:
    """Forgets the table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
