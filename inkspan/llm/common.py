"""What the operators of this package share: reading tables, tables in the shared folder, distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import lean as lean
from ..sources.scratch import scratch

#: Words everywhere in this package: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have: the given ones with as many underscores behind them as it takes."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (n + "_" * k for k in range(len(taken) + 1)) if x.lower() not in taken) for n in names]


def few_parts(df: DataFrame, per_core: int = 4) -> DataFrame:
    """df in at most `per_core` parts a core of the cluster: for narrow rows, whose files would be tiny otherwise."""
    return df.coalesce(per_core * df.sparkSession.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, is computed once, and outlives lost executors. narrow: rows of
    a few numbers, written as few_parts()."""
    return written_at(few_parts(df) if narrow else df, scratch(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, group: list[str], order: list[Column], size: str, out: str, bucket: Column) -> DataFrame:
    """Adds out: the sum of size over the rows of the group that come before, in the order (bucket, *order).

    bucket must follow the wanted order in coarse steps, so that no task has to hold a whole group: sums within
    a bucket, and sums over buckets (one row each), are two windows.
    """
    b, inner, total, base = free_names(df, f"_{out}_bucket", f"_{out}_inner", f"_{out}_sum", f"_{out}_base")
    df = df.withColumn(b, bucket)
    keys = [F.col(c) for c in [*group, b]]
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(size).alias(total)).withColumn(base, F.coalesce(F.sum(total).over(before), F.lit(0)))
    left = df.withColumn(inner, F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, b]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = left.alias("l").join(sums.select(*group, b, base).alias("r"), cond, "left")
    return joined.select("l.*", F.col(base)).withColumn(out, F.col(inner) + F.col(base)).drop(b, inner, base)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table of written_at() that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
