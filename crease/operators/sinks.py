"""Tables that are changed in place or laid out for later joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table that takes upserts. A change rewrites the parts that hold its keys.
PARTS = 64


def _with_part(df: DataFrame, key: list[str], parts: int) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))


def write_keyed(df: DataFrame, path: str, key: list[str], parts: int = PARTS) -> None:
    """A table partitioned by the hash of its key, for :func:`upsert`."""
    _with_part(df, key, parts).repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame],
           parts: int = PARTS) -> list[int]:
    """K5: ``merge(rows, changes)`` for the parts that hold keys of ``changes``, which alone are read and written.

    ``merge`` gives the columns of the table. Its result is written beside the table first and then replaces the parts
    by a dynamic partition overwrite, so no part is read while it is written, and a run that fails before leaves the table as it
    was. Returns the parts that were touched, at most ``parts`` numbers.
    """
    changes = _with_part(changes, key, parts)
    touched = sorted(r[0] for r in changes.select("part").distinct().collect())
    if not touched:
        return []
    current = spark.read.parquet(path).filter(F.col("part").isin(touched))
    columns = [c for c in current.columns if c != "part"]
    merged = _with_part(merge(current.drop("part"), changes.drop("part")).select(*columns), key, parts)
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    merged.repartition(len(touched), "part").write.partitionBy("part").parquet(staged)
    rows = spark.read.schema(spark.read.parquet(path).schema).parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return touched


def append_rows(df: DataFrame, path: str, run: int) -> None:
    """The rows of one run beside those of earlier runs; the same run written again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def save_bucketed(tables: Mapping[str, DataFrame], database: str, by: Mapping[str, str], folder: str, buckets: int) -> None:
    """K1: the tables of ``database`` dropped and written anew, bucketed and sorted by ``by[name]``.

    Tables bucketed alike by the columns they are joined on are joined without a shuffle.
    """
    for name, df in tables.items():
        spark = df.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        writer = df.repartition(buckets, by[name]) if name in by else df
        writer = writer.write.mode("overwrite").option("path", f"{folder.rstrip('/')}/{name}")
        if name in by:
            writer = writer.bucketBy(buckets, by[name]).sortBy(by[name])
        writer.format("parquet").saveAsTable(f"{database}.{name}")
