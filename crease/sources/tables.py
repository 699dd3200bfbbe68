"""Readers for the driver's parquet tables.

Reads are lazy: Catalyst prunes columns and pushes filters into the parquet
scan, so callers select what they need and nothing more is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, ``<sf_dir>/<name>.parquet`` (a file or a directory)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """Register driver tables as temp views for SQL-held queries."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
