"""Dense surrogate ids without a single-partition window.

``exclusive_prefix_sums`` gives, for rows with a unique ordering key and
per-row counts, the sum of the counts of all rows with a smaller key. A global
``sum().over(orderBy(key))`` would pull every row into one task; instead the
keys are cut into ``RANGES`` ranges at their quantiles, so ranges hold nearly equal numbers of keys
however the keys are spread:

1. within-range prefix: window partitioned by range;
2. range totals: one row per range, prefix-summed.

The cuts are one scalar subquery, so the plan stays lazy and both branches use the same ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crease.session import checkpoint_dir

#: Ranges the keys are cut into.
RANGES = 256


def exclusive_prefix_sums(df: DataFrame, key: str, counts: list[str], prefix_names: list[str] | None = None,
                          ) -> DataFrame:
    """Return ``key`` plus one ``<count minus 'n_'>_offset`` column per count column.

    Offsets are exclusive (the first key gets 0). ``key`` must be unique.
    """
    names = prefix_names or [c[2:] + "_offset" if c.startswith("n_") else c + "_offset" for c in counts]
    cuts = df.agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("c")).select("c").scalar()
    # The first cut at or above the key; keys above all cuts are the last range.
    ranged = df.select(key, *counts, F.coalesce(cuts, F.array().cast("array<bigint>")).alias("_cuts"))
    ranged = ranged.withColumn("_rng", F.size(F.filter("_cuts", lambda c: c < F.col(key)))).drop("_cuts")
    w_in = Window.partitionBy("_rng").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.select(key, "_rng", *[F.coalesce(F.sum(c).over(w_in), F.lit(0)).alias("_in_" + c)
                                          for c in counts])
    totals = ranged.groupBy("_rng").agg(*[F.sum(c).alias("_tot_" + c) for c in counts])
    w_rng = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    range_off = totals.select("_rng", *[F.coalesce(F.sum("_tot_" + c).over(w_rng), F.lit(0)).alias("_ro_" + c)
                                        for c in counts])
    joined = within.join(range_off, "_rng")
    return joined.select(key, *[(F.col("_ro_" + c) + F.col("_in_" + c)).cast("long").alias(n)
                                for c, n in zip(counts, names)])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """L4: ``df`` with its place (from 1) in ``order``, which should be unique.

    A distributed sort is written to the shared folder, each row with its place in its partition; the rows of earlier
    partitions, one count each, are added.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/sorted-{uuid.uuid4().hex}"
    placed = df.orderBy(*order).select(*df.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    counts = rows.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row a partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    return rows.join(starts, "_part").select(*df.columns, (F.col("_at") + F.col("_start")).alias(name))
