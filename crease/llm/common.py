"""Helpers shared by the operators: shared-folder tables, distributed ranks, word patterns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crease.session import checkpoint_dir

#: Fixed value: the white space that separates words.
SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: work that several later
    steps use is done once, and a lost executor costs a reread instead of a new computation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str, parts: int = 256) -> DataFrame:
    """Add ``rank``: 0, 1, 2, ... within ``group``, without a task that holds a whole group.

    Rows of a group are dealt over ``parts`` buckets by the hash of ``order``; counts per bucket
    (at most groups x parts rows) are prefix-summed and added to the position within the bucket.
    The rank runs by bucket, then by ``order``. Rows equal in every column of ``order`` get
    neighbouring ranks in any order.
    """
    part, before = free_name(df, "_part"), free_name(df, "_before")
    keys = [*group, part]
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias(before))
    offsets = offsets.select(*[F.col(c).alias(f"_o_{i}") for i, c in enumerate(keys)], before)
    same = [dealt[c].eqNullSafe(offsets[f"_o_{i}"]) for i, c in enumerate(keys)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    inside = Window.partitionBy(*keys).orderBy(*order)
    joined = dealt.join(offsets, on)
    return joined.withColumn(rank, F.col(before) + F.row_number().over(inside) - 1).select(*df.columns, rank)


def thinned(df: DataFrame, key: str, keys: DataFrame, bits: int = 24) -> DataFrame:
    """The rows of ``df`` whose long ``key`` may be among ``keys`` (one long column), before a join on it.

    A bitmap of ``2 ** bits`` bits is broadcast, as at most ``2 ** (bits - 6)`` rows of two numbers, whatever
    the input. It lets through every row with a key in ``keys``, and others by chance; with very many keys it lets through all.
    """
    place = lambda c: F.pmod(c, F.lit(1 << bits))
    slot = lambda c: place(c).bitwiseAND(F.lit(63)).cast("int")
    word, marks = free_name(df, "_word"), free_name(df, "_marks")
    k = F.col(keys.columns[0])
    marked = (keys.groupBy(F.shiftright(place(k), 6).alias(word))
              .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot(k))).alias(marks)))
    met = df.withColumn(word, F.shiftright(place(F.col(key)), 6)).join(F.broadcast(marked), word)
    return met.filter(F.call_function("shiftright", F.col(marks), slot(F.col(key))).bitwiseAND(F.lit(1)) == 1).select(*df.columns)


def ordered(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str, total: str) -> DataFrame:
    """Add ``rank``, the place 0, 1, 2, ... in ``order`` within ``group``, and ``total``, the rows of the group.

    Unlike ``ranked`` it follows ``order`` over the whole group: rows are dealt into ranges of (group, order), sorted there
    and written with their place in the range; rows of a group in earlier ranges are counted and added. A group of
    any size, and one row repeated very often, spread over many ranges. Rows equal in ``order`` follow the input's order.
    ``df`` should be a table that is cheap to read twice; the columns of ``group`` must not be null.
    """
    spark = df.sparkSession
    salt, part, at, before = (free_name(df, x) for x in ("_salt", "_range", "_at", "_before"))
    by = [*group, *order, salt]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # The id grows by one from row to row of a sorted partition.
    placed = placed.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()).drop(salt)
    placed = written(placed, "ordered")
    counts = placed.groupBy(*group, part).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row a group and range.
    whole = Window.partitionBy(*group)
    up_to = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, part, (F.coalesce(F.sum("_n").over(up_to), F.lit(0)) - F.col("_first")).alias(before),
                            F.sum("_n").over(whole).alias(total))
    return placed.join(offsets, [*group, part]).select(*df.columns, (F.col(at) + F.col(before)).alias(rank), total)


def groups(batches, n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows that agree in the first ``n`` columns of Arrow batches; holds one run."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[:n] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n], []
            rows.append(row[n:])
    if rows:
        yield key, rows
