"""Sharding by weighted rendezvous hashing.

Every record key scores each shard with ``-weight / ln(u)``, where ``u`` in (0, 1) comes from the
64-bit hash of (key, shard number); the highest score wins. A further shard only takes the records
whose highest score is its own; a changed weight moves records only to or from that shard.

Defined results: a null key is a key of its own (equal to any other null key); a null text weighs
16 bytes like an empty one; rows repeated in full go to the same shard, each with its own slot; an
empty table gives no rows; further columns stay, and the added names must be free.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ranked, table

SHARDS = 40


def rendezvous(key: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard (0 .. len(weights) - 1) with the highest score for ``key``; the larger number on a tie."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def score(s: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(*key, s["i"]), 11)
        u = (bits.cast("double") + 0.5) / float(2**53)
        return F.struct((-s["w"] / F.log(u)).alias("score"), s["i"].alias("shard"))

    return F.array_max(F.transform(shards, score))["shard"]


def assign(df: DataFrame, key: Sequence[str], weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """Add the shard of each row."""
    return df.withColumn(shard, rendezvous([F.col(c) for c in key], weights))


def write(df: DataFrame, key: Sequence[str], weights: Sequence[float], path: str) -> None:
    """Write one folder a shard, ``path/shard=N``, in files of at most a million rows."""
    assign(df, key, weights).write.option("maxRecordsPerFile", 1_000_000).partitionBy("shard").parquet(path)


def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 of equal weight, with the shard each would have among 41."""
    body = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = assign(docs, ["doc_id"], [1.0] * SHARDS)
    placed = assign(placed, ["doc_id"], [1.0] * (SHARDS + 1), "grown_shard")
    out = ranked(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), "grown_shard")
