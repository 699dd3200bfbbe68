"""op7: scores by definition, gapless slots, few records moved, weights."""

import math
import struct
import zlib
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from crease.llm import op07_sharding as op


def brute(doc_id, weights):
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    score = []
    for s, w in enumerate(weights):
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", s), seed) >> 11) + 0.5) / 2**53
        score.append((-w / math.log(u), s))
    return max(score)[1]


def test_equal_to_brute_force(spark, tmp_path):
    data = [(i * 7 - 50, "text %d é" % i) for i in range(400)] + [(1, None), (1, None), (None, ""), (2, "x" * 100_000)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op.op7_rendezvous(spark, str(tmp_path)).collect()
    want = sorted([(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", brute(d, [1] * 40), brute(d, [1] * 41)) for d, t in data], key=str)
    assert sorted([(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got], key=str) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_weights_and_files(spark, tmp_path):
    df = spark.range(6000).withColumnRenamed("id", "k")
    before = op.assign(df, ["k"], [1, 2, 3])
    n = {r.shard: r["count"] for r in before.groupBy("shard").count().collect()}
    assert abs(n[0] - 1000) < 150 and abs(n[2] - 3000) < 200
    after = op.assign(before, ["k"], [1, 2, 4], "later")
    assert after.filter("later <> shard AND later <> 2").count() == 0
    op.write(df.limit(100), ["k"], [1, 1], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.filter(F.col("shard") != op.rendezvous([F.col("k")], [1, 1])).count() == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op.op7_rendezvous(spark, str(tmp_path)).collect() == []
