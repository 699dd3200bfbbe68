"""op1 against brute force: recall, exact scores and ties, vectors that take no part."""

import numpy as np
from pyspark.sql import functions as F

from crease.llm import op01_forest as op


def brute(data, k):
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in data
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 3]
    out = {}
    for a, (i, q) in enumerate(rows):
        if i % 2 == 0:
            s = sorted((-float((v * q).sum()), j) for b, (j, v) in enumerate(rows) if a != b)[:k]
            out.setdefault(i, []).append([(j, -x) for x, j in s])
    return out


def test_small_tables_are_exact(spark):
    data = [(i, [float(i % 5), float(i % 3) - 1, 2.0]) for i in range(30)]
    data += [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (104, [1.0, None, 2.0]), (106, [1.0, float("nan"), 0.0]),
             (108, [float("inf"), 0.0, 0.0]), (110, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), data[4]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("row", F.lit(1))
    got = {}
    for r in sorted(op.search(df, F.col("vec_id") % 2 == 0, 4, enough=1.0, block=7, tile=3).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(data, 4)
    assert got.pop(4) == sorted(want.pop(4)[0] * 2, key=lambda x: (-x[1], x[0]))
    assert got == {i: w[0] for i, w in want.items()}


def test_recall_and_ties(spark, tmp_path):
    x = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    v = np.stack(x["embedding"]).astype(np.float64)
    got = op.op1_prefix_forest(spark, "/root/testdata/sf0.1").toPandas()
    hits = n = 0
    for i in np.flatnonzero(x["vec_id"] % 20 == 0):
        s = (v * v[i]).sum(axis=1)
        s[i] = -np.inf
        want = set(x["vec_id"].to_numpy()[np.lexsort((x["vec_id"], -s))[:20]].tolist())
        mine = got[got.query_id == x["vec_id"][i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine["score"]) <= 0).all()
        hits += len(want & set(mine["vec_id"]))
        n += 20
    assert hits / n >= 0.9
    same = spark.range(400).selectExpr("id AS vec_id", "array(1.0F, 0.5F) AS embedding")
    same.write.parquet(str(tmp_path / "embeddings.parquet"))
    for r in op.op1_prefix_forest(spark, str(tmp_path)).collect():
        assert r.vec_id == r["rank"] - 1 + (r.query_id <= r["rank"] - 1) and r.score == 1.25


def test_ascent_takes_longest_prefixes_first():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 8))
    planes = op.hyperplanes(8, 4, 12)
    forest, codes = op.Forest(x, planes), op.strings(x, planes)
    for q, rows in zip(x[:20], forest.candidates(x[:20], 40)):
        mine = op.strings(q[None], planes)
        shared = np.array([[12 - int(int(a) ^ int(b)).bit_length() for b in t] for t, a in zip(codes, mine[:, 0])]).max(axis=0)
        depth = max(d for d in range(13) if (shared >= d).sum() >= 40)
        assert rows.tolist() == np.flatnonzero(shared >= depth).tolist()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op.search(df, F.col("vec_id") % 20 == 0, 20).collect() == []
