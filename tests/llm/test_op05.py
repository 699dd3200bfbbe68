"""op5: targets by repeated sharing, copies by definition, odd rows."""

import hashlib
import math
from collections import defaultdict

from crease.llm import op05_mixing as op


def brute_targets(sizes):
    """Share by weight, cap at three times the size, share the excess anew until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def check(data, got):
    size = lambda t: len((t or "").split())
    sizes, docs = defaultdict(int), defaultdict(list)
    for i, s, t in data:
        sizes[s] += size(t)
        docs[s].append((size(t), -1 if i is None else i % 64, -1 << 62 if i is None else i, i))
    target, want = brute_targets(sizes), []
    for s, rows in docs.items():
        u = (int(hashlib.md5(f"mix|{'null' if s is None else 's' + s}".encode()).hexdigest()[:8], 16) + 0.5) / 16**8
        share = min(target[s] / sizes[s], 3.0) if sizes[s] else 0.0
        for k, (n, _, _, i) in enumerate(sorted(rows), 1):
            want.append((i, n, sizes[s], round(target[s], 6), (math.floor(k * share + u) - math.floor((k - 1) * share + u)) * n))
    assert sorted([(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got], key=str) == sorted(want, key=str)
    return target, sizes


def test_equal_to_brute_force(spark, tmp_path):
    data = [(i, f"s{i % 7}", "w " * (i * 37 % 211)) for i in range(700)]
    data += [(1000 + i, "tiny", "w w") for i in range(3)] + [(2000, None, "null source here"), (2001, "empty", None), (2002, "empty", ""),
                                                            (None, "s1", "no id"), data[3], data[3], (-5, "s2", "negative")]
    spark.createDataFrame(data, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op.op5_systematic_mix(spark, str(tmp_path)).collect()
    target, sizes = check(data, got)
    again = op.op5_systematic_mix(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    taken = defaultdict(int)
    by_id = {i: s for i, s, _ in data}
    for r in got:
        taken[by_id[r.doc_id]] += r.taken
        assert r.taken <= 3 * r.size
    for s in sizes:
        if s not in ("s1", "s2"):
            assert abs(taken[s] - target[s]) <= 2 * 211
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).selectExpr("*", "1 AS mix")
    assert op.mix(docs.selectExpr("*", "2 AS _mix")).columns == ["doc_id", "source", "text", "mix", "_mix"]
    mixed = op.mix(docs.drop("mix").selectExpr("*", "1 AS _copy"))
    assert mixed.columns == ["doc_id", "source", "text", "_copy"] and mixed.count() == sum(r.taken // max(r.size, 1) for r in got if r.size) + sum(
        0 for r in got if not r.size) + mixed.filter("size(filter(split(coalesce(text, ''), ' '), x -> x <> '')) = 0").count()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op.op5_systematic_mix(spark, str(tmp_path)).collect() == []
    only_empty = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    assert op.mix(only_empty).collect() == []
