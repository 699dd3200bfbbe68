"""op3 against brute force on whole small tables and on planted cases."""

import random

import numpy as np
import pytest
import xxhash

from crease.llm import op03_simhash as op
from helpers import rows, union_find


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 40, 9000):
        t = " ".join(rng.choice(["Ab", "é", "x\ty", "ÄÖ", "\n"]) for _ in range(n))
        assert op.fingerprint(t) & (2**64 - 1) == brute_fingerprint(t)
    assert op.fingerprint(None) == 0 and op.fingerprint(" \n") == 0


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_close_pairs_equal_brute_force(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(150)], dtype=np.uint64)
    fps = np.concatenate([base, base ^ flips])
    got = {(int(a), int(b)) for x, y in op.close_pairs(fps, fps, radius) for a, b in zip(x, y)}
    want = {(a, b) for a in range(300) for b in range(300) if int(fps[a] ^ fps[b]).bit_count() <= radius}
    assert got == want


def test_components_equal_brute_force(spark, tmp_path):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    for t in texts[:30]:
        w = t.split()
        for k in range(rng.randint(0, 6)):
            if w:
                w[rng.randrange(len(w))] = f"new{k}"
                texts.append(" ".join(w))
    texts += [None, "", " \n ", texts[0], texts[0]]
    data = [(i, t) for i, t in enumerate(texts)]
    data += [data[5], (None, "only this one here stands alone today")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(op.op3_bit_sliced_simhash(spark, str(tmp_path)))
    fps = [brute_fingerprint(t) for _, t in data]
    pairs = [(a, b) for a in range(len(data)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    root = union_find(len(data), pairs)
    least = {r: min([data[i][0] for i in range(len(data)) if root[i] == r and data[i][0] is not None], default=None) for r in set(root)}
    want = [(data[i][0], f"{fps[i]:016x}", least[root[i]]) for i in range(len(data))]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = op.dedup(spark.read.parquet(str(tmp_path / "documents.parquet")).selectExpr("*", "1 AS _fp"))
    assert kept.columns == ["doc_id", "text", "_fp"]
    assert sorted([r[0] for r in kept.collect()], key=str) == sorted(least.values(), key=str)


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    def classes_of(tile):
        edges = [(r.a, r.b) for r in op.links(df, 4, tile).collect()]
        at = {f: i for i, f in enumerate(fps)}
        return union_find(len(fps), [(at[a], at[b]) for a, b in edges])
    assert classes_of(8192) == classes_of(7) == union_find(
        len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(op.op3_bit_sliced_simhash(spark, str(tmp_path))) == []
