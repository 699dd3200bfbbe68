"""op11 against brute force on whole small tables and on planted cases."""

import random
import re

import numpy as np

from crease.llm import op11_minhash as op
from helpers import rows, union_find


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(data):
    sets = [brute_set(t) for _, t in data]
    pairs = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = union_find(len(data), pairs)
    least = {r: min([data[i][0] for i in range(len(data)) if root[i] == r and data[i][0] is not None], default=None) for r in set(root)}
    return sorted([(d, len(sets[i]), least[root[i]], d == least[root[i]]) for i, (d, _) in enumerate(data)], key=str)


def texts_with_copies(rng, n, changes, length=120):
    words = ["w%d" % i for i in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, length))) for _ in range(n)]
    for t in texts[: n // 2]:
        w = t.split()
        for k in range(rng.randint(0, changes)):
            if w:
                w[rng.randrange(len(w))] = f"new{k}"
                texts.append(" ".join(w))
    return texts


def test_sets_match_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 40, 3000):
        t = " ".join(rng.choice(["Ab", "ab", "é", "x\ty", "ÄÖ", "ä", "\n"]) for _ in range(n))
        assert len(op.shingle_set(t)) == len(brute_set(t))
    assert not len(op.shingle_set(None)) and not len(op.shingle_set(" \n"))
    assert set(op.shingle_set("a b")) != set(op.shingle_set("b a")) and not set(op.shingle_set("a b")) & set(op.shingle_set("a b c"))


def test_long_texts_are_read_in_parts(monkeypatch):
    t = " ".join(f"word{i % 997} é" for i in range(2000))
    whole = op.shingle_set(t)
    monkeypatch.setattr(op, "CHUNK", 50)
    assert np.array_equal(op.shingle_set(t), whole) and len(whole) == len(brute_set(t))


def test_components_equal_brute_force(spark, tmp_path):
    rng = random.Random(2)
    texts = texts_with_copies(rng, 80, 5)
    texts += [None, "", " \n ", texts[0], texts[0], "one two", "one two", "One  two", "one"]
    data = [(i, t) for i, t in enumerate(texts)]
    data += [data[5], (None, "only this one here stands alone today"), (None, texts[3]), (None, None), (7, "another text under an id that is there")]
    spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, row int").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(rows(op.op11_tensored_minhash(spark, str(tmp_path))), key=str) == brute(data)


def test_template_group_loses_no_link(spark):
    """All texts share a template, each has one near copy; stars alone would miss most pairs."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(100)]
    data = []
    for i in range(60):
        own = [f"own{i}x{k}" for k in range(25)]
        data.append((2 * i, " ".join(template + own)))
        own[rng.randrange(25)] = f"changed{i}"
        data.append((2 * i + 1, " ".join(template + own)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute(data)
    assert sorted(rows(op.near_duplicates(df)), key=str) == want
    assert sorted(rows(op.near_duplicates(df, small=3)), key=str) == want
    assert len({w[2] for w in want}) == 60


def test_chain_of_copies(spark):
    """Each text is near its neighbours only; the component is the whole chain."""
    words = [f"c{i}" for i in range(400)]
    data = [(i, " ".join(words[4 * i:4 * i + 120])) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute(data)
    assert {w[2] for w in want} == {0}
    assert sorted(rows(op.near_duplicates(df)), key=str) == want
    assert sorted(rows(op.near_duplicates(df, small=2)), key=str) == want


def test_pairs_at_the_threshold_share_a_table():
    """Sets of Jaccard 0.85 meet in a table; both collections must agree somewhere."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 2**63, 185, dtype=np.uint64))
        b = a.copy()
        b[:15] = rng.integers(0, 2**63, 15, dtype=np.uint64)
        x, y = op.half_keys(a) == op.half_keys(np.unique(b)), op.HALVES
        met += x[:y].any() and x[y:].any()
    assert met >= 399


def test_rarest_shingles_lose_no_pair(spark):
    """All pairs at or above the threshold are among the candidates, with sets of any size and a coarse order."""
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(60):
        base = rng.integers(-2**62, 2**62, rng.integers(1, 80))
        for _ in range(3):
            kept = base[rng.random(len(base)) > rng.random() * 0.15]
            sets.append(np.unique(np.concatenate([kept, rng.integers(-2**62, 2**62, rng.integers(0, 4)), base[:1]])))
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "rep long, shingles array<long>")
    for bits in (4, 18):
        counts = spark.sparkContext.broadcast(op.frequencies(df, bits))
        rare = op.rarest(df, counts, 85).selectExpr("*", "rep AS root")
        got = {(r.a, r.b) for r in op.by_rarest(rare, 85).collect()}
        want = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
        assert len(want) > 30 and want <= got


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(op.op11_tensored_minhash(spark, str(tmp_path))) == []
