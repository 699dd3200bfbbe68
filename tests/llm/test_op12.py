"""op12 against a plain Merkle tree on small tables."""

import hashlib
import random
import zlib

import pytest

from crease.llm import op12_merkle as op
from helpers import rows

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    doc_id, source, lang, n_chars, text = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """The root and, per node, its sibling lists level by level."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % 8
            run = nodes[first:first + 8]
            paths[i].append((run[:p - first], run[p - first + 1:]))
            at[i] = p // 8
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(data):
    langs = sorted({r[2] for r in data}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted([r for r in data if r[2] == x], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for x in langs}
    climbed = {x: climb([plain_leaf(r) for r in of[x]]) for x in langs}
    root, tops = climb([climbed[x][0] for x in langs]) if langs else (None, [])
    out = []
    for x, top in zip(langs, tops):
        for r, path in zip(of[x], climbed[x][1]):
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                changed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node = plain_leaf(changed)
            for left, right in path + top:
                node = h(*left, node, *right)
            proof = h(*[d for left, right in path + top for d in left + right])
            out.append((r[0], plain_leaf(r), climbed[x][0], root, proof, node, node == root))
    return sorted(out, key=str)


def data_of(n, langs, seed):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        text = rng.choice([None, "", "Lower", "lower", "ÄÖ é", "Text %d\nMore" % i])
        data.append((i * 7 % 1000 if rng.random() < 0.95 else None, rng.choice(["a", None, "Quelle"]), rng.choice(langs), rng.choice([None, i]), text))
    return data + data[:3]


def check(spark, data, **params):
    df = spark.createDataFrame([(*r, "x") for r in data], SCHEMA).repartition(5)
    got = rows(op.manifest(df.select(*op.FIELDS), **params))
    assert sorted(got, key=str) == plain(data)
    return got


@pytest.mark.parametrize("n", [1, 8, 9, 65, 700])
def test_equals_plain_tree(spark, n):
    got = check(spark, data_of(n, ["de", "en", "z", None], n))
    if n > 50:
        assert {g[6] for g in got} == {True, False}


def test_many_languages_and_small_blocks(spark):
    check(spark, data_of(300, [f"l{i}" for i in range(90)] + [None, "é", "￿", "\U00010000"], 5), levels=1)


def test_one_language_and_tiers(spark):
    check(spark, data_of(600, ["en"], 6), levels=1)
    check(spark, data_of(1, [None], 7))


def test_versions_share_untouched_nodes():
    tree = op.Block([h(str(i)) for i in range(100)], 3)
    before = [list(x) for x in tree.levels]
    version = tree.version(37, h("changed"))
    assert sorted(version) == [(0, 37), (1, 4), (2, 0), (3, 0)] and tree.levels == before
    again = op.Block([h("changed") if i == 37 else h(str(i)) for i in range(100)], 3)
    assert tree.root_of(version) == again.root != tree.root
    assert op.folded(h("changed"), tree.siblings(37)) == again.root


def test_repeated_row_in_a_third_of_the_table(spark):
    data = data_of(100, ["en", "de"], 8)
    check(spark, data + [data[0]] * 60, levels=1)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(op.op12_merkle_manifest(spark, str(tmp_path))) == []
