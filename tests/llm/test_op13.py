"""op13 against a plain trie on small tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from crease.llm import op13_trie as op
from helpers import rows

SCHEMA = "conv_id long, turn long, role string, text string, place int"


def plain(data):
    turns = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c in own:
        first = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:first] + own[c][first:]
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    out = []

    def walk(node):
        leaves, saved = 0, (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for child in below[node]:
            l, s = walk(child)
            leaves, saved = leaves + l, saved + s
        leaves = leaves or 1
        ends = sorted(c for c in members[node] if len(made[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below[node]), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=str)


def check(spark, data, **params):
    df = spark.createDataFrame([(*r, 1) for r in data], SCHEMA).repartition(6)
    got = rows(op.trie(df.select("conv_id", "turn", "role", "text"), **params))
    assert sorted(got, key=str) == plain(data)
    return got


def talk(rng, convs, turns, words=("a", "Bé", None, "", "long text")):
    data = []
    for c in convs:
        n = rng.randint(1, turns)
        places = rng.sample([None, *range(40)], n)
        data += [(c, p, rng.choice(["user", "assistant", None]), rng.choice(words)) for p in places]
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("params", [{}, {"band": 3, "shard": 4, "queue": 2, "piece": 2}, {"band": 2, "shard": 1, "queue": 1, "piece": 1}])
def test_equals_plain_trie(spark, params):
    rng = random.Random(1)
    convs = [*range(0, 40), *range(100, 130), *range(207, 215), 1000, -3, -105, -100, -230, 10**15 + 5, 10**15]
    check(spark, talk(rng, convs, 9) + [(None, 1, "user", "x")], **params)


def test_deep_conversation_over_tiers(spark):
    rng = random.Random(2)
    deep = [(5, i, "user", rng.choice("ab")) for i in range(70)]
    twin = [(100, i, "user", r[3]) for i, r in enumerate(deep[6:])] + [(105, i, "user", r[3]) for i, r in enumerate(deep[:50])]
    data = deep + twin + talk(rng, [0, 1, 7, 150], 12, "ab")
    assert max(g[1] for g in check(spark, data, band=3, shard=5, queue=2)) > 60
    check(spark, data, band=64)


def test_many_equal_conversations(spark):
    data = [(c, t, "user", "same text") for c in range(0, 60) for t in range(3)] + [(500, 0, "user", "other")]
    got = check(spark, data, band=2, shard=3, queue=2, piece=7)
    assert max(g[3] for g in got) == 61


def test_turnless_conversations(spark):
    # Without conversation 300 there are no first turns to take; 301's own end before h.
    ids = [c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 >= 2][:4]
    data = [(c, t, "user", "x") for c in ids for t in range(2)]
    assert check(spark, data) == [tuple(plain(data)[0])]


def test_ties_have_one_result(spark):
    data = [(1, 2, "user", t) for t in "bca"] + [(0, 0, "user", "z")] + [(1, 2, "user", "b")]
    df = lambda k: spark.createDataFrame([(*r, 1) for r in data], SCHEMA).repartition(k)
    assert sorted(rows(op.trie(df(1))), key=str) == sorted(rows(op.trie(df(5))), key=str)


def test_queue_spills_and_keeps_order():
    rng = random.Random(3)
    messages = [((rng.randint(0, 9), rng.randint(0, 3), 0), i, i) for i in range(500)]
    queue = op.Queue(7)
    for m in messages:
        queue.push(m)
    assert len(queue.heap) <= 7 and len(queue.runs) > 50
    got = [m for order in sorted({m[0] for m in messages}) for m in queue.pop(order)]
    assert sorted(got) == sorted(messages) and not queue.heap and not queue.runs


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows(op.op13_prefix_trie(spark, str(tmp_path))) == []
