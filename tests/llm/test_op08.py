"""op8: ids by direct encoding, exact round trip, little padding."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from crease.llm import op08_packing as op

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = op.Encoder(PATH)


def ids_of(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Été", "²", "b,", "c.\nd", " ", "  ", "\n", "\t ", " ", "x.", "1", "'s", "don't", "中文", "<|endoftext|>", "%%%",
                                 " ", "\x85", "​", "🙂", "_", "\x0b"]), max_size=12))
def test_remembered_words_give_the_same_ids(parts):
    text = "".join(parts)
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == ids_of(text)


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 100_000):
        sizes = rng.integers(1, 129, n)
        histogram = dict(zip(*[x.tolist() for x in np.unique(sizes, return_counts=True)]))
        rows = op.plan(histogram, 128)
        load = {}
        for c in histogram:
            mine = sorted(r for r in rows if r[0] == c)
            assert [r[1] for r in mine] == [0] + [r[2] for r in mine[:-1]] and mine[-1][2] == histogram[c]
        for c, a, b, each, first, times in rows:
            assert b - a == each * times
            load.setdefault((first, times), []).append(c * each)
        assert all(sum(x) <= 128 for x in load.values())
        n_sequences = sum(t for _, t in load)
        if n > 1000:
            assert n_sequences <= 1.01 * sizes.sum() / 128 + 10 or n_sequences <= 1.02 * max(sizes.sum() / 128, (sizes > 64).sum())


def test_round_trip(spark, tmp_path):
    texts = [None, "", "one", "two  spaces", " ".join("word%d" % i for i in range(3000)), "same", "same"] + [
        " ".join("w%d" % (i * j) for j in range(i)) for i in range(60)]
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(6, "same", "x"), (None, "no id", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, sequence_id string")
    got = op.pack_documents(docs, with_ids=True).collect()
    docs_back, sequences = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        docs_back.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text, _ in data:
        parts = sorted(set(docs_back[i]))
        whole = np.frombuffer(b"".join(p[1] for p in parts), "<u4").tolist()
        assert whole == ids_of(text or "") + [1] and parts[0][2] == len(whole)
        assert [p[0] for p in parts] == list(range(0, len(whole), op.LIMIT))
    assert len(docs_back[6]) == 2
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= op.LIMIT


def test_added_tokens_are_themselves():
    assert ids_of("Hello <|endoftext|> world") == [15496, 220, 50256, 995]
    assert np.frombuffer(ENCODER("Hello <|endoftext|> world"), "<u4").tolist() == [15496, 220, 50256, 995]


def test_knapsack_equals_exhaustive_search():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, room = int(rng.integers(1, 5)), int(rng.integers(5, 30))
        size, price = np.sort(rng.choice(np.arange(1, 12), n, replace=False)), rng.random(n)
        best = [0.0] * (room + 1)
        for w in range(1, room + 1):
            best[w] = max([best[w - 1], *[best[w - s] + p for s, p in zip(size, price) if s <= w]])
        value, counts = op.knapsack(price, size, room)
        assert abs(value - best[room]) < 1e-9 and abs((counts * price).sum() - value) < 1e-9 and (counts * size).sum() <= room


def test_short_texts_leave_little_padding(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 4 = 3 THEN '' ELSE 'hello there' END AS text")
    r = op.pack_documents(docs).selectExpr("sum(length) AS tokens", "count(DISTINCT sequence_id) AS n").first()
    assert r.tokens == 15_000 * 3 + 5_000 and r.n * 2048 < 1.02 * r.tokens + 2048


def test_empty_table(spark):
    assert op.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
