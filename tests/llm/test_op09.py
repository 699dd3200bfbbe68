"""op9: n-grams by definition, misspellings, held-out accuracy, odd rows."""

import random

import numpy as np

from crease.llm import op09_toxicity as op


def test_grams_are_runs_within_words(monkeypatch):
    text = "Ab  ünd\tlonger wörd"
    whole = sorted(np.concatenate(list(op.grams(text))).tolist())
    padded = [f" {w} ".encode() for w in text.lower().split()]
    assert len(whole) == sum(max(0, len(p) - n + 1) for p in padded for n in op.LENGTHS)
    monkeypatch.setattr(op, "STEP", 7)
    assert sorted(np.concatenate(list(op.grams(text))).tolist()) == whole
    assert all(not len(g) for x in (None, "", " \n") for g in op.grams(x))


def test_unseen_misspellings():
    rng = random.Random(1)
    plain = ["the", "house", "river", "walked", "morning", "quiet", "paper", "lantern"]
    def doc(bad):
        return " ".join(rng.choice(plain) for _ in range(40)) + (" " + " ".join(bad) if bad else "")
    texts = [doc(["horrible", "monster"]) if i % 2 else doc([]) for i in range(200)]
    m = op.train(texts, [i % 2 for i in range(200)])
    assert m.score(doc(["horribble", "monsster"])) > 0.5 > m.score(doc([]))
    assert m.score(None) == m.score("") and 0 <= m.score("") <= 1


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op.op9_subword_softmax(spark, path).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    held = [(got[d].score, y) for d, y in labels.items() if got[d].held_out]
    good, bad = [s for s, y in held if y == 0], [s for s, y in held if y == 1]
    auc = np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad])
    assert auc > 0.88 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.92


def plain_rows(text):
    """The table rows of a text's n-grams, one Python number at a time."""
    found = []
    for word in (text or "").lower().split():
        body = f" {word} ".encode()
        for n in op.LENGTHS:
            for i in range(len(body) - n + 1):
                h = 0
                for byte in body[i:i + n]:
                    h = (h * 1_000_003 ^ byte) % 2**64
                found.append((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 64 - op.BITS)
    return found


def test_scores_equal_plain_computation(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["vile", "nasty", "Größe", "calm", "tree", "a"]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    model = op.train(texts, [int("vile" in t) for t in texts])
    df = spark.createDataFrame(list(enumerate([*texts, None, "", "unseen vlie"])), "i int, text string")
    for r in df.select("text", op.score_column(df.text, model).alias("score")).collect():
        at = plain_rows(r.text)
        z = model.bias + (sum(float(model.weight[k]) for k in at) / len(at) if at else 0.0)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6


def test_training_equals_plain_adagrad():
    """The joint gradient steps, written out element by element."""
    texts, toxic = ["bad bad one", "good one", "bad", "fine day one"], [1, 0, 1, 0]
    got = op.train(texts, toxic, dim=2, rate=0.5, epochs=3, seed=7)
    rng = np.random.default_rng(7)
    e = ((rng.random((1 << op.BITS, 2)) - 0.5) / 2).astype(np.float32)
    sums, w, w_sum, bias = {}, [[0.0, 0.0], [0.0, 0.0]], 1e-8, [np.log(0.5), np.log(0.5)]
    for _ in range(3):
        for i in rng.permutation(4):
            at = plain_rows(texts[i])
            bag = {k: at.count(k) / len(at) for k in at}
            v = [sum(x * float(e[k][d]) for k, x in bag.items()) for d in range(2)]
            z = [sum(v[d] * w[d][c] for d in range(2)) + bias[c] for c in range(2)]
            p = [np.exp(x) / sum(map(np.exp, z)) for x in z]
            error = [p[c] - (toxic[i] == c) for c in range(2)]
            back = [sum(w[d][c] * error[c] for c in range(2)) for d in range(2)]
            w_sum += sum((v[d] * error[c]) ** 2 for d in range(2) for c in range(2)) / 4
            w = [[w[d][c] - 0.5 * v[d] * error[c] / w_sum ** 0.5 for c in range(2)] for d in range(2)]
            bias = [bias[c] - 0.05 * error[c] for c in range(2)]
            for k, x in bag.items():
                sums[k] = sums.get(k, 1e-8) + sum((x * b) ** 2 for b in back) / 2
                e[k] = [float(e[k][d]) - 0.5 * x * back[d] / sums[k] ** 0.5 for d in range(2)]
    for k in {k for t in texts for k in plain_rows(t)}:
        assert abs(got.weight[k] - sum(e[k][d] * (w[d][1] - w[d][0]) for d in range(2))) < 1e-3
    assert abs(got.bias - (bias[1] - bias[0])) < 1e-4


def test_sample_bounds_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(k, "repeated") for k in range(40) for _ in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    real, op.train = op.train, lambda texts, toxic: seen.append(len(texts)) or real(texts, toxic)
    try:
        op.fit(docs, labels, sample=2)
    finally:
        op.train = real
    assert seen == [2]


def test_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, None), (1, None), (None, "x"), (2, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = op.op9_subword_softmax(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(r.predicted == 0 and 0 <= r.score < 1e-6 for r in got)
