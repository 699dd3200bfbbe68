"""Toxicity by a bag of subwords: n-gram embeddings, averaged over a text, into a linear softmax.

Every word gives its runs of 3 to 6 bytes, edges included, hashed to ``2 ** BITS`` rows of an embedding table; a misspelling shares
most of them with the word it comes from. Embeddings and softmax are trained jointly in numpy by Adagrad on a bounded sample
of labelled documents. As all of it is linear up to the softmax, a trained model is one number per row, so texts
are scored whole, in one pass, by array operations.

Parameters: ``SAMPLE`` labelled documents at most, those lowest by hash of the id and one row of each, train the model; everything else
covers all rows.

Defined results: null, empty and wordless texts have the score of the bias alone; labels of one document that differ count as toxic; null labels and labels of null
or unknown ids are ignored; of rows with one id the lowest text trains; without labels of both kinds each score is the share of toxic ones (0 without any); repeated documents are
scored alike; a null doc_id is not held out; an empty table gives no rows; further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

BITS, LENGTHS, DIM, RATE, EPOCHS, SAMPLE, FOLDS = 18, (3, 4, 5, 6), 4, 2.0, 6, 5000, 5
#: Bytes hashed at once, which bounds the memory for very long texts.
STEP = 1 << 20


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Rows of the n-grams of all words of ``text``, repeats included."""
    body = f" {' '.join((text or '').lower().split())} ".encode("utf-8", "replace")
    longest = max(LENGTHS)
    for start in range(0, max(1, len(body) - 2), STEP):
        b = np.frombuffer(body[start:start + STEP + longest - 1], dtype=np.uint8)
        spaces = np.concatenate([[0], np.cumsum(b == 32)])
        b = b.astype(np.uint64)
        for n in LENGTHS:
            m = min(len(b) - n + 1, STEP)
            if m <= 0:
                continue
            h = np.zeros(m, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(1_000_003) ^ b[k:k + m]
            h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
            # A space only at either end: the n-gram lies within one word and its edges.
            yield h[spaces[n - 1:n - 1 + m] == spaces[1:1 + m]].astype(np.int64)


@dataclass
class Model:
    """Score of a text: logistic of ``bias`` plus the mean of ``weight`` over its n-grams."""
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for g in grams(text):
            total += float(self.weight[g].sum(dtype=np.float64))
            n += len(g)
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(texts: list[str], toxic: list[int], dim: int = DIM, rate: float = RATE, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Embeddings (rows x dim) and softmax (dim x 2), by Adagrad with one document a step."""
    labels = np.asarray(toxic, dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(1 << BITS, dtype=np.float32), 60.0 if share else -60.0)
    bags = []
    for t in texts:
        parts = list(grams(t))
        rows, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
        bags.append((rows.astype(np.int32), (counts / max(counts.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    e = ((rng.random((1 << BITS, dim)) - 0.5) / dim).astype(np.float32)
    e_sum = np.full(1 << BITS, 1e-8, dtype=np.float32)
    w, w_sum = np.zeros((dim, 2)), 1e-8
    bias = np.log([1 - share, share])
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            rows, x = bags[i]
            mine = e[rows]
            v = x @ mine
            z = v @ w + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = w @ error
            step = np.outer(v, error)
            w_sum += float((step ** 2).mean())
            w = w - rate * step / np.sqrt(w_sum)
            bias = bias - 0.1 * rate * error
            grad = np.outer(x, back).astype(np.float32)
            e_sum[rows] += (grad ** 2).mean(axis=1)
            e[rows] = mine - rate * grad / np.sqrt(e_sum[rows])[:, None]
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents (doc_id, text) outside the held-out fold."""
    chosen = (labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # Known ids only, before the limit; the limit bounds what is broadcast and collected.
    chosen = chosen.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # One row an id, by partial aggregation, however often the id is repeated.
    first = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(first.collect(), key=lambda r: (r.doc_id, r.text or ""))
    return train([r.text for r in rows], [int(r.toxic) for r in rows])


def score_column(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([model.score(t) for t in s], dtype="float64")
    return score(text)


def op9_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out mark, score and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                         score_column(F.col("text"), model).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
