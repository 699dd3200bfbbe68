"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives each vector a long string of bits, the sides of random hyperplanes on which it lies, and keeps the strings
as a sorted array. A query descends in every tree to its longest matching prefixes, then ascends in all trees at once,
one bit a step, until the rows sharing a prefix of that length in some tree are enough candidates. Candidates are scored
exactly. Inner products become angles by one further component that brings all vectors to the largest norm.

Rows are dealt over blocks of about ``BLOCK`` by hash, queries over tiles; each block holds a forest of its own rows with
the same hyperplanes, and each tile visits each block. So no vector or region, however common, makes one task
larger. The given vectors point in nearly all directions alike, so that neighbours share short prefixes only: with 32 trees a recall of 0.9 takes
about half of the rows as candidates, which ``ENOUGH`` asks for.

Defined results: vectors that are null, zero, or hold nulls or non-finite numbers, or whose length is not the most common one (the
larger on a tie), and rows without an id, take no part; rows that repeat an id are rows of their own, and each is a candidate
for the other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table

TREES, BITS, ENOUGH, BLOCK, TILE, SEED = 32, 30, 0.6, 16_384, 2_048, 7


def usable(vector: Column) -> Column:
    limit = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < limit), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def hyperplanes(dim: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, bits, dim))


def strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One number per tree and vector, the first bit of the string in front."""
    bits = planes.shape[1]
    place = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
    return np.stack([((vectors @ tree.T) > 0) @ place for tree in planes])


class Forest:
    """Sorted strings of a block's rows, per tree."""

    def __init__(self, vectors: np.ndarray, planes: np.ndarray):
        self.planes, self.bits, self.n = planes, planes.shape[1], len(vectors)
        codes = strings(vectors, planes)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def _ranges(self, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query, where the strings start and end that share ``depth`` bits with the query's."""
        rest = self.bits - depth
        low = wanted >> rest << rest
        first = np.stack([np.searchsorted(c, l) for c, l in zip(self.codes, low)])
        return first, np.stack([np.searchsorted(c, l) for c, l in zip(self.codes, low + (1 << rest))])

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the rows found once the ascent has at least ``enough`` of them, or all rows."""
        wanted = strings(queries, self.planes)
        levels = [self._ranges(wanted, 0)]
        # Rows counted once per tree bound the different rows from above, so no deeper level can be enough.
        deepest = np.zeros(len(queries), dtype=int)
        for depth in range(1, self.bits + 1):
            first, end = self._ranges(wanted, depth)
            found = (end - first).sum(axis=0) >= enough
            if not found.any():
                break
            deepest[found] = depth
            levels.append((first, end))
        for q in range(len(queries)):
            for depth in range(deepest[q], -1, -1):
                first, end = levels[depth]
                seen = np.zeros(self.n, dtype=bool)
                for t in range(len(self.order)):
                    seen[self.order[t, first[t, q]:end[t, q]]] = True
                rows = np.flatnonzero(seen)
                if len(rows) >= enough:
                    break
            yield rows


def nearest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` best, best first, ties to the smaller id."""
    rows = np.arange(len(score))
    if len(score) > k:
        rows = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return rows[np.lexsort((ids[rows], -score[rows]))][:k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def search(rows: DataFrame, query: Column, k: int, trees: int = TREES, bits: int = BITS, enough: float = ENOUGH,
           block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each row that ``query`` marks.

    ``rows`` has vec_id and embedding. ``enough`` is the share of a block's rows a query takes as candidates.
    """
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), query.alias("asks"))
    v = v.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("row", F.monotonically_increasing_id())
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = (v.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max(norm).alias("top"))
             .orderBy(F.desc("n"), F.desc("dim")).first())
    if sizes is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, top = sizes["dim"], sizes["top"]
    blocks, tiles = math.ceil(sizes["n"] / block), max(1, math.ceil(sizes["q"] / tile))
    v = v.filter(F.size("v") == dim)
    spread = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    mine = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    held = v.select(mine(blocks, 1).alias("block"), F.explode(spread(tiles)).alias("tile"), "row", "vec_id", "v")
    asked = v.filter("asks").select(F.explode(spread(blocks)).alias("block"), mine(tiles, 2).alias("tile"), "row", "vec_id", "v")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"row": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            x, q = _matrix(left["v"]), _matrix(right["v"])
            ids, own = left["vec_id"].to_numpy(), left["row"].to_numpy()
            lift = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
            forest = Forest(np.column_stack([x, lift]), hyperplanes(dim + 1, trees, bits))
            found = forest.candidates(np.column_stack([q, np.zeros(len(q))]), min(len(x), math.ceil(enough * len(x)) + k))
            for one, row, query_id, at in zip(q, right["row"].to_pylist(), right["vec_id"].to_pylist(), found):
                at = at[own[at] != row]
                # Row by row in one order, so that equal vectors get equal scores.
                score = (x[at] * one).sum(axis=1)
                best = nearest(score, ids[at], k)
                out["row"] += [row] * len(best)
                out["query_id"] += [query_id] * len(best)
                out["vec_id"] += ids[at[best]].tolist()
                out["score"] += score[best].tolist()
        return pa.table({c: pa.array(x, pa.float64() if c == "score" else pa.int64()) for c, x in out.items()})

    hits = (held.groupBy("block", "tile").cogroup(asked.groupBy("block", "tile"))
            .applyInArrow(find, "row long, query_id long, vec_id long, score double"))
    # At most k rows from each block for a query.
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
