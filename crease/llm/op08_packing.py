"""Packing token sequences by a cutting-stock linear program with column generation.

A document becomes token ids and one end id, cut into pieces of ``LIMIT`` ids and a rest. Pieces of up to ``EXACT`` ids are classed by
their length, others by their length rounded up to ``UNIT`` ids; only the histogram over these classes, of fixed size, comes to the driver. There a linear program over
patterns (how many pieces of each class share a sequence) is solved: starting from one pattern a class, a knapsack by dynamic
programming over the dual prices gives the next pattern until none pays. Multiplicities are rounded
down, the few pieces left are packed first-fit decreasing, and pieces ranked within their class take the pattern
slots in order.

Defined results: a null or empty text is the end id alone; repeated rows are documents of their own and each is
packed; null ids are kept; the name of an added token of the vocabulary in a text is that token, as the tokenizer has it; short pieces leave
no room unused, however short; an empty table gives no rows; further columns are not carried into pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ranked, table, written

VOCABULARY, END_ID = "byte_bpe_50k.json", 1
LIMIT, UNIT, EXACT = 2048, 16, 64
#: Words whose ids a worker remembers, and the longest such word: bounds its memory, not the result.
WORDS_KEPT, LONGEST_KEPT = 800_000, 64
_ENCODERS: dict[str, "Encoder"] = {}
#: Letters up to U+024F, on whose classes all Unicode versions agree.
_LETTERS = re.compile(r"[^\W\d_\u00B2\u00B3\u00B9\u00BC-\u00BE\u0250-\U0010FFFF]+").fullmatch
#: The sign by which a byte-level vocabulary writes each byte: itself if visible in Latin-1, else the next from U+0100 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_SIGNS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def _packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers; for a few ids much quicker than an array."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Known(dict):
    """Ids of words, each after ``before`` (a space or nothing), found when first asked for.

    Three kinds of words need no pre-tokenizer, as what it does to them is plain: letters alone are one
    pre-token; a comma or full stop after letters, and a single line feed between visible characters, are pre-tokens of their own.
    """

    def __init__(self, tokenizer, before: str):
        super().__init__()
        self.tokenizer, self.model, self.before, self.start = tokenizer, tokenizer.model, before, self
        self.mark = {c: self.whole(c) for c in ",.\n"}

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST_KEPT:
            return self.whole(self.before + word)
        head, feed, tail = word.partition("\n")
        if feed and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self.mark[feed] + self.start[tail]
        if _LETTERS(word):
            units = (self.before + word).encode().decode("latin-1").translate(_BYTE_SIGNS)
            ids = _packed([t.id for t in self.model.tokenize(units)])
        elif word[-1:] in (",", ".") and _LETTERS(word[:-1]):
            ids = self[word[:-1]] + self.mark[word[-1]]
        else:
            ids = self.whole(self.before + word)
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers.

    A pre-token of this byte-level vocabulary starts at a space or never holds one, except
    among consecutive spaces. So a text without such runs is the concatenation of its words, each with
    the space before it, and ids of words are remembered; other texts, and those that name an added token, are encoded in one go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        #: Texts of added tokens, which are found before all else.
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.known, self.start = _Known(tokenizer, " "), _Known(tokenizer, "")
        self.known.start = self.start

    def __call__(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if "" in words or not first or any(t in text for t in self.added):
            return self.start.whole(text)
        return self.start[first] + b"".join(map(self.known.__getitem__, words))


def _encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their ids (little-endian 32-bit) if asked for.

    ``vocabulary`` is the path of the tokenizer file on the executors; by default that of the installed package.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches):
        encode = _encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = (encode(text.as_py()) if text.is_valid else b"") + end
                n, doc_id = len(ids) // 4, doc_id.as_py()
                for start in range(0, n, limit):
                    part = ids[4 * start:4 * (start + limit)]
                    for column, value in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), n, part)):
                        column.append(value)
                    size += len(part) if with_ids else 40
                if size > 1 << 24:
                    yield _batch(out, names)
                    out, size = [[] for _ in names], 0
            yield _batch(out, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def _batch(columns: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names)], names)


def knapsack(price: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest pattern that fits into ``room``, and its price; any number of each class.

    Dynamic programming over the room, class by class; of each class 1, 2, 4, ... pieces are offered, which make up any number.
    """
    best, offers = np.zeros(room + 1), []
    for c in np.argsort(-price / size):
        n = 1
        while n * size[c] <= room and price[c] > 0:
            width = n * size[c]
            with_it = best[:-width] + n * price[c]
            better = with_it > best[width:] + 1e-12
            if better.any():
                best[width:][better] = with_it[better]
                offers.append((c, n, width, better))
            n *= 2
    counts, w = np.zeros(len(size)), room
    for c, n, width, better in reversed(offers):
        if w >= width and better[w - width]:
            counts[c] += n
            w -= width
    return float(best[room]), counts


def solve(size: np.ndarray, need: np.ndarray, room: int, gap: float = 1e-4, rounds: int = 20_000, calm: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Basic optimal solution of: minimise sum(x), patterns @ x = need, x >= 0. Columns of ``patterns`` are patterns.

    Revised simplex whose entering column is the knapsack's. Prices swing from round to round, so the knapsack is given a mean of them
    and of the prices with the best bound so far (weight ``calm``), or the prices alone where its pattern does not pay. Prices divided by the
    dearest pattern's are a bound: it stops within ``gap`` of the best one. Each basis covers the need exactly: stopping
    early, also after ``rounds``, costs some padding, never a piece.
    """
    basis = np.diag((room // size).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x, bound, best = need / np.diag(basis), 0.0, None
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        for tried in (price,) if best is None else (calm * best + (1 - calm) * price, price):
            value, column = knapsack(tried, size, room)
            if need @ tried > bound * value:
                bound, best = float(need @ tried) / value, tried / value
            if price @ column > 1 + 1e-9:
                break
        if x.sum() <= bound * (1 + gap) or price @ column <= 1 + 1e-9:
            break
        step = inverse @ column
        up = step > 1e-9
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out] if np.isfinite(ratio[out]) else 0
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return basis, x


def first_fit(size: np.ndarray, left: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that take all of ``left``, largest classes first."""
    left, found = left.copy(), []
    order = np.argsort(-size)
    while left.any():
        pattern, free = np.zeros(len(size), dtype=np.int64), room
        for c in order:
            pattern[c] = min(left[c], free // size[c])
            free -= pattern[c] * size[c]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= times * pattern
        found.append((times, pattern))
    return found


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, pieces a sequence, first sequence, sequences) that place every piece once."""
    size = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[c] for c in size], dtype=np.int64)
    if not len(size):
        return []
    patterns, x = solve(size, need.astype(float), room)
    chosen, left = [], need.copy()
    for k in np.argsort(-x):
        pattern = patterns[:, k].astype(np.int64)
        used = pattern > 0
        # A little over, against rounding errors of the solution, but never more than is there.
        times = min(int(x[k] + 1e-6), int((left[used] // pattern[used]).min()))
        if times > 0:
            left -= times * pattern
            chosen.append((times, pattern))
    rows, rank, sequence = [], np.zeros(len(size), dtype=np.int64), 0
    for times, pattern in chosen + first_fit(size, left, room):
        for c in np.flatnonzero(pattern):
            end = rank[c] + times * pattern[c]
            rows.append((int(size[c]), int(rank[c]), int(end), int(pattern[c]), sequence, times))
            rank[c] = end
        sequence += times
    return rows


def class_of(length: Column, unit: int = UNIT, exact: int = EXACT) -> Column:
    """The room a piece is given: its length, rounded up to ``unit`` beyond ``exact``."""
    return F.when(length <= exact, length).otherwise(F.ceil(length / unit) * unit).cast("int")


def pack(cut: DataFrame, limit: int = LIMIT, unit: int = UNIT, exact: int = EXACT) -> DataFrame:
    """``cut`` with sequence_id (gapless from 0) and offset (gapless from 0 within the sequence)."""
    spark = cut.sparkSession
    classed = cut.withColumn("_class", F.least(class_of(F.col("length"), unit, exact), F.lit(limit)))
    histogram = {r[0]: r[1] for r in classed.groupBy("_class").count().collect()}  # at most exact + limit / unit rows
    slots = spark.createDataFrame(plan(histogram, limit),
                                  "_class int, _from long, _to long, _each long, _first long, _times long")
    at = ranked(classed, ["_class"], ["doc_id", "start", "ids_crc32"], "_rank")
    # As many rows as patterns have classes: their number depends on the number of classes, not on the input.
    placed = at.join(F.broadcast(slots), (at["_class"] == slots["_class"]) & (F.col("_rank") >= F.col("_from"))
                     & (F.col("_rank") < F.col("_to"))).drop(slots["_class"])
    # Neighbouring ranks of equal length differ little, so slots of one sequence take distant ranks.
    placed = placed.withColumn("sequence_id", F.col("_first") + F.pmod(F.col("_rank") - F.col("_from"), "_times"))
    before = (Window.partitionBy("sequence_id").orderBy(F.col("_class").desc(), "_rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(
        *cut.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(written(pieces(docs, vocabulary, with_ids=with_ids), "pieces"))


def op8_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
