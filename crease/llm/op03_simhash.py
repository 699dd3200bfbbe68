"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components.

Fingerprints within ``radius`` bits agree fully in one of ``radius + 1`` blocks of their bits, so
each distinct fingerprint goes to one bucket per block, and only fingerprints of one bucket are compared.
A bucket over ``TILE`` fingerprints is cut into tiles and each pair of tiles is a group of its own, so memory is
bounded and every pair is still compared. In a group the bits lie in planes of 64 fingerprints a
machine word; differing bits are counted for all lanes at once by carry-save adders, and words whose lanes
all exceed the radius are dropped on the way. A group gives a spanning forest of its links, never all
pairs; components are joined over all groups.

Defined results: null and empty texts, and such without words, have fingerprint zero and link like any other; rows are
documents of their own, also where rows repeat; a component whose ids are all null has a null id; an empty
table gives no rows; further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import free_name, table, written
from .components import components

WIDTH, RADIUS, SEED, TILE = 4, 4, 42, 8192
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes counted on whole rectangles before only live words go on.
_FIRST = 24
_RECTANGLE = 1 << 16


def shingle_hashes(text: str | None, width: int = WIDTH) -> list[int]:
    """XXH64 of each run of ``width`` words, A-Z in lower case; of all words if they are fewer."""
    # bytes.lower() changes A-Z only, bytes.split() splits at the six ASCII white space characters.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [h(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[width - 1:])]


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bit i is set if it is set in over half of the shingle hashes; a signed 64-bit number."""
    hashes = np.array(shingle_hashes(text, width), dtype=np.uint64)
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i:i + 4096]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, width: int = WIDTH) -> Column:
    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t, width) for t in s], dtype="int64")
    return fingerprints(text)


def block_of(n_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of ``n_bits`` blocks of nearly equal size."""
    cuts = [64 * i // n_bits for i in range(n_bits + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 rows, row b holding bit b of all fingerprints, 64 a word."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, 64), dtype=np.uint8)
    bits[:len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").reshape(64, words)


def _add(counter: list[np.ndarray], differ: np.ndarray, radius: int) -> None:
    """Add one bit per lane to the bit-sliced counters; the last row collects the lanes beyond ``radius``."""
    carry = differ
    for k in range(len(counter) - 1):
        carry, counter[k] = counter[k] & carry, counter[k] ^ carry
    # Every count from 0 on is seen, so it is enough to catch the first beyond the radius; an overflow is beyond it too.
    beyond = carry
    value = radius + 1
    if value < 1 << (len(counter) - 1):
        hit = _FULL
        for k in range(len(counter) - 1):
            hit = hit & (counter[k] if value >> k & 1 else ~counter[k])
        beyond = beyond | hit
    counter[-1] |= beyond


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int, skip: range = range(0)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of ``left``, of ``right``) within ``radius`` bits; the bits in ``skip`` are known to agree."""
    order = [b for b in range(64) if b not in skip]
    planes = _planes(right)
    n_words = planes.shape[1]
    spare = np.zeros(n_words, dtype=np.uint64)
    if len(right) % 64:
        spare[-1] = _FULL << np.uint64(len(right) % 64)
    width = (radius + 1).bit_length()
    step = max(1, _RECTANGLE // n_words)
    for start in range(0, len(left), step):
        q = left[start:start + step].astype(np.uint64)
        masks = [np.where(q >> np.uint64(b) & np.uint64(1), _FULL, np.uint64(0)) for b in range(64)]
        counter = [np.zeros((len(q), n_words), dtype=np.uint64) for _ in range(width)]
        counter.append(np.broadcast_to(spare, (len(q), n_words)).copy())
        for b in order[:_FIRST]:
            _add(counter, planes[b][None, :] ^ masks[b][:, None], radius)
        rows, words = np.nonzero(counter[-1] != _FULL)
        counter = [c[rows, words] for c in counter]
        for k, b in enumerate(order[_FIRST:]):
            if not len(rows):
                break
            _add(counter, planes[b][words] ^ masks[b][rows], radius)
            if k % 8 == 7:
                live = counter[-1] != _FULL
                rows, words, counter = rows[live], words[live], [c[live] for c in counter]
        if len(rows):
            lanes = np.unpackbits((~counter[-1]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            yield start + rows[at], words[at] * 64 + lane


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]; a label is the smallest index of its set."""
    while True:
        la, lb = label[a], label[b]
        if np.array_equal(la, lb):
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up


def forest(fps: np.ndarray, side: np.ndarray, both: bool, radius: int, skip: range) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) that connect what lies within ``radius``; sides are compared with each other if ``both``."""
    label = np.arange(len(fps))
    left, right = (np.flatnonzero(side), np.flatnonzero(~side)) if both else (label, label)
    if len(left) and len(right):
        for a, b in close_pairs(fps[left], fps[right], radius, skip):
            label = _unite(label, left[a], right[b])
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[child], fps[label[child]]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` (long) as far as pairs within ``radius`` bits do."""
    blocks = block_of(radius + 1)
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1)).cast("int").alias("v"))
                       for k, (a, n) in enumerate(blocks)])
    rows = fps.select("fp", F.inline(values))
    # At most (radius + 1) * 2 ** bits of a block rows: 40,960 for radius 4, whatever the input.
    sizes = rows.groupBy("k", "v").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")).filter("tiles > 1")
    rows = rows.join(F.broadcast(sizes) if sum(1 << n for _, n in blocks) <= 1 << 17 else sizes, ["k", "v"], "left")
    rows = rows.withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       (F.col("own") <= F.col("other")).alias("side"), "fp")
    keys = ["k", "v", "i", "j"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches):
        def edges(run):
            cols = [np.concatenate(c) for c in zip(*run)]
            k, i, j = int(cols[0][0]), int(cols[2][0]), int(cols[3][0])
            first, n = blocks[k]
            a, b = forest(cols[5].view(np.uint64), cols[4], i != j, radius, range(first, first + n))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        run, key = [], None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "side", "fp")]
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                part = [c[s:e] for c in cols]
                this = tuple(int(c[0]) for c in part[:4])
                if this != key and run:
                    if len(run) > 1 or len(run[0][0]) > 1:
                        yield edges(run)
                    run = []
                key = this
                run.append(part)
        if run and (len(run) > 1 or len(run[0][0]) > 1):
            yield edges(run)

    return dealt.mapInArrow(compare, "a long, b long")


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fps`` (fp, ...) with ``root``, the same for all fingerprints that links connect."""
    joined = components(links(fps.select("fp"), radius), "a", "b")
    return (fps.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left")
            .withColumn("root", F.coalesce("root", "fp")))


def dedup(docs: DataFrame, text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One document of each component: that with the smallest doc_id (null last)."""
    fp = free_name(docs, "_fp")
    marked = written(docs.withColumn(fp, fingerprint_column(F.col(text), width)), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "fp"))
    fps = marked.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("doc_id"))
    keep = classes(written(fps, "distinct")).groupBy("root").agg(first.alias("k")).select("k.id", "k.fp")
    on = marked["doc_id"].eqNullSafe(keep["id"]) & (marked[fp] == keep["fp"])
    return marked.join(keep, on, "left_semi").dropDuplicates(["doc_id", fp]).drop(fp)


def op3_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", fingerprint_column(F.col("text")).alias("fp"))
    docs = written(docs, "fingerprints")
    fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    rooted = classes(fps)
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return docs.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
