"""MinHash near-duplicates with tensored banding, every link confirmed on full sets.

A document is the set of its 3-word shingles, as 64-bit hashes. Two collections of ``HALVES`` half keys are made, each half key of
``ROWS`` minhashes; a table key joins one half key of either collection, so ``HALVES ** 2`` tables of ``2 * ROWS``
minhashes cost ``2 * HALVES * ROWS`` minhashes instead of ``2 * HALVES ** 2 * ROWS``. Documents at Jaccard 0.85 share a
table with a probability of 0.9999. Half keys that only one set has are dropped before pairs are formed.

Equal sets are one representative. A representative is first compared with the smallest and the largest one it meets in
its tables, which links groups of copies by stars. Tables that this leaves in several components are resolved without loss: two sets of
Jaccard 0.85 share one of the ``floor(0.15 n) + 1`` rarest shingles of either, in any common order; ordered by how many
of these sets hold them, what a template or a shared passage puts into many sets drops out. Sets that share such a shingle are compared if
in different components: first all with the shingle's most typical set, then those whose shingle stands so early in both that they can
still be similar, a bound that is part of the join.

Defined results: null and empty texts, and such without a word, have an empty set, link with nothing and are their own component; rows are
documents of their own, also where rows or doc_ids repeat; null doc_ids count only where a component has no other, whose id is
then null (kept is true where doc_id and component_id are the same, null included); an empty table gives no rows; other columns take no part. Shingles
are told apart by 64-bit hashes, sets by 128 bits of a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, thinned, written
from .components import components

WIDTH, HALVES, ROWS = 3, 11, 3
#: Similarity at which documents link, in hundredths.
SIMILAR = 85
#: In a larger group that shares a rare shingle, sets are compared with the most typical one first.
SMALL = 32
#: Bits of the table that counts shingles to order them: 2 ** BITS numbers, whatever the input.
BITS = 18
#: Words whose hashes a worker remembers; characters hashed at a time.
WORDS_KEPT, CHUNK = 250_000, 1 << 20


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Hashes()


def _fixed_numbers(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers by the splitmix sequence."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return _mixed(x) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words, A-Z in lower case, in order."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    # bytes.lower() changes A-Z only, bytes.split() splits at the six ASCII white space characters.
    data = text.encode("utf-8", "surrogatepass").lower()
    parts, start = [], 0
    while start < len(data):
        end = start + CHUNK
        # Up to the next white space, so that no word is cut.
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = data[start:end].split()
        parts.append(np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words)))
        start = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the runs of ``width`` words, ascending; one of all words if they are fewer."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(width, len(words))
    # Differs by the number of words, so a short text is no shingle of a longer one.
    factors = _fixed_numbers(n, n)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total += words[k:len(words) - n + 1 + k] * factors[k]
    return np.unique(_mixed(total))


def half_keys(shingles: np.ndarray, halves: int = HALVES, rows: int = ROWS) -> np.ndarray:
    """2 * halves half keys: those of the first collection, then of the second."""
    factors = _fixed_numbers(2 * halves * rows, 1)[:, None]
    shifts = _fixed_numbers(2 * halves * rows, 2)[:, None]
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        block = (shingles[None, i:i + 4096] ^ shifts) * factors
        np.minimum(least, block.min(axis=1), out=least)
    keys = np.arange(2 * halves, dtype=np.uint64)
    for r in range(rows):
        keys = _mixed(keys ^ least[r::rows] * np.uint64(0xD1342543DE82EF95))
    return keys


def _texts(docs: DataFrame) -> DataFrame:
    """``docs`` with (t1, t2), two hashes that name the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")


def sketched(docs: DataFrame, width: int = WIDTH, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """(doc_id, t1, t2, n, k1, k2, halves): k1 and k2, null for an empty set, are the set's digest. The set itself is not kept."""
    schema = "doc_id long, t1 long, t2 long, n long, k1 long, k2 long, halves array<long>"

    def sketch(batches):
        for batch in batches:
            made = []
            for text in batch.column(3):
                s = shingle_set(text.as_py(), width)
                k = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8").tolist() if len(s) else (None, None)
                made.append((len(s), *k, half_keys(s, halves, rows) if len(s) else s))
            n, k1, k2, found = zip(*made) if made else ((),) * 4
            longs = [pa.array(c, pa.int64()) for c in (n, k1, k2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *longs, _lists(found)], ["doc_id", "t1", "t2", "n", "k1", "k2", "halves"])

    return written(_texts(docs).mapInArrow(sketch, schema), "sketches")


def _lists(arrays: Sequence[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if len(arrays) else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def sets_of(docs: DataFrame, reps: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rep, shingles) of the representatives (rep, t1, t2), made again from the whole texts they name."""
    texts = thinned(_texts(docs).drop("doc_id"), "t1", reps.select("t1")).groupBy("t1", "t2").agg(F.min("text").alias("text"))

    def shingle(batches):
        for batch in batches:
            reps_, made, size = batch.column(0), [], 0
            first = 0
            for i, text in enumerate(batch.column(1)):
                made.append(shingle_set(text.as_py(), width))
                size += len(made[-1])
                if size > 1 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([reps_[first:i + 1], _lists(made)], ["rep", "shingles"])
                    first, made, size = i + 1, [], 0

    return texts.join(reps, ["t1", "t2"]).select("rep", "text").mapInArrow(shingle, "rep long, shingles array<long>")


def tables_of(reps: DataFrame, halves: int = HALVES) -> DataFrame:
    """(key, rep): the table keys of the representatives, from half keys that two sets or more have."""
    each = reps.select("rep", F.posexplode("halves").alias("at", "half"))
    common = written(each.groupBy("half").count().filter("count > 1").select("half"), "halves")
    met = thinned(each, "half", common).join(common, "half", "left_semi")
    first = F.col("at") < halves
    sides = met.groupBy("rep").agg(F.collect_set(F.when(first, F.col("half"))).alias("x"), F.collect_set(F.when(~first, F.col("half"))).alias("y"))
    return sides.select("rep", F.explode("x").alias("x"), "y").select("rep", "x", F.explode("y").alias("y")).select(
        F.xxhash64("x", "y").alias("key"), "rep")


def _pairs(met: DataFrame, one: str, other: str) -> DataFrame:
    return met.filter(F.col(one) != F.col(other)).select(F.greatest(one, other).alias("a"), F.least(one, other).alias("b")).distinct()


def _alike(a: Column, b: Column, similar: int) -> Column:
    """Whether two arrays of distinct numbers have a Jaccard similarity of ``similar`` hundredths or more."""
    common, both = F.size(F.array_intersect(a, b)).cast("long"), (F.size(a) + F.size(b)).cast("long")
    return common * (100 + similar) >= both * similar


def verified(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    sizes = lambda one, two: F.size(one) * 100 >= F.size(two) * similar
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.filter(sizes("sa", "sb") & sizes("sb", "sa") & _alike(F.col("sa"), F.col("sb"), similar)).select("a", "b")


def _rooted(members: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``members`` (key, rep, ...) of the keys whose members are in several components, with their root."""
    named = roots.select(F.col("node").alias("rep"), "root")
    rooted = written(members.join(named, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "rooted")
    several = rooted.groupBy(key).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n")).filter("r0 <> r1")
    several = several.select(key, "n")
    return written(thinned(rooted, key, several.select(key)).join(several, key), "unresolved")


def frequencies(sets: DataFrame, bits: int = BITS) -> np.ndarray:
    """Shingles by the last ``bits`` bits of their hash: 2 ** bits counts, the only thing the driver gets."""
    slot = F.pmod(F.col("s"), F.lit(1 << bits)).cast("int")
    rows = sets.select(F.explode("shingles").alias("s")).groupBy(slot.alias("slot")).count().collect()
    counts = np.zeros(1 << bits, dtype=np.int64)
    for slot_, n in rows:
        counts[slot_] = n
    return counts


def rarest(sets: DataFrame, counts, similar: int) -> DataFrame:
    """(rep, size, shingle, place, typical): of each set the rarest shingles, with their places in the common order.

    Every similar set has one of those listed. ``typical`` is the set's mean logarithm of frequency.
    """
    def cut(batches):
        freq = counts.value
        for batch in batches:
            reps, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            out, size = [], 0
            for i, rep in enumerate(reps):
                s = lists[i].values.to_numpy(zero_copy_only=False)
                n = freq[s & (len(freq) - 1)]
                # A similar set shares at least ceil(similar * n) of them, so one of these.
                few = len(s) - -(-similar * len(s) // 100) + 1
                out.append((rep, len(s), s[np.lexsort((s, n))[:few]], float(np.log1p(n).mean())))
                size += few
                if size > 1 << 18:
                    yield _rare_batch(out)
                    out, size = [], 0
            yield _rare_batch(out)

    return sets.select("rep", "shingles").mapInArrow(cut, "rep long, size long, shingle long, place long, typical double")


def _rare_batch(rows: list[tuple]) -> pa.RecordBatch:
    sizes = [len(r[2]) for r in rows]
    many = lambda i, kind: np.repeat(np.array([r[i] for r in rows], dtype=kind), sizes)
    join = lambda arrays: np.concatenate(arrays).astype(np.int64) if arrays else np.zeros(0, dtype=np.int64)
    columns = [many(0, np.int64), many(1, np.int64), join([r[2] for r in rows]), join([np.arange(n) for n in sizes]), many(3, np.float64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "size", "shingle", "place", "typical"])


def by_rarest(rare: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that may be similar, from (shingle, rep, root, size, place).

    Similar sets x and y share ``s / (1 + s) * (|x| + |y|)`` shingles or more. Their first common shingle in the order has all others
    behind it in both, which bounds the places it may have; of the smaller set only shingles up to a place half as far are needed.
    The bound is part of the join, so what shares a template only never leaves it.
    """
    cols = ["shingle", "rep", "root", "size", "place"]
    x = rare.select(*cols).alias("x")
    y = rare.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * (2 * similar) / (100 + similar) - 1e-6)).select(*cols).alias("y")
    smaller_first = (F.col("y.size") < F.col("x.size")) | ((F.col("y.size") == F.col("x.size")) & (F.col("y.rep") < F.col("x.rep")))
    left = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & smaller_first
                 & (left * (100 + similar) >= (F.col("x.size") + F.col("y.size")) * similar))
    return _pairs(met.select(F.col("x.rep").alias("one"), F.col("y.rep").alias("other")), "one", "other")


def linked(reps: DataFrame, docs: DataFrame, width: int = WIDTH, halves: int = HALVES, similar: int = SIMILAR,
           small: int = SMALL) -> DataFrame:
    """(node, root) of the representatives (rep, t1, t2, halves) that are similar to another one."""
    spark = reps.sparkSession
    banded = written(tables_of(reps, halves), "tables")
    shared = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high")
    shared = written(shared, "buckets")
    members = written(thinned(banded, "key", shared.select("key")).join(shared, "key"), "members")
    stars = members.groupBy("rep").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    stars = written(_pairs(stars.select("rep", F.explode(F.array("low", "high")).alias("other")), "rep", "other"), "pairs")
    wanted = written(reps.select("rep", "t1", "t2").join(members.select("rep").distinct(), "rep", "left_semi"), "wanted")
    sets = written(sets_of(docs, wanted, width), "sets")
    links = written(verified(stars, sets, similar), "links")
    roots = written(components(links, "a", "b"), "roots")
    rest = _rooted(members.select("key", "rep"), roots, "key").select("rep").distinct()
    rest = written(sets.join(rest, "rep", "left_semi"), "rest")
    if rest.isEmpty():
        return roots
    counts = spark.sparkContext.broadcast(frequencies(rest))
    rare = _rooted(written(rarest(rest, counts, similar), "rare"), roots, "shingle")
    # Where a template's sets are all alike, the most typical of them is similar to most.
    typical = rare.filter(F.col("n") > small).groupBy("shingle").agg(F.max(F.struct("typical", "rep", "root")).alias("hub"))
    met = rare.join(typical, "shingle").filter("root <> hub.root").groupBy("rep").agg(F.max("hub").alias("hub"))
    links = links.unionByName(written(verified(_pairs(met.select("rep", F.col("hub.rep").alias("other")), "rep", "other"), rest, similar), "links"))
    roots = written(components(links, "a", "b"), "roots")
    rare = _rooted(rare.drop("root", "n"), roots, "shingle")
    more = verified(written(by_rarest(rare, similar), "pairs"), rest, similar)
    return written(components(links.unionByName(written(more, "links")), "a", "b"), "roots")


def near_duplicates(docs: DataFrame, width: int = WIDTH, halves: int = HALVES, rows: int = ROWS, similar: int = SIMILAR,
                    small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    sketches = sketched(docs, width, halves, rows)
    # Equal sets have equal half keys. One of their texts stands for all.
    one = F.min(F.struct("t1", "t2")).alias("t")
    equal = sketches.filter(F.col("k1").isNotNull()).groupBy("k1", "k2", "halves").agg(one, F.min("doc_id").alias("least"))
    equal = written(equal.select("k1", "k2", "halves", "t.t1", "t.t2", "least", F.monotonically_increasing_id().alias("rep")), "equal")
    roots = linked(equal.select("rep", "t1", "t2", "halves"), docs, width, halves, similar, small)
    rooted = equal.select("k1", "k2", "rep", "least").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    rooted = written(rooted.withColumn("root", F.coalesce("root", "rep")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(ids, "root").select("k1", "k2", "component_id")
    own = sketches.select("doc_id", "n", "k1", "k2")
    found = own.filter(F.col("k1").isNotNull()).join(ids, ["k1", "k2"]).select("doc_id", "n", "component_id")
    alone = own.filter(F.col("k1").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                           F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
