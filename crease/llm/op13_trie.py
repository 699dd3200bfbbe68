"""Prefix trie of conversations by time-forward processing.

Every distinct sequence of first turns is a node. A node's key is its depth and the XOR of two 64-bit hashes of (place, role, text) over
its turns, so keys are running totals that need neither a walk along a conversation nor its texts.

Subtree totals are passed upwards by time-forward processing. The trie is cut into bands of ``BAND`` depths, and a band
into shards of subtrees of about ``SHARD`` nodes; a larger subtree is dealt over several shards by conversation, whose totals for shared nodes
are added. Within a shard Spark's external sort brings the nodes in reverse level order, and a priority queue, which
spills sorted runs beyond ``QUEUE`` messages, holds what nodes send to parents not yet reached. Then the shard roots, one a band,
form a trie that is ``BAND`` times less deep and is processed alike, tier by tier; what their subtrees hold goes
back to the parents in a last pass.

Defined results: rows with a null conv_id take no part; null roles and texts are empty; rows of equal turn stand in order of the hash of role
and text, so repeated rows are turns of their own; ``c - c % 100`` truncates towards zero as in SQL, so negative ids share
conversations above them; an empty table gives no nodes; extra columns take no part. The hashes of two different prefixes agree with probability 2**-128.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ordered, table, written

#: Turns of a conversation whose place another conversation takes: fewer than SHARED; ids share by hundreds.
SHARED, HUNDRED = 6, 100
#: Depths of a band, nodes of a shard, messages a queue holds in memory, ids in one piece of a list of members.
BAND, SHARD, QUEUE, PIECE = 64, 512, 100_000, 4096
#: Bands whose running hashes are added up in one window.
RUN = 1024
KEY = ["depth", "a", "b"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, place, n, s, t, chars): the turns in order from place 0, with two hashes of role and text and the text's code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("s"),
        F.xxhash64(F.lit("second"), role, text).alias("t"), F.char_length(text).cast("long").alias("chars"))
    placed = ordered(written(rows, "turns"), ["conv"], ["turn", "s", "t"], "place", "n")
    return written(placed.select("conv", "place", "n", "s", "t", "chars"), "turns")


def rebuilt(turns: DataFrame, base: Column, first: Column) -> tuple[DataFrame, DataFrame]:
    """(conv, place, s, t, chars) after conversations took the first turns of others, and (conv, n): all conversations' lengths.

    ``base`` is the conversation whose first turns ``conv`` takes and is its own base, ``first`` how many at most (below ``SHARED``).
    """
    convs = turns.groupBy("conv").agg(F.max("n").alias("own")).select("conv", "own", base.alias("base"), first.alias("first"))
    convs = written(convs, "conversations")
    sizes = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_n"))
    # A conversation serves those of its hundred only.
    convs = convs.join(sizes, "base", "left").withColumn("taken", F.least("first", F.coalesce("base_n", F.lit(0))).cast("long"))
    convs = written(convs, "conversations")
    heads = turns.filter((F.col("place") < SHARED) & (F.col("conv") == base)).select(F.col("conv").alias("base"), "place", "s", "t", "chars")
    heads = convs.select("conv", "base", "taken").join(heads, "base").filter("place < taken").select("conv", "place", "s", "t", "chars")
    own = turns.join(convs.select("conv", "first", "taken"), "conv").filter("place >= first").select(
        "conv", (F.col("place") - F.col("first") + F.col("taken")).alias("place"), "s", "t", "chars")
    lengths = convs.select("conv", (F.greatest(F.col("own") - F.col("first"), F.lit(0)) + F.col("taken")).cast("long").alias("n"))
    return heads.unionByName(own), lengths


def _running(name: str, over) -> Column:
    return F.coalesce(F.bit_xor(name).over(over), F.lit(0).cast("long"))


def paths_of(turns: DataFrame, band: int = BAND) -> DataFrame:
    """(conv, band, before, keys): a row per conversation and band of ``band`` turns; keys are the (a, b, chars) of its nodes in
    order of depth, the first of them at depth ``band * band + 1``; before is the (a, b) of the node above them."""
    x = lambda salt: F.xxhash64(F.lit(salt), "place", "s", "t")
    rows = turns.select("conv", F.expr(f"place div {band}").alias("band"), "place", x(1).alias("x"), x(2).alias("y"), "chars")
    bands = rows.groupBy("conv", "band").agg(F.sort_array(F.collect_list(F.struct("place", "x", "y", "chars"))).alias("own"),
                                             F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    bands = written(bands.withColumn("run", F.expr(f"band div {RUN}")), "bands")
    # Running XOR in two steps, so that no window holds more than RUN bands or a RUN-th of a conversation's bands.
    slim = bands.select("conv", "run", "band", "x", "y")
    runs = slim.groupBy("conv", "run").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    past = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "run", _running("x", past).alias("rx"), _running("y", past).alias("ry"))
    inside = Window.partitionBy("conv", "run").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.select("conv", "run", "band", _running("x", inside).alias("bx"), _running("y", inside).alias("by"))
    start = slim.join(runs, ["conv", "run"]).select("conv", "band", F.struct(
        F.col("bx").bitwiseXOR(F.col("rx")).alias("a"), F.col("by").bitwiseXOR(F.col("ry")).alias("b")).alias("before"))
    first = F.transform(F.array("before"), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.lit(0).cast("long").alias("chars")))
    step = lambda done, v: F.concat(done, F.array(F.struct(
        F.element_at(done, -1)["a"].bitwiseXOR(v["x"]).alias("a"), F.element_at(done, -1)["b"].bitwiseXOR(v["y"]).alias("b"), v["chars"].alias("chars"))))
    keys = F.aggregate("own", first, step)
    return written(bands.select("conv", "band", "own").join(start, ["conv", "band"]).select(
        "conv", "band", "before", F.slice(keys, 2, band).alias("keys")), "paths")


def nodes_of(paths: DataFrame, lengths: DataFrame, band: int = BAND) -> DataFrame:
    """One row a node below the root: depth, a, b, pa, pb (its parent's key), chars, conv (smallest member), n_convs, n_ends."""
    each = paths.join(lengths, "conv").select("conv", "n", "band", "before", "keys", F.posexplode("keys").alias("at", "k"))
    up = F.coalesce(F.get("keys", F.col("at") - 1)["a"], F.col("before.a")), F.coalesce(F.get("keys", F.col("at") - 1)["b"], F.col("before.b"))
    each = each.select("conv", (F.col("band") * band + F.col("at") + 1).alias("depth"), F.col("k.a").alias("a"), F.col("k.b").alias("b"),
                       up[0].alias("pa"), up[1].alias("pb"), F.col("k.chars").alias("chars"), "n")
    return each.groupBy(*KEY).agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("chars").alias("chars"), F.min("conv").alias("conv"),
                                  F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("n") == F.col("depth")).alias("n_ends"))


class Queue:
    """Messages (order, value, value) by smallest order; beyond ``limit`` in memory, sorted runs go to an unnamed file of the task."""

    def __init__(self, limit: int):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            file = tempfile.TemporaryFile()
            for m in sorted(self.heap):
                pickle.dump(m, file)
            file.seek(0)
            self.heap = []
            self._next(file)

    def _next(self, file) -> None:
        """The run's smallest message stands for it among the runs."""
        try:
            heapq.heappush(self.runs, (pickle.load(file), id(file), file))
        except EOFError:
            file.close()

    def pop(self, order: tuple) -> Iterator[tuple]:
        """The messages of this order; none with a smaller one may be left."""
        while True:
            if self.heap and self.heap[0][0] == order:
                yield heapq.heappop(self.heap)
            elif self.runs and self.runs[0][0][0] == order:
                message, _, file = heapq.heappop(self.runs)
                self._next(file)
                yield message
            else:
                return


def forward(rows: Iterator[tuple], limit: int = QUEUE) -> Iterator[tuple]:
    """(depth, a, b, leaves, saved): totals of the subtrees of one shard's trie.

    ``rows`` are (-depth, a, b, pa, pb, top, leaves, saved) in order, a node perhaps several times; the node at a shard's top sends nothing on.
    """
    queue, key, node = Queue(limit), None, None

    def done():
        order, (pa_, pb_), top, leaves, saved = node
        for _, l, s in queue.pop(order):
            leaves, saved = leaves + l, saved + s
        if not top:
            queue.push(((order[0] + 1, pa_, pb_), leaves, saved))
        return (-order[0], order[1], order[2], leaves, saved)

    for depth, a, b, pa_, pb_, top, leaves, saved in rows:
        if (depth, a, b) != key:
            if node:
                yield done()
            key = (depth, a, b)
            node = [key, (pa_, pb_), top, 0, 0]
        node[3] += leaves
        node[4] += saved
    if node:
        yield done()


def in_bands(paths: DataFrame, values: DataFrame, band: int, shard: int, queue: int) -> DataFrame:
    """(depth, a, b, leaves, saved): per node the totals of the part of its subtree that lies in its band.

    ``values`` has a row a node: depth (in the tier, from 1), a, b, conv (an owner that passes through it), leaves, saved.
    """
    own = values.select("conv", F.expr(f"(depth - 1) div {band}").alias("band"), F.struct(
        ((F.col("depth") - 1) % band).cast("int").alias("at"), "leaves", "saved").alias("v"))
    own = own.groupBy("conv", "band").agg(F.collect_list("v").alias("own"))
    # One row per owner and band; it brings the node's ancestors in the band along, with nothing of their own.
    chains = paths.join(own, ["conv", "band"])
    top = F.get("keys", F.lit(0))
    sizes = chains.groupBy("band", top["a"].alias("ta"), top["b"].alias("tb")).agg(F.ceil(F.sum(F.size("keys")) / shard).cast("int").alias("shards"))
    sizes = sizes.filter("shards > 1")
    chains = chains.withColumn("ta", top["a"]).withColumn("tb", top["b"]).join(sizes, ["band", "ta", "tb"], "left")
    chains = chains.withColumn("deal", F.pmod(F.xxhash64("conv"), F.coalesce("shards", F.lit(1))).cast("int"))
    last = F.array_max(F.transform("own", lambda v: v["at"])) + 1
    each = chains.select("band", "ta", "tb", "deal", "own", "keys", F.posexplode(F.slice("keys", F.lit(1), last)).alias("at", "k"))
    mine = F.get(F.filter("own", lambda v: v["at"] == F.col("at")), F.lit(0))
    zero = F.lit(0).cast("long")
    parent = F.get("keys", F.col("at") - 1)
    rows = each.select("band", "ta", "tb", "deal", (-(F.col("band") * band + F.col("at") + 1)).alias("level"), F.col("k.a").alias("a"), F.col("k.b").alias("b"),
                       parent["a"].alias("pa"), parent["b"].alias("pb"), (F.col("at") == 0).alias("top"),
                       F.coalesce(mine["leaves"], zero).alias("leaves"), F.coalesce(mine["saved"], zero).alias("saved"))
    by = ["band", "ta", "tb", "deal"]
    rows = rows.repartition(*by).sortWithinPartitions(*by, "level", "a", "b")
    schema = "depth long, a long, b long, leaves long, saved long"

    def run(batches):
        def each_row():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))

        def shards():
            key, source = None, each_row()
            row = next(source, None)
            while row is not None:
                key = row[:4]

                def one():
                    nonlocal row
                    while row is not None and row[:4] == key:
                        yield row[4:]
                        row = next(source, None)

                yield from forward(one(), queue)

        out = []
        for x in shards():
            out.append(x)
            if len(out) == 8192:
                yield _totals(out)
                out = []
        yield _totals(out)

    # Shards of one subtree have nodes in common.
    return rows.mapInArrow(run, schema).groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _totals(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [*KEY, "leaves", "saved"])


def subtree_totals(paths: DataFrame, values: DataFrame, depth: int, band: int = BAND, shard: int = SHARD, queue: int = QUEUE) -> DataFrame:
    """(depth, a, b, leaves, saved) over the whole subtree of every node of a tier of ``depth`` levels."""
    part = written(in_bands(paths, values, band, shard, queue), "totals")
    if depth <= band:
        return part
    # Shard roots: the first nodes of the bands, a tier of their own with bands of bands.
    rise = lambda c: F.expr(f"({c} - 1) div {band} + 1")
    tops = part.filter(F.col("depth") % band == 1 if band > 1 else F.lit(True)).join(values.select(*KEY, "conv"), KEY)
    tops = tops.select("conv", rise("depth").alias("depth"), "a", "b", "leaves", "saved")
    heads = paths.select("conv", F.expr(f"band div {band}").alias("up"), F.struct("band", F.get("keys", F.lit(0)).alias("k")).alias("h"))
    heads = heads.groupBy("conv", "up").agg(F.sort_array(F.collect_list("h")).alias("h"))
    heads = written(heads.select("conv", F.col("up").alias("band"), F.transform("h", lambda h: h["k"]).alias("keys")), "heads")
    whole = subtree_totals(heads, written(tops, "tops"), -(-depth // band), band, shard, queue)
    # What hangs below a band goes to the parents of its first nodes, then up the band.
    starts = _parents(paths)
    sent = whole.join(starts.groupBy(*KEY).agg(F.min("before").alias("before")), KEY).select(
        ((F.col("depth") - 1) * band).alias("depth"), F.col("before.a").alias("a"), F.col("before.b").alias("b"), "leaves", "saved")
    sent = sent.groupBy(*KEY).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    values = values.join(sent, KEY, "left").select("conv", *KEY, *[
        (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
    return written(in_bands(paths, values, band, shard, queue), "totals")


def _parents(paths: DataFrame) -> DataFrame:
    """For the first node of each band but the first: its place in the next tier, its key, and the key of the node above it."""
    ends = paths.select("conv", (F.col("band") + 1).alias("band"), F.element_at("keys", -1).alias("p"))
    firsts = paths.filter("band > 0").select("conv", "band", F.get("keys", F.lit(0)).alias("k"))
    return firsts.join(ends, ["conv", "band"]).select((F.col("band") + 1).alias("depth"), F.col("k.a").alias("a"), F.col("k.b").alias("b"),
                                                      F.struct("p.a", "p.b").alias("before"))


def members_sha256(ends: DataFrame, key: list[str], piece: int = PIECE) -> DataFrame:
    """(key, ends_sha256) of the ids ``conv`` per key, ascending, joined by commas.

    SHA-256 reads its input in order, so one task hashes a key's list; but the ids are sorted and joined into pieces by all
    tasks before, and the pieces stream through it: it holds one batch and reads a ``piece``-th of the rows.
    """
    spark = ends.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*key, "conv"]
    sorted_ids = ends.select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    n = len(key)
    kinds = [pa.int64()] * n

    def join(batches):
        at, first, ids = None, None, []

        def batch_of(rows):
            cols = list(zip(*rows)) or [()] * (n + 2)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*kinds, pa.int64(), pa.string()])], [*key, "conv", "ids"])

        out = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(n + 1))):
                if row[:n] != at or len(ids) == piece:
                    if ids:
                        out.append((*at, first, ",".join(ids)))
                    at, first, ids = row[:n], row[n], []
                ids.append(str(row[n]))
            if out:
                yield batch_of(out)
                out = []
        if ids:
            yield batch_of([(*at, first, ",".join(ids))])

    pieces = sorted_ids.mapInArrow(join, ", ".join(f"{c} long" for c in by) + ", ids string")
    pieces = written(pieces, "pieces").repartition(*key).sortWithinPartitions(*by)

    def hashed(batches):
        at, h, out = None, None, []

        def batch_of(rows):
            cols = list(zip(*rows)) or [()] * (n + 1)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*kinds, pa.string()])], [*key, "ends_sha256"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(n + 2))):
                if row[:n] != at:
                    if h:
                        out.append((*at, h.hexdigest()))
                    at, h = row[:n], hashlib.sha256(row[n + 1].encode())
                else:
                    h.update(b"," + row[n + 1].encode())
            if out:
                yield batch_of(out)
                out = []
        if h:
            yield batch_of([(*at, h.hexdigest())])

    return pieces.mapInArrow(hashed, ", ".join(f"{c} long" for c in key) + ", ends_sha256 string")


def trie(conversations: DataFrame, band: int = BAND, shard: int = SHARD, queue: int = QUEUE, piece: int = PIECE) -> DataFrame:
    """One row a node of the rebuilt conversations' trie."""
    turns = turns_of(conversations)
    conv = F.col("conv")
    rows, lengths = rebuilt(turns, conv - conv % HUNDRED, (F.crc32(conv.cast("string")) % SHARED).cast("int"))
    lengths = written(lengths, "lengths")
    paths = paths_of(rows, band)
    nodes = written(nodes_of(paths, lengths, band), "nodes")
    values = nodes.select("conv", *KEY, F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("long").alias("leaves"),
                          ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    n_convs, first, depth = lengths.agg(F.count(F.lit(1)), F.min("conv"), F.max("n")).first()
    depth = depth or 0
    totals = subtree_totals(paths, values, depth, band, shard, queue)
    # The root: the node above all first turns.
    whole = totals.filter("depth = 1").agg(F.sum("leaves"), F.sum("saved"), F.count(F.lit(1))).first()
    root = [(first, 0, 0, 0, None, n_convs, whole[2], whole[0] or 1, whole[1] or 0)] if n_convs else []
    root = turns.sparkSession.createDataFrame(root, "conv_id long, depth long, a long, b long, parent_conv_id long, n_convs long, "
                                                    "n_children long, n_leaves long, saved_tokens long")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    # First turns have the root above them, whose smallest member is that of all.
    near = nodes.filter("depth = 1").select(*KEY, "conv", "n_convs", F.lit(first).cast("long").alias("parent"))
    far = nodes.filter("depth > 1").join(parents, ["depth", "pa", "pb"]).select(*KEY, "conv", "n_convs", "parent")
    below = near.unionByName(far).join(totals, KEY).join(children, KEY, "left").select(
        F.col("conv").alias("conv_id"), *KEY, F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    last = F.element_at("keys", -1)
    ends = paths.join(lengths, "conv").filter(F.col("n") == F.col("band") * band + F.size("keys")).select(
        F.col("n").alias("depth"), last["a"].alias("a"), last["b"].alias("b"), "conv")
    ends = ends.unionByName(lengths.filter("n = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"),
                                                           F.lit(0).cast("long").alias("b"), "conv"))
    digests = members_sha256(written(ends, "ends"), KEY, piece)
    return root.unionByName(below).join(digests, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
