"""Merkle manifest of a table: a persistent tree of SHA-256 digests, with proofs and tampered versions.

A leaf is the digest of a row's fields. Within each language leaves stand in order of doc_id, and runs of
``FAN`` nodes become one digest until one node is left; the languages' subroots make a tree of the same kind.

The tree is built in aligned blocks of ``FAN ** LEVELS`` nodes, one group each, tier by tier: the blocks' roots
are the nodes of the next tier, so a tier is a distributed job over that many times fewer rows. A block is a persistent tree: a
changed leaf gives a new version that shares every untouched node and copies only the leaf's ancestors in the block. On the way
back down each block learns the siblings of its own ancestors (of bounded length), by which its versions go on through the upper tiers,
in parallel and with no shuffle of versions.

Defined results: null doc_ids stand first, equal doc_ids in order of their leaves; repeated rows are leaves of their own; a null
language is a language of its own and comes first; a null doc_id is never tampered with; a text that lower-casing leaves as it is stays
verified; an empty table gives no rows; other columns than the five fields take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import groups, ordered, table, written

FAN, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_A, _Z = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
_NODES = "grp string, place long, total long, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def levels_of(n: int, fan: int = FAN) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


class Block:
    """A persistent tree over the digests of a block; a version holds only the nodes in which it differs."""

    def __init__(self, leaves: list[str], levels: int, fan: int = FAN):
        self.fan, self.levels = fan, [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i:i + fan])) for i in range(0, len(below), fan)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[tuple[str, str]]:
        """Per level the digests left and right of the path from node ``i`` within its runs."""
        out = []
        for nodes in self.levels[:-1]:
            first = i - i % self.fan
            out.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + self.fan])))
            i //= self.fan
        return out

    def version(self, i: int, changed: str) -> dict[tuple[int, int], str]:
        """(level, place) -> digest: the changed leaf and copies of its ancestors; all other nodes are shared with this tree."""
        copied = {(0, i): changed}
        for level, nodes in enumerate(self.levels[:-1]):
            first = i - i % self.fan
            run = nodes[first:first + self.fan]
            run[i - first] = copied[level, i]
            i //= self.fan
            copied[level + 1, i] = digest("".join(run))
        return copied

    def root_of(self, version: dict[tuple[int, int], str]) -> str:
        return version[len(self.levels) - 1, 0]


def folded(node: str, path: Sequence[tuple[str, str]]) -> str:
    """The digest at the end of ``path`` above ``node``."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _text(path: Sequence[tuple[str, str]]) -> str:
    return ";".join(f"{left},{right}" for left, right in path)


def _path(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in text.split(";")] if text else []


def _columns(rows: list[tuple], names: Sequence[str], kinds: Sequence[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], list(names))


def lifted(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """The roots of the blocks of a tier's nodes (grp, place, total, digest), as nodes of the next tier."""
    size = fan ** levels
    dealt = nodes.select("grp", F.expr(f"place div {size}").alias("block"), "place", "total", "digest")
    dealt = dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "place")

    def build(batches):
        out = []
        for (grp, block), rows in groups(batches, 2):
            total = rows[0][1]
            out.append((grp, block, -(-total // size), Block([r[2] for r in rows], min(levels, levels_of(total, fan)), fan).root))
            if len(out) == 4096:
                yield _columns(out, _names(_NODES), (pa.string(), pa.int64(), pa.int64(), pa.string()))
                out = []
        yield _columns(out, _names(_NODES), (pa.string(), pa.int64(), pa.int64(), pa.string()))

    return dealt.mapInArrow(build, _NODES)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _with_paths(nodes: DataFrame, paths: DataFrame, size: int, extra: Sequence[str]) -> DataFrame:
    """Rows of the tier sorted by block, each block led by the row of ``paths`` (grp, place, path, above) for it."""
    nulls = lambda df, names, kind: [F.lit(None).cast(kind).alias(n) for n in names]
    of_nodes = nodes.select("grp", F.expr(f"place div {size}").alias("block"), "place", "total", "digest", *extra,
                            *nulls(nodes, ("path", "above"), "string"))
    kinds = dict(nodes.dtypes)
    of_paths = paths.select("grp", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("total"),
                            F.lit(None).cast("string").alias("digest"), *[F.lit(None).cast(kinds[c]).alias(c) for c in extra], "path", "above")
    return of_nodes.unionByName(of_paths).repartition("grp", "block").sortWithinPartitions("grp", "block", "place")


def lowered(nodes: DataFrame, paths: DataFrame, fan: int, levels: int) -> DataFrame:
    """(grp, place, path, above) for the nodes of a tier, from those of the blocks above."""
    def spread(batches):
        for (grp, _), rows in groups(batches, 2):
            path, above = rows[0][3:5]
            total = rows[1][1]
            block = Block([r[2] for r in rows[1:]], min(levels, levels_of(total, fan)), fan)
            out = [(grp, r[0], ";".join(filter(None, (_text(block.siblings(i)), path))), above) for i, r in enumerate(rows[1:])]
            yield _columns(out, ("grp", "place", "path", "above"), (pa.string(), pa.int64(), pa.string(), pa.string()))

    return _with_paths(nodes, paths, fan ** levels, ()).mapInArrow(spread, "grp string, place long, path string, above string")


def tiers_of(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """The given nodes, then the block roots of each tier up to one node a group."""
    found = [nodes]
    while (found[-1].agg(F.max("total")).first()[0] or 0) > 1:
        found.append(written(lifted(found[-1], fan, levels), "tier"))
    return found


def paths_of(tiers: list[DataFrame], top: DataFrame, fan: int, levels: int) -> DataFrame:
    """(grp, place, path, above) for the blocks of the lowest tier; ``top`` has it for the groups' roots."""
    paths = top
    for nodes in reversed(tiers[1:-1]):
        paths = lowered(nodes, paths, fan, levels)
    return paths


def leaves_of(docs: DataFrame) -> DataFrame:
    """(doc_id, grp, digest, changed) of every row; ``changed`` is the digest after tampering, or the same."""
    fields = [F.col(c) for c in FIELDS]
    low = [*fields[:-1], F.translate(F.col("text"), _A, _Z)]
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    # A language's group name is never null; null sorts first, as the empty name.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"),
                       leaf(fields).alias("digest"), F.when(hit, leaf(low)).alias("changed"))
    return rows.withColumn("changed", F.coalesce("changed", "digest"))


def manifest(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs`` (the five fields)."""
    leaves = ordered(written(leaves_of(docs), "leaves"), ["grp"], ["doc_id", "digest"], "place", "total")
    leaves = written(leaves, "leaves")
    nodes = leaves.select("grp", "place", "total", "digest")
    tiers = tiers_of(nodes, fan, levels)
    subroots = tiers[-1].select("grp", "digest")
    tops = ordered(written(subroots.select(F.lit("").alias("one"), "grp", "digest"), "subroots"), ["one"], ["grp"], "place", "total")
    tops = written(tops, "subroots")
    upper = tiers_of(tops.select(F.col("one").alias("grp"), "place", "total", "digest"), fan, levels)
    # The paths of the subroots, then by these those of the leaves' blocks.
    start = upper[-1].select("grp", "place", F.lit("").alias("path"), F.lit("").alias("above"))
    above = lowered(upper[0], paths_of(upper, start, fan, levels), fan, levels) if len(upper) > 1 else start
    start = tops.select("grp", "place").join(above.select("place", "path"), "place").select(
        "grp", F.lit(0).cast("long").alias("place"), F.lit("").alias("path"), F.col("path").alias("above"))
    paths = paths_of(tiers, written(start, "paths"), fan, levels)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())

    def prove(batches):
        for _, rows in groups(batches, 2):
            path, above = _path(rows[0][5]), _path(rows[0][6])
            rows = rows[1:]
            block = Block([r[2] for r in rows], min(levels, levels_of(rows[0][1], fan)), fan)
            rest = "".join(left + right for left, right in path + above)
            subroot = folded(block.root, path)
            root = folded(subroot, above)
            out = []
            for i, (_, _, own, doc_id, changed, _, _) in enumerate(rows):
                proof = "".join(left + right for left, right in block.siblings(i)) + rest
                again = folded(block.root_of(block.version(i, changed)), path + above)
                out.append((doc_id, own, subroot, root, digest(proof), again, again == root))
            yield _columns(out, names, kinds)

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_paths(leaves, paths, fan ** levels, ("doc_id", "changed")).mapInArrow(prove, schema)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and tampered version of every document."""
    return manifest(table(spark, sf_dir, "documents").select(*FIELDS))
