"""Mixing sources to target weights by systematic sampling.

Each source gets a target size by weight, at most ``most`` times its own size. Each of its
documents is expected ``target / size`` times. In the order (size, doc_id) the expected copies are
prefix-summed within the source, one offset per source is added, and a document is emitted once
for each whole number that its step crosses. As neighbours in this order are of nearly equal
size, the words taken differ from the target by about one large document at most.

Defined results: a null text has size 0 and takes part like an empty one; a null source is a source
of its own, last in order; a source whose documents are all empty has target 0 and takes nothing; repeated
rows are documents of their own; an empty table gives no rows; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import free_name, n_words, table

WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix"
_HEX = "0123456789abcdef"


def offset(source: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the seed and the source only: eight digits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))))
    total = F.lit(0).cast("long")
    for k in range(1, 9):
        total = total * 16 + F.instr(F.lit(_HEX), F.substring(digest, k, 1)) - 1
    return (total + 0.5) / float(16**8)


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with ``target``: all sizes shared by weight, sources in code point order
    taking the weights in turn; what exceeds ``most`` times a source's size is shared anew.

    The fixed point is ``target = least(most * size, level * weight)``. Sources are capped in the
    order of ``size / weight``; the level is what the uncapped share of the total gives. One row per source.
    """
    n = len(weights)
    # Windows over all rows here hold one row per source, never documents.
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(turn, ((F.row_number().over(order) - 1) % n + 1).cast("int")))
    everything = Window.partitionBy()
    fullest = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("all_size", F.sum("source_size").over(everything))
         .withColumn("all_w", F.sum("w").over(everything))
         .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0))))
    # The level if all before this source, and none from it on, are capped.
    level = (F.col("all_size") - most * F.col("size_before")).cast("double") / (F.col("all_w") - F.col("w_before"))
    s = s.withColumn("level", level)
    s = s.withColumn("capped", most * F.col("source_size") < F.col("level") * F.col("w"))
    s = s.withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least((most * F.col("source_size")).cast("double"),
                                                     F.coalesce("final", F.lit(0.0)) * F.col("w")).alias("target"))


def with_copies(docs: DataFrame, size: Column, source: str, weights=WEIGHTS, most: int = MOST,
                seed: str = SEED, split: int = 64, name: str = "mix") -> DataFrame:
    """``docs`` with struct column ``name`` (size, source_size, target, copies).

    The position of a document in its source is the sum of three numbers, so that no task orders a whole source:
    documents of smaller size (one row per source and size), of equal size in lower buckets of
    ``doc_id mod split``, and lower ones in the same bucket.
    """
    d = free_name(docs, "_d")
    keyed = docs.withColumn(d, F.struct(
        size.alias("size"), F.col(source).alias("source"), F.col("doc_id").alias("id"),
        F.coalesce(F.pmod("doc_id", F.lit(split)), F.lit(-1)).alias("bucket")))
    k = lambda c: F.col(f"{d}.{c}")
    cells = (keyed.groupBy(k("source").alias("source"), k("size").alias("size"), k("bucket").alias("bucket"))
             .agg(F.count(F.lit(1)).alias("n")))
    same = Window.partitionBy("source", "size")
    cells = cells.withColumn("in_size", F.coalesce(F.sum("n").over(
        same.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("smaller", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    goal = targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size")),
                   weights, most)
    plan = (cells.alias("c").join(by_size.drop("n").alias("b"),
                                  F.expr("c.source <=> b.source AND c.size = b.size"))
            .join(goal.alias("g"), F.expr("c.source <=> g.source"))
            .select(F.struct(F.col("c.source"), F.col("c.size"), "c.bucket", (F.col("b.smaller") + F.col("c.in_size")).alias("before"),
                             "g.source_size", "g.target").alias("_cell")))
    on = (k("source").eqNullSafe(F.col("_cell.source")) & (k("size") == F.col("_cell.size"))
          & (k("bucket") == F.col("_cell.bucket")))
    inside = Window.partitionBy(k("source"), k("size"), k("bucket")).orderBy(k("id"))
    rank = F.col("_cell.before") + F.row_number().over(inside)
    share = F.when(F.col("_cell.source_size") > 0,
                   F.least(F.col("_cell.target") / F.col("_cell.source_size"), F.lit(float(most)))).otherwise(0.0)
    start = offset(k("source"), seed)
    placed = keyed.join(plan, on).withColumn("_rank", rank)
    copies = F.floor(F.col("_rank") * share + start) - F.floor((F.col("_rank") - 1) * share + start)
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        k("size").alias("size"), F.col("_cell.source_size").alias("source_size"),
        F.col("_cell.target").alias("target"), copies.cast("long").alias("copies")).alias(name))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with its own columns."""
    name = free_name(docs, "_mix")
    counted = with_copies(docs, n_words(F.col("text")), "source", name=name, **params)
    m = free_name(counted, "_copy")
    copies = F.col(f"{name}.copies")
    return counted.filter(copies > 0).withColumn(m, F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop(m, name)


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, target and words taken of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return with_copies(docs, F.col("size"), "source").select(
        "doc_id", F.col("mix.size").alias("size"), F.col("mix.source_size").alias("source_size"),
        F.col("mix.target").alias("target"), (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         len([w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''])::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w
  WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE,
         coalesce(max(CASE WHEN NOT (3 * source_size < level * w) THEN level END) OVER (), 0) * w) AS target
  FROM l),
h AS (SELECT *, md5('{SEED}|' || coalesce('s' || source, 'null')) AS h FROM t),
u AS (SELECT *, ({' + '.join(f"(instr('{_HEX}', substr(h, {k}, 1)) - 1) * {16 ** (8 - k)}::BIGINT" for k in range(1, 9))} + 0.5)::DOUBLE / {16 ** 8}.0::DOUBLE AS u,
             CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS share FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size,
             coalesce(((doc_id % 64) + 64) % 64, -1), doc_id NULLS FIRST) AS r FROM d)
SELECT doc_id, size, source_size, target,
       ((floor(r * share + u) - floor((r - 1) * share + u)) * size)::BIGINT AS taken
FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source
"""
