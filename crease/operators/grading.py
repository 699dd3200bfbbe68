"""Grading of generated SQL by execution.

An item names a database, a gold and a generated statement. Every different (database, statement, limit) is run once by Spark in
its database, with its rows written in normalised form to the shared folder; the driver keeps one status per
statement. Row sets are then compared in one aggregation over (pair, row), without collecting a set.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.functions.answers import normalize_cell
from crease.operators.compare import grade_status, sets_equal
from crease.operators.queryset import DEFAULT_TIMEOUT_S, ROW_SCHEMA, run_query
from crease.session import checkpoint_dir
from crease.sources.databases import database_present, session_for


@dataclass(frozen=True)
class GradingItem:
    id: int
    model: str
    db_id: str
    gold_sql: str
    generated_sql: str
    limit_s: float = DEFAULT_TIMEOUT_S
    gold_limit_s: float = DEFAULT_TIMEOUT_S


def normalized_row(cells: DataFrame) -> Column:
    """X13 of a result row: its cells' texts, as one text that keeps them apart."""
    return F.to_json(F.array(*[normalize_cell(F.col(c)) for c in cells.columns]))


def run_statements(spark: SparkSession, statements: Sequence[tuple[str, str, float]], parallelism: int = 4) -> tuple[DataFrame, DataFrame]:
    """(statement, status, n_rows, message) and (statement, row) of (database, SQL, limit in seconds); ``statement`` is the position.

    A statement of a database that is not there is ``missing`` and not run.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/grading-{uuid.uuid4().hex}"
    present = {d: database_present(spark, d) for d, _, _ in statements}
    sessions = {d: session_for(spark, d) for d, there in present.items() if there}

    def one(numbered):
        i, (db_id, sql, limit) = numbered
        if not present[db_id]:
            return (i, "missing", 0, None)
        o = run_query(sessions[db_id], str(i), sql, path, limit, normalized_row)
        return (i, o.status, o.n_rows, o.message)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        outcomes = list(pool.map(one, enumerate(statements)))
    status = spark.createDataFrame(outcomes, "statement long, status string, n_rows long, message string")
    if any(o[1] == "ok" for o in outcomes):
        rows = spark.read.schema(ROW_SCHEMA).option("recursiveFileLookup", True).parquet(path)
    else:
        rows = spark.createDataFrame([], ROW_SCHEMA)
    return status, rows.select(F.col("key").cast("long").alias("statement"), "row")


def grade(spark: SparkSession, items: Sequence[GradingItem], parallelism: int = 4) -> DataFrame:
    """E10 per item: model, id, db_id, status, with the row counts of both statements."""
    number: dict[tuple[str, str, float], int] = {}
    listed = [(x.id, x.model, x.db_id, *(number.setdefault((x.db_id, sql, limit), len(number)) for sql, limit in (
                  (x.gold_sql, x.gold_limit_s), (x.generated_sql, x.limit_s))))
              for x in items]
    status, rows = run_statements(spark, list(number), parallelism)
    graded = spark.createDataFrame(listed, "id long, model string, db_id string, gold long, generated long")
    for side in ("gold", "generated"):
        s = status.select(F.col("statement").alias(side), F.col("status").alias(f"{side}_status"), F.col("n_rows").alias(f"{side}_rows"))
        graded = graded.join(F.broadcast(s), side)  # one row per statement of the set
    # Two statements are compared once, however many items name them.
    pairs = graded.filter("gold_status = 'ok' AND generated_status = 'ok'").select("gold", "generated").distinct()
    of = lambda side: pairs.join(rows, F.col(side) == F.col("statement")).select("gold", "generated", "row")
    equal = sets_equal(of("gold"), of("generated"), ["gold", "generated"])
    graded = graded.join(equal, ["gold", "generated"], "left")
    shown = lambda c: F.when(F.col(c).isin("ok", "timeout"), F.col(c)).otherwise("error")
    # Two empty results have no row that tells them apart.
    return graded.select("model", "id", "db_id", grade_status(
        F.col("gold_status") != "missing", shown("gold_status"), shown("generated_status"), F.coalesce("equal", F.lit(True))).alias("status"),
        "gold_rows", "generated_rows")


def grading_rates(graded: DataFrame) -> DataFrame:
    """Total, correct, executed share (EXEC_ERROR and TIMEOUT fail execution) and accuracy per model."""
    n = F.count(F.lit(1))
    failed = F.count_if(F.col("status").isin("EXEC_ERROR", "TIMEOUT"))
    correct = F.count_if(F.col("status") == "CORRECT")
    return graded.groupBy("model").agg(
        n.alias("total"), correct.alias("correct"), failed.alias("exec_errors"),
        F.round((n - failed) * 100.0 / n, 6).alias("exec_rate_pct"), F.round(correct * 100.0 / n, 6).alias("accuracy_pct"))
