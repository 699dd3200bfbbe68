"""Query-set jobs: SQL held as data, run with Spark SQL.

A query set is small (hundreds of statements), each statement is a full Spark
job over the cluster's tables. The loop over statements runs on the driver
because each statement *is* a job. Its rows never come to the driver: Spark writes all of
them, as one JSON text a row, to a table in the shared folder; the driver keeps a status line per statement.

* Q1/Q2: run a statement, record status, ordered header and all result rows;
* Q3/L5: header without data - analysis only, no job is started;
* Q4: per-statement timeout by job tag cancellation, repeated until the statement ends;
* Q5: error text mapping (timeout / execution error);
* SQL arrives as data, so Spark's parser reads it first and only plans without a command in them are run.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.session import checkpoint_dir

# Result text of failed statements.
TIMEOUT_TEXT = "ERROR: Query Timed Out"
EXEC_ERROR_PREFIX = "EXECUTION_ERROR: "
DEFAULT_TIMEOUT_S = 10.0
STATUS_SCHEMA = "key string, status string, headers array<string>, n_rows long, message string"
ROW_SCHEMA = "key string, row_no long, row string"


class Refused(ValueError):
    """The text is not one read-only statement."""


@dataclass
class QueryOutcome:
    key: str
    status: str                 # ok | timeout | error | refused
    headers: list
    n_rows: int = 0
    message: str | None = None


def _holds_command(spark: SparkSession, plan) -> bool:
    """Is there a statement in the parsed plan that does more than read?"""
    classes = [spark._jvm.org.apache.spark.util.Utils.classForName(f"org.apache.spark.sql.catalyst.plans.logical.{n}", True, False)
               for n in ("Command", "ParsedStatement")]
    todo = [plan]
    while todo:
        node = todo.pop()
        if any(c.isInstance(node) for c in classes):
            return True
        for nodes in (node.children(), node.innerChildren()):
            todo += [x for i in range(nodes.size()) if hasattr(x := nodes.apply(i), "children")]
    return False


def check_read_only(spark: SparkSession, sql: str | None) -> str:
    """``sql`` if it is a single query; :class:`Refused` if it is a command, holds one, or is blank."""
    if not sql or not sql.strip():
        raise Refused("empty statement")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if _holds_command(spark, plan):
        raise Refused("only queries are run")
    return sql


def is_read_only(spark: SparkSession, sql: str | None) -> bool:
    try:
        check_read_only(spark, sql)
    except Exception:  # noqa: BLE001 - a text that cannot be parsed is no query either
        return False
    return True


def headers_of(spark: SparkSession, sql: str) -> list[str]:
    """Column names from analysis only (no job runs)."""
    return spark.sql(check_read_only(spark, sql)).columns


def schema_text(spark: SparkSession, database: str | None = None) -> str:
    """All table definitions of a database as text, or an error string."""
    try:
        lines = []
        for t in sorted(spark.catalog.listTables(database), key=lambda t: t.name):
            cols = spark.catalog.listColumns(f"{database}.{t.name}" if database else t.name)
            lines.append(f"CREATE TABLE {t.name} (" + ", ".join(f"{c.name} {c.dataType}" for c in cols) + ");")
        return "\n".join(lines)
    except Exception as exc:  # noqa: BLE001
        return f"Error reading schema: {exc}"


class _Deadline:
    """Cancels the jobs of a tag from the deadline on, again and again, until it is closed."""

    def __init__(self, sc, tag: str, seconds: float):
        self.sc, self.tag, self.seconds = sc, tag, seconds
        self.closed, self.passed = threading.Event(), False
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def _watch(self) -> None:
        wait = self.seconds
        while not self.closed.wait(wait):
            self.passed, wait = True, 0.2
            self.sc.cancelJobsWithTag(self.tag)

    def __enter__(self):
        self.sc.addJobTag(self.tag)
        self.thread.start()
        return self

    def __exit__(self, *exc):
        self.closed.set()
        self.thread.join()
        self.sc.removeJobTag(self.tag)


def json_row(cells: DataFrame) -> Column:
    return F.to_json(F.struct(*cells.columns), {"ignoreNullFields": "false"})


def run_query(spark: SparkSession, key: str, sql: str | None, rows_path: str, timeout_s: float = DEFAULT_TIMEOUT_S,
              row_of: Callable[[DataFrame], Column] = json_row) -> QueryOutcome:
    """Q1/Q2/Q4/Q5: one statement; all its rows, as the texts of ``row_of``, go to the table at ``rows_path``.

    A statement that has not ended by the deadline timed out, whatever becomes of it afterwards.
    """
    path = f"{rows_path}/{uuid.uuid4().hex}"
    try:
        text = check_read_only(spark, sql)
    except Refused as exc:
        return QueryOutcome(key, "refused", [], message=str(exc))
    except Exception as exc:  # noqa: BLE001 - what the parser says is the result
        return QueryOutcome(key, "error", [], message=str(exc).strip().split("\n")[0])
    with _Deadline(spark.sparkContext, f"crease-q-{uuid.uuid4().hex}", timeout_s) as deadline:
        try:
            df = spark.sql(text)
            headers = df.columns
            # By position, as names in a header may repeat.
            cells = df.toDF(*[f"c{i}" for i in range(len(headers))])
            cells.select(F.lit(key).alias("key"), F.monotonically_increasing_id().alias("row_no"), row_of(cells).alias("row")).write.parquet(path)
            n = spark.read.schema(ROW_SCHEMA).parquet(path).count()
            outcome = QueryOutcome(key, "ok", headers, n)
        except Exception as exc:  # noqa: BLE001 - analysis and execution errors are results
            outcome = QueryOutcome(key, "error", [], message=str(exc).strip().split("\n")[0])
    return QueryOutcome(key, "timeout", [], message=TIMEOUT_TEXT) if deadline.passed else outcome


def run_query_set(spark: SparkSession, statements: list[tuple], timeout_s: float = DEFAULT_TIMEOUT_S,
                  parallelism: int = 4, rows_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run (key, sql) pairs concurrently (FAIR scheduling recommended): (status table, table of all rows).

    A third element of a statement is its own time limit in seconds, in place of ``timeout_s``.
    Job tags are thread-local, so each worker thread tags and cancels only its own jobs. ``row_no`` grows in the order of a
    statement's result. The rows of statements that failed on the way are left out.
    """
    rows_path = rows_path or f"{checkpoint_dir(spark).rstrip('/')}/queryset-{uuid.uuid4().hex}"
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        outcomes = list(pool.map(lambda s: run_query(spark, s[0], s[1], rows_path, *(s[2:] or (timeout_s,))), statements))
    # One row per statement of the set.
    status = spark.createDataFrame([(o.key, o.status, o.headers, o.n_rows, o.message) for o in outcomes], STATUS_SCHEMA)
    status = status.withColumn("result", F.when(F.col("status") == "timeout", F.lit(TIMEOUT_TEXT)).when(
        F.col("status") != "ok", F.concat(F.lit(EXEC_ERROR_PREFIX), F.coalesce("message", F.lit("")))))
    if any(o.status == "ok" for o in outcomes):
        rows = spark.read.schema(ROW_SCHEMA).option("recursiveFileLookup", True).parquet(rows_path)
    else:
        rows = spark.createDataFrame([], ROW_SCHEMA)
    return status, rows.join(status.filter("status = 'ok'").select("key"), "key", "left_semi")


def validation_counts(status_table: DataFrame) -> DataFrame:
    """Successes and errors (refused or missing statements count as errors)."""
    return status_table.agg(F.count_if(F.col("status") == "ok").alias("success"),
                            F.count_if(F.col("status") != "ok").alias("errors"))
