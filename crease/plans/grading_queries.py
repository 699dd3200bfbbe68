"""Grading queries (S9, S10, E10, U1, X13, A21, Q4, Q5) and their oracles.

Four databases hold a quarter of the orders and line items each, a fifth is named but absent. Two models answer seven questions
per database; every status comes from running the statements. The oracle compares the statements' results in DuckDB itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crease.operators.grading import GradingItem, grade, grading_rates
from crease.sources.databases import create_database, database_schemas
from crease.sources.eval_fixtures import MODELS

# Databases and statements.
DATABASES = ["market_0", "market_1", "market_2", "market_3"]
ABSENT = "market_9"
#: Sorts hashes of all line items, each taken many times, so it runs far beyond its limit on any size of the tables.
ENDLESS = ("SELECT MAX(sha2(concat(k, x), 256)) FROM (SELECT /*+ REPARTITION(4000) */ l_orderkey AS k FROM lineitem) "
           "LATERAL VIEW explode(sequence(1, 20000)) t AS x")
#: Seconds that statement gets; others get LONG.
SHORT, LONG = 2.0, 3600.0
#: Gold, first and second model's statement.
STATEMENTS = [
    ("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
     "SELECT o_orderstatus, COUNT(o_orderkey) FROM orders GROUP BY 1",
     "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) FROM orders GROUP BY o_orderstatus"),
    # Sets of rows: repeats and letter case do not count.
    ("SELECT DISTINCT l_returnflag FROM lineitem", "SELECT LOWER(l_returnflag) FROM lineitem", "SELECT l_returnflag FROM lineitem WHERE l_returnflag <> 'R'"),
    # Numbers are compared as Python prints them.
    ("SELECT DISTINCT '1e-05' AS x, '10000000.0' AS y, '1.5e+16' AS z FROM orders",
     "SELECT o_orderkey * 0 + 1e-5, o_orderkey * 0 + 1e7, o_orderkey * 0 + 1.5e16 FROM orders",
     "SELECT DISTINCT '1.0e-5' AS x, '1.0e7' AS y, '1.5e16' AS z FROM orders"),
    ("SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders",
     "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'None' ELSE ' ' || o_orderstatus || ' ' END FROM orders",
     "SELECT no_such_column FROM orders"),
    ("SELECT total_runs FROM orders", "SELECT COUNT(*) FROM orders", "DROP VIEW orders"),
    ("SELECT o_orderkey FROM orders WHERE o_totalprice < 0", "SELECT o_custkey FROM orders WHERE 1 = 0", "SELECT 0 FROM orders"),
    ("SELECT MAX(l_quantity) AS q FROM lineitem", "SELECT l_quantity FROM lineitem ORDER BY l_quantity DESC LIMIT 1", "SELECT MIN(l_quantity) FROM lineitem"),
]


def _open(spark: SparkSession, sf_dir: str) -> None:
    for k, db_id in enumerate(DATABASES):
        create_database(spark, db_id, {
            "orders": f"SELECT * FROM parquet.`{sf_dir}/orders.parquet` WHERE o_orderkey % {len(DATABASES)} = {k}",
            "lineitem": f"SELECT * FROM parquet.`{sf_dir}/lineitem.parquet` WHERE l_orderkey % {len(DATABASES)} = {k}"})


def grading_set() -> list[GradingItem]:
    items = []
    for d, db_id in enumerate([*DATABASES, ABSENT]):
        for q, (gold, *generated) in enumerate(STATEMENTS):
            for model, sql in zip(MODELS, generated):
                endless = (d, q, model) == (0, len(STATEMENTS) - 1, MODELS[1])
                items.append(GradingItem(d * 10 + q, model, db_id, gold, ENDLESS if endless else sql, SHORT if endless else LONG, LONG))
    return items


def grading_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's status, with the rows that its statements gave."""
    _open(spark, sf_dir)
    return grade(spark, grading_set())


def grading_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading_rates(grading_items(spark, sf_dir))


def database_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context text of each database, and how many rows its tables have."""
    _open(spark, sf_dir)
    texts = spark.createDataFrame(database_schemas(spark, [*DATABASES, ABSENT]), "db_id string, schema_text string")
    rows = None
    for db_id in DATABASES:
        one = spark.sql(f"SELECT '{db_id}' AS db_id, (SELECT COUNT(*) FROM {db_id}.orders) AS n_orders, "
                        f"(SELECT COUNT(*) FROM {db_id}.lineitem) AS n_lines")
        rows = one if rows is None else rows.unionAll(one)
    return texts.join(rows, "db_id", "left")


QUERIES = {f.__name__: f for f in (grading_items, grading_summary, database_tables)}


# --- oracles ------------------------------------------------------------------

#: Columns of each question's results, and the outcomes that do not depend on rows: of gold and of both models.
_WIDTHS = [2, 1, 3, 2, 1, 1, 1]
_FIXED = {(3, 1): "EXEC_ERROR", (4, 0): "GOLD_ERROR", (4, 1): "EXEC_ERROR"}
_FAILS = {(3, 2), (4, 0), (4, 2)}


def _in(db: int, sql: str) -> str:
    """The statement over a quarter of the tables."""
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        sql = sql.replace(f"FROM {t}", f"FROM (SELECT * FROM {t} WHERE {key} % {len(DATABASES)} = {db}) AS {t}")
    return sql


def _rows(db: int, sql: str, width: int) -> str:
    cols = [f"c{i}" for i in range(width)]
    shown = ", ".join(f"coalesce(lower(trim(CAST({c} AS VARCHAR))), 'none')" for c in cols)
    return f"(SELECT {shown} FROM ({_in(db, sql)}) AS t({', '.join(cols)}))"


def _items_sql() -> str:
    parts = []
    for d, db_id in enumerate([*DATABASES, ABSENT]):
        for q, texts in enumerate(STATEMENTS):
            for m, model in enumerate(MODELS):
                counted = ["0" if db_id == ABSENT or (q, k) in _FAILS else f"(SELECT COUNT(*) FROM ({_in(d, texts[k])}))" for k in (0, m + 1)]
                gold, gen = _rows(d, texts[0], _WIDTHS[q]), _rows(d, texts[m + 1], _WIDTHS[q])
                if db_id == ABSENT:
                    status = "'DB_MISSING'"
                elif (d, q, m) == (0, len(STATEMENTS) - 1, 1):
                    status, counted[1] = "'TIMEOUT'", "0"
                elif (q, m) in _FIXED:
                    status = f"'{_FIXED[q, m]}'"
                else:
                    status = f"CASE WHEN EXISTS ({gold} EXCEPT {gen}) OR EXISTS ({gen} EXCEPT {gold}) THEN 'INCORRECT' ELSE 'CORRECT' END"
                parts.append(f"SELECT '{model}' AS model, {d * 10 + q}::BIGINT AS id, '{db_id}' AS db_id, {status} AS status, "
                             f"{counted[0]}::BIGINT AS gold_rows, {counted[1]}::BIGINT AS generated_rows")
    return "\nUNION ALL ".join(parts)


_SCHEMA_TEXT = ("CREATE TABLE lineitem (l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate {t});' || chr(10) || '"
                "CREATE TABLE orders (o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate {t}, "
                "o_orderpriority string);").format(t="timestamp_ntz")

ORACLES = {
    "grading_items": _items_sql(),
    "grading_summary": f"""
WITH items AS ({_items_sql()}),
c AS (SELECT model, COUNT(*) AS total, COUNT(CASE WHEN status = 'CORRECT' THEN 1 END) AS correct,
             COUNT(CASE WHEN status IN ('EXEC_ERROR', 'TIMEOUT') THEN 1 END) AS exec_errors FROM items GROUP BY model)
SELECT model, total, correct, exec_errors, ROUND((total - exec_errors) * 100.0 / total, 6) AS exec_rate_pct,
       ROUND(correct * 100.0 / total, 6) AS accuracy_pct FROM c""",
    "database_tables": "\nUNION ALL ".join(
        [f"SELECT '{db}' AS db_id, '{_SCHEMA_TEXT}' AS schema_text, (SELECT COUNT(*) FROM orders WHERE o_orderkey % {len(DATABASES)} = {k}) AS n_orders, "
         f"(SELECT COUNT(*) FROM lineitem WHERE l_orderkey % {len(DATABASES)} = {k}) AS n_lines" for k, db in enumerate(DATABASES)]
        + [f"SELECT '{ABSENT}', 'Error reading schema: no database {ABSENT}', NULL, NULL"]),
}
