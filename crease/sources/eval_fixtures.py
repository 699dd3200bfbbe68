"""Gold datasets and benchmark result records derived from the driver tables.

Question ``id`` = ``o_orderkey``; the gold result rows are the order's line
items ``(player_name, total_runs)``; every question is answered by two models
whose rows are perturbed copies of the gold rows (quantities shifted by 0, 0.5,
1 or 1.5; some rows missing; some answers failed; some headers renamed; some
rows one column wider). SQL and question texts come from fixed templates that
exercise every forensic and complexity rule. All selections are arithmetic on
keys, so DuckDB rebuilds the same data in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.sources.tables import table

# Fixture texts.
MODELS = ["gpt-4o", "deepseek_deepseek-r1"]
LANGUAGES = ["English", "Hindi_1", "Hindi_2"]
QUESTIONS = [
    "What is the economy rate of bowlers in the powerplay?",
    "Who has the best strike rate for Delhi?",
    "What is the average score of Royal Challengers Bangalore batters?",
    "Which player scored the most runs in death overs for Kings XI Punjab?",
    "List the top 5 run scorers in 2019",
]
SQL_TEMPLATES = [
    "SELECT P.player_name, SUM(D.runs_scored) AS total_runs FROM Deliveries D JOIN Players P "
    "ON P.player_id = D.striker_id GROUP BY P.player_name",
    "SELECT bowler_id, SUM(runs_scored) * 6.0 / COUNT(*) AS economy FROM Deliveries GROUP BY bowler_id",
    "SELECT match_winner, COUNT(*) FROM Matches WHERE match_winner = 'Delhi Daredevils' GROUP BY match_winner",
    "SELECT striker_id, SUM(runs_scored) FROM Deliveries GROUP BY striker_id",
    "WITH t AS (SELECT striker_id, SUM(runs_scored) AS r FROM Deliveries WHERE over_number <= 5 "
    "GROUP BY striker_id) SELECT * FROM t",
    "SELECT P.player_name, SUM(D.runs_scored) / COUNT(CASE WHEN D.wides = 0 THEN 1 END) AS average "
    "FROM Deliveries D JOIN Players P ON P.player_id = D.striker_id WHERE D.wides = 0 AND M.season = '2019' "
    "GROUP BY P.player_name",
]
GOLD_COLUMNS = ["player_name", "total_runs"]
RENAMED_COLUMNS = ["name", "runs"]
UPPER_COLUMNS = ["PLAYER_NAME", "Total_Runs"]
FAILED_ANSWER = "EXECUTION_ERROR: no such column: total_runs"


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values)).cast("int") + 1)


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def row_name() -> Column:
    return F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("-"),
                    F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lines): every order with its lines, null without any. The gold and the models' answers are made of them on the row, so
    the lines are shuffled once, whatever is asked of them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    rows = (table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, "l_quantity")
            .groupBy("l_orderkey").agg(F.collect_list(F.struct(*LINE_ORDER, "l_quantity", row_name().alias("name"))).alias("lines")))
    return o.join(rows, o.o_orderkey == rows.l_orderkey, "left").select(F.col("o_orderkey").alias("id"), "lines")


def gold_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold entries: id, questions, query, answer (one literal string per row), column names."""
    item = lambda x: F.concat(F.lit("('"), x["name"], F.lit("', "), x["l_quantity"].cast("int").cast("string"), F.lit(")"))
    items = F.sort_array(F.transform("lines", lambda x: F.struct(*[x[c].alias(c) for c in LINE_ORDER], item(x).alias("item"))))
    answer = F.coalesce(F.transform(items, lambda x: x["item"]), F.array().cast("array<string>"))
    q = _pick(QUESTIONS, F.col("id"))
    return (order_lines(spark, sf_dir)
            .select("id",
                    q.alias("question_english"), q.alias("question_hindi_1"), q.alias("question_hindi_2"),
                    _pick(SQL_TEMPLATES, F.col("id")).alias("query"),
                    answer.alias("answer"),
                    F.array(*[F.lit(c) for c in GOLD_COLUMNS]).alias("column_names")))


def benchmark_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records as the benchmark runner writes them (one per model and question)."""
    # One copy per model: a literal explode on the row, no join.
    om = order_lines(spark, sf_dir).withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(len(MODELS))])))
    m = F.col("m")
    shifted = lambda x: x["l_quantity"] + ((x["l_partkey"] + m) % 4).cast("double") * F.lit(0.5)
    wide = F.when((F.col("id") + m) % 19 == 0, F.lit(", 0")).otherwise(F.lit(""))
    item = lambda x: F.concat(F.lit("('"), x["name"], F.lit("', "), shifted(x).cast("string"), wide, F.lit(")"))
    key = lambda x: F.struct(F.when(m == 1, -x["l_linenumber"]).otherwise(x["l_linenumber"]), *[x[c] for c in LINE_ORDER[1:]])
    kept = F.filter("lines", lambda x: ((x["l_partkey"] + m) % 11) != 0)
    items = F.sort_array(F.transform(kept, lambda x: F.struct(key(x).alias("k"), item(x).alias("item"))))
    answer = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(items, lambda x: x["item"]), ", "), F.lit("")), F.lit("]"))
    failed = ((F.col("id") + F.col("m")) % 17) == 0
    cols = (F.when(failed, F.array().cast("array<string>"))
            .when(((F.col("id") + F.col("m")) % 13) == 0, F.array(*[F.lit(c) for c in RENAMED_COLUMNS]))
            .when(((F.col("id") + F.col("m")) % 7) == 0, F.array(*[F.lit(c) for c in UPPER_COLUMNS]))
            .otherwise(F.array(*[F.lit(c) for c in GOLD_COLUMNS])))
    return (om
            .select(F.col("id"),
                    _pick(LANGUAGES, F.col("id")).alias("language"),
                    _pick(QUESTIONS, F.col("id")).alias("question"),
                    _pick(MODELS, F.col("m")).alias("model"),
                    _pick(SQL_TEMPLATES, F.col("id") + F.col("m")).alias("generated_sql"),
                    F.when(failed, F.lit(FAILED_ANSWER)).otherwise(answer).alias("generated_answer"),
                    cols.alias("generated_column_names"),
                    (((F.col("id") * 7 + F.col("m") * 3) % 100).cast("double") / F.lit(10.0)).alias("time_taken")))


def schema_only_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run of the same models: every fifth answer failed, every third header renamed."""
    r = benchmark_results(spark, sf_dir)
    m = F.when(F.col("model") == MODELS[0], 0).otherwise(1)
    return (r.withColumn("generated_answer", F.when((F.col("id") + m) % 5 == 0, F.lit(FAILED_ANSWER)).otherwise(F.col("generated_answer")))
            .withColumn("generated_column_names", F.when(F.col("id") % 3 == 0, F.array(*[F.lit(c) for c in RENAMED_COLUMNS]))
                        .otherwise(F.col("generated_column_names"))))
