"""Registered queries around benchmark runs: query sets, resume joins, file readers, sinks, and their oracles."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators import dataset as D
from crease.operators import reports as R
from crease.operators import resume as S
from crease.operators.compare import bag_overlap
from crease.operators.dense_ids import numbered
from crease.operators.forensics import team_mention
from crease.operators.ingest import ingest
from crease.operators.metrics import player_debuts
from crease.operators.queryset import headers_of, run_query_set, validation_counts
from crease.plans.dataset_queries import _raw_outputs, sql_cleaning
from crease.plans.eval_queries import _BASE, _case_text, _string_errors_sql, ORACLES as EVAL_ORACLES
from crease.plans.grading_queries import ENDLESS, SHORT
from crease.plans.ingest_queries import _INGEST_CTES
from crease.plans.oracle_base import with_adapter
from crease.session import checkpoint_dir
from crease.sources import eval_fixtures as X
from crease.sources.adapter import cricket_tables
from crease.sources.match_docs import build_match_documents, docs_from_json
from crease.sources.tables import register_views, table

#: Statements of the query set: large and small results, an error, two that are refused, and one that its time limit ends.
STATEMENTS = [
    ("all_orders", "SELECT o_orderkey, o_orderstatus FROM orders"),
    ("returned_parts", "-- parts sent back\nSELECT l_partkey, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey;"),
    ("no_column", "SELECT no_such_column FROM orders"),
    ("drop_it", "DROP VIEW orders"),
    ("insert_it", "WITH x AS (SELECT 1 AS a) INSERT INTO orders SELECT a FROM x"),
    ("endless", ENDLESS, SHORT),
]


def _query_set(spark, sf_dir):
    register_views(spark, sf_dir, ("orders", "lineitem"))
    return run_query_set(spark, STATEMENTS, timeout_s=3600.0)


def queryset_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1/Q2: every row of every statement that ran."""
    return _query_set(spark, sf_dir)[1].select("key", "row")


def queryset_status(spark, sf_dir):
    """Q4/Q5: status and result text of every statement; of Spark's own message its class."""
    result = F.regexp_extract("result", r"^(ERROR: Query Timed Out|EXECUTION_ERROR: (?:\[[A-Z_.]+\]|only queries are run))", 1)
    return _query_set(spark, sf_dir)[0].select("key", "status", F.array_join("headers", ",").alias("headers"), "n_rows",
                                               F.coalesce(result, F.lit("")).alias("result"))


def queryset_counts(spark, sf_dir):
    return validation_counts(_query_set(spark, sf_dir)[0])


def _shared(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def gold_positions(spark, sf_dir):
    """Blocks of 16 gold entries as JSON arrays; ids are positions."""
    g = X.gold_dataset(spark, sf_dir).select(F.floor(F.col("id") / 16).cast("long").alias("block"), "id", "query", "answer")
    texts = (g.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "query", "answer"))).alias("a"))
             .select("block", F.when(F.col("block") % 50 == 7, F.lit("[{broken")).otherwise(F.to_json("a")).alias("value")))
    return S.gold_positions(texts, keys=("block",)).select("block", "id", "query", F.size("answer").alias("answer_lines"))


def resume_offset(spark, sf_dir):
    """The tail of the work list after the records of one model and language, up to a limit."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), "o_custkey")
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return S.rest_of(o, done, 1_000_000)


def resume_grading(spark, sf_dir):
    """Orders of which no line item was sent back yet."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    return S.ungraded(o, table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("idx")).distinct())


def translation_join(spark, sf_dir):
    """Translations for two of the questions, made from the parts table's size."""
    t = spark.createDataFrame([(q, f"[{q[::-1]}]") for q in X.QUESTIONS[:2]], "question string, translation string")
    return S.translated(X.gold_dataset(spark, sf_dir), t, "question_english", "question_hindi_1").select("id", "question_hindi_1")


def review_records(spark, sf_dir):
    g = X.gold_dataset(spark, sf_dir).withColumn("query", F.when(F.col("id") % 10 == 3, F.lit("ERROR: none")).otherwise(F.col("query")))
    again = X.benchmark_results(spark, sf_dir).filter((F.col("model") == X.MODELS[0]) & (F.col("id") % 2 == 0))
    return S.review_records(g, again.select("id", F.upper("question").alias("generated_question")))


def _raw_headers(spark, sf_dir) -> dict[str, list[str]]:
    """The header of each different gold statement that can be analysed, without running it."""
    for name, df in vars(cricket_tables(spark, sf_dir)).items():
        df.createOrReplaceTempView({"player_in_match": "PlayerInMatch", "fielder_dismissals": "FielderDismissals"}.get(name, name))
    found = {}
    for sql in X.SQL_TEMPLATES:
        try:
            found[sql] = headers_of(spark, sql)
        except AnalysisException:
            continue
    return found


def _enriched(spark, sf_dir):
    """A model's cleaned names, one name too few for every third entry."""
    raw = F.create_map(*[x for sql, names in _raw_headers(spark, sf_dir).items() for x in (F.lit(sql), F.array(*[F.lit(n) for n in names]))])
    g = X.gold_dataset(spark, sf_dir).select("id", F.try_element_at(raw, F.col("query")).alias("raw"))
    names = F.transform("raw", D.clean_header)
    return S.enriched(g.withColumn("cleaned", F.when(F.col("id") % 3 == 0, F.slice(names, 1, 1)).otherwise(names)))


def header_enrichment(spark, sf_dir):
    """Entries by the column names they get."""
    return _enriched(spark, sf_dir).groupBy(F.array_join("column_names", "|").alias("names")).agg(F.count(F.lit(1)).alias("n"))


def enrichment_counts(spark, sf_dir):
    """Entries with and without column names."""
    return S.enrichment_counts(_enriched(spark, sf_dir))


def prompts(spark, sf_dir):
    """The text given to a model: rules for questions that name a team only, evidence where there is some."""
    g = X.gold_dataset(spark, sf_dir)
    team = team_mention(F.col("question_english"))
    return g.select("id", D.prompt_text(F.lit("TABLES: Matches, Deliveries"), F.col("question_english"), F.col("column_names"), F.when(team, F.lit("RULE: teams were renamed")),
                                        "COLUMNS: %s", F.when(F.col("id") % 4 == 0, F.concat(F.lit("HINT: order "), F.col("id").cast("string")))).alias("prompt"))


def log_entries(spark, sf_dir):
    """K3, K6: the text log of a run, written in order and read back."""
    path = _shared(spark, "log")
    r = X.benchmark_results(spark, sf_dir).filter(F.col("model") == X.MODELS[0])
    status = F.when(F.col("generated_answer") == X.FAILED_ANSWER, "ERROR").otherwise("SUCCESS")
    S.write_text(r.select("id", S.log_text(F.col("question"), F.col("generated_sql"), status).alias("text")), path, ["id"])
    lines = spark.read.text(path).select(F.split("value", ": ", 2)[0].alias("kind"), F.col("value"))
    return lines.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def latest_files(spark, sf_dir):
    """Two files of one family; the last by name counts."""
    r = X.benchmark_results(spark, sf_dir)
    rerun = r.filter((F.col("model") == X.MODELS[0]) & (F.col("id") % 2 == 0)).withColumn("model", F.lit(X.MODELS[0] + "-rerun"))
    return R.last_file_wins(R.string_error_analysis(X.gold_dataset(spark, sf_dir), r.unionByName(rerun))).select(
        "short_name", "model", "total_queries", "total_errors", "hallucination", "aggregation")


def complexity_rows(spark, sf_dir):
    """The complexity table's lines."""
    return R.complexity_rows(R.complexity_counts(X.gold_dataset(spark, sf_dir)))


def debut_order(spark, sf_dir):
    """L4: players in order of debut, then name and id, each with its place."""
    d = player_debuts(cricket_tables(spark, sf_dir)).select("debut_date", "player_name", "player_id")
    return numbered(d, ["debut_date", "player_name", "player_id"], "place")


def repair_counts(spark, sf_dir):
    c = sql_cleaning(spark, sf_dir)
    rows = c.select("id", "model", F.col("cleaned_sql").alias("generated_sql"), "execution_result",
                    (~F.col("invalid_sql")).alias("execution_success"), F.lit(0.0).alias("time_taken"))
    fixes = c.filter("needs_repair AND id % 8 = 3").select(
        "id", "model", F.lit("SELECT 1").alias("generated_sql"), F.lit("[(1,)]").alias("execution_result"),
        F.lit(True).alias("execution_success"), F.lit(1.5).alias("time_taken"))
    return S.repair_counts(D.repair_merge(rows, fixes, ["id", "model"]), D.needs_repair(F.col("generated_sql")))


def latency_records(spark, sf_dir):
    """Durations to two decimals, short model names."""
    return X.benchmark_results(spark, sf_dir).select("id", R.short_name(F.col("model")).alias("family"),
                                                     F.round(F.col("time_taken") / 7, 2).alias("time_taken"))


def latex_rows(spark, sf_dir):
    e = R.string_error_analysis(X.gold_dataset(spark, sf_dir), X.benchmark_results(spark, sf_dir))
    return R.latex_rows(e)


def context_comparison(spark, sf_dir):
    """Two runs of the same models, evaluated together."""
    both = (X.benchmark_results(spark, sf_dir).withColumn("mode", F.lit("context"))
            .unionByName(X.schema_only_results(spark, sf_dir).withColumn("mode", F.lit("schema_only"))))
    return R.context_comparison(R.evaluate(X.gold_dataset(spark, sf_dir), both))


def bag_overlaps(spark, sf_dir):
    """Status letters of an order's line items against those of its neighbour."""
    li = table(spark, sf_dir, "lineitem")
    a = li.select(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("row_text"))
    return bag_overlap(a, a.withColumn("id", F.col("id") + 1), ["id"])


def placeholder_row(spark, sf_dir):
    """U4: the customers of each order, and one placeholder whose id is their number."""
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("generated_sql"))
    return D.append_placeholder(r, {"generated_sql": "SKIPPED"})


def team_mentions(spark, sf_dir):
    """Questions that name a team."""
    g = X.gold_dataset(spark, sf_dir)
    return g.select("id", team_mention(F.col("question_english")).alias("names_team"))


def ingest_json_rejects(spark, sf_dir):
    """Documents as JSON texts, every hundredth cut off, read with the files' schema and loaded."""
    docs = build_match_documents(spark, sf_dir)
    text = F.to_json(F.struct("info", "innings"))
    cut = F.when(F.col("match_id") % 100 == 42, F.substring(text, 1, 40)).otherwise(text)
    return ingest(docs_from_json(docs.select("match_id", cut.alias("json")))).rejected_files


QUERIES = {f.__name__: f for f in (
    queryset_results, queryset_status, queryset_counts, gold_positions, resume_offset, resume_grading, translation_join,
    review_records, header_enrichment, enrichment_counts, prompts, log_entries, latest_files, complexity_rows, debut_order, repair_counts, latency_records, latex_rows, context_comparison, bag_overlaps, placeholder_row,
    team_mentions, ingest_json_rejects)}

_SQL = "(" + _case_text(X.SQL_TEMPLATES, "o_orderkey") + ")"
_Q = "(" + _case_text(X.QUESTIONS, "o_orderkey") + ")"
_NEED = "(cleaned LIKE '%API_ERROR%' OR trim(cleaned) = '' OR contains(lower(cleaned), 'timeout'))"
_TOTALS = """SELECT model, COUNT(*) AS n, COUNT(CASE WHEN executed THEN 1 END) AS executed, COUNT(CASE WHEN schema_ok THEN 1 END) AS schema_ok,
  SUM(score) AS score FROM {source} GROUP BY model"""
_NAMES = """CASE WHEN o_orderkey % 6 = 5 THEN '' WHEN o_orderkey % 3 = 0 THEN
  CASE o_orderkey % 6 WHEN 0 THEN 'player_name|total_runs' ELSE 'striker_id|sum(runs_scored)' END
  ELSE CASE o_orderkey % 6 WHEN 1 THEN 'Bowler Id|Economy' WHEN 2 THEN 'Match Winner|Count(1)' ELSE 'Striker Id|R' END END"""

ORACLES = {
    "queryset_results": """
SELECT 'all_orders' AS key, '{"c0":' || o_orderkey || ',"c1":"' || o_orderstatus || '"}' AS row FROM orders
UNION ALL SELECT 'returned_parts', '{"c0":' || l_partkey || ',"c1":' || COUNT(*) || '}' FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey""",
    "queryset_status": """
SELECT 'all_orders' AS key, 'ok' AS status, 'o_orderkey,o_orderstatus' AS headers, (SELECT COUNT(*) FROM orders) AS n_rows, '' AS result
UNION ALL SELECT 'returned_parts', 'ok', 'l_partkey,n', (SELECT COUNT(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag = 'R'), ''
UNION ALL SELECT 'no_column', 'error', '', 0, 'EXECUTION_ERROR: [UNRESOLVED_COLUMN.WITH_SUGGESTION]'
UNION ALL SELECT 'drop_it', 'refused', '', 0, 'EXECUTION_ERROR: only queries are run'
UNION ALL SELECT 'insert_it', 'refused', '', 0, 'EXECUTION_ERROR: only queries are run'
UNION ALL SELECT 'endless', 'timeout', '', 0, 'ERROR: Query Timed Out'""",
    "queryset_counts": "SELECT 2::BIGINT AS success, 4::BIGINT AS errors",
    "gold_positions": f"""
SELECT CAST(floor(o_orderkey / 16) AS BIGINT) AS block,
       CAST(row_number() OVER (PARTITION BY floor(o_orderkey / 16) ORDER BY o_orderkey) - 1 AS BIGINT) AS id, {_SQL} AS query,
       CAST((SELECT COUNT(*) FROM lineitem l WHERE l.l_orderkey = o_orderkey) AS INTEGER) AS answer_lines
FROM orders WHERE CAST(floor(o_orderkey / 16) AS BIGINT) % 50 <> 7""",
    "resume_offset": "SELECT o_orderkey AS idx, o_custkey FROM orders WHERE o_orderkey >= (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F') AND o_orderkey < 1000000",
    "resume_grading": "SELECT o_orderkey AS idx FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "translation_join": f"""
SELECT o_orderkey AS id, CASE o_orderkey % 5 {' '.join(f"WHEN {i} THEN '[' || reverse({_Q}) || ']'" for i in range(2))} ELSE {_Q} END AS question_hindi_1
FROM orders""",
    "review_records": f"""
SELECT o_orderkey AS id, {_Q} AS question_english, {_SQL} AS query,
       CASE WHEN o_orderkey % 2 = 0 THEN upper({_Q}) ELSE '' END AS generated_question
FROM orders WHERE o_orderkey % 10 <> 3""",
    "header_enrichment": f"SELECT {_NAMES} AS names, COUNT(*) AS n FROM orders GROUP BY 1",
    "enrichment_counts": f"SELECT COUNT(CASE WHEN {_NAMES} <> '' THEN 1 END) AS enriched, COUNT(CASE WHEN {_NAMES} = '' THEN 1 END) AS empty FROM orders",
    "prompts": f"""
SELECT o_orderkey AS id, concat_ws(chr(10), 'TABLES: Matches, Deliveries', CASE WHEN o_orderkey % 5 IN (1, 2, 3) THEN 'RULE: teams were renamed' END, {_Q},
       'COLUMNS: player_name, total_runs', CASE WHEN o_orderkey % 4 = 0 THEN 'HINT: order ' || o_orderkey END) AS prompt FROM orders""",
    "log_entries": f"""
WITH r AS (SELECT {_Q} AS q, {_SQL} AS s, CASE WHEN o_orderkey % 17 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS st FROM orders),
l AS (SELECT 'QUERY' AS kind, 'QUERY: ' || q AS value FROM r UNION ALL SELECT 'SQL', 'SQL: ' || s FROM r UNION ALL SELECT 'STATUS', 'STATUS: ' || st FROM r
      UNION ALL SELECT '', '' FROM r)
SELECT kind, value, COUNT(*) AS n FROM l GROUP BY 1, 2""",
    "latest_files": f"""
WITH a AS ({EVAL_ORACLES["eval_string_errors"]}), b AS ({_string_errors_sql("WHERE om.m = 0 AND om.id % 2 = 0")})
SELECT 'GPT-4o' AS short_name, model || '-rerun' AS model, total_queries, total_errors, hallucination, aggregation FROM b
UNION ALL SELECT 'DeepSeek-R1', model, total_queries, total_errors, hallucination, aggregation FROM a WHERE model = '{X.MODELS[1]}'""",
    "complexity_rows": f"""
WITH c AS ({EVAL_ORACLES["eval_complexity"]})
SELECT CASE complexity_class {' '.join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(R.COMPLEXITY_LABELS))} END::INTEGER AS line_no,
       CASE complexity_class {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.COMPLEXITY_LABELS.items())} END || ' & ' || n || ' & ' || printf('%.1f', pct)
       || '""" + chr(92) + "% " + chr(92) * 2 + """' AS text FROM c""",
    "debut_order": with_adapter("""
SELECT debut_date, player_name, player_id, row_number() OVER (ORDER BY debut_date, player_name, player_id) AS place
FROM (SELECT x.player_id, p.player_name, MIN(m.match_date) AS debut_date
      FROM player_in_match x JOIN matches m ON m.match_id = x.match_id JOIN players p ON p.player_id = x.player_id GROUP BY 1, 2) d"""),
    "repair_counts": f"""
WITH c AS (SELECT o_orderkey AS id, m, CASE WHEN o_orderkey % 4 = 3 THEN 'API_ERROR: upstream timeout' ELSE 'SELECT' END AS cleaned
           FROM orders CROSS JOIN (VALUES (0), (1)) t(m))
SELECT COUNT(*) AS total, COUNT(CASE WHEN {_NEED} THEN 1 END) AS selected, COUNT(CASE WHEN {_NEED} AND id % 8 = 3 THEN 1 END) AS repaired,
       COUNT(CASE WHEN {_NEED} AND id % 8 <> 3 THEN 1 END) AS left_over FROM c""",
    "latency_records": """
SELECT o_orderkey AS id, CASE m WHEN 0 THEN 'GPT-4o' ELSE 'DeepSeek-R1' END AS family,
       round(CAST((o_orderkey * 7 + m * 3) % 100 AS DOUBLE) / 10.0::DOUBLE / 7, 2) AS time_taken
FROM orders CROSS JOIN (VALUES (0), (1)) t(m)""",
    "latex_rows": f"""
WITH e AS ({EVAL_ORACLES["eval_string_errors"]}),
x AS (SELECT model, CASE WHEN total_errors = 0 THEN ['% ' || model || ': Perfect Score (0 Errors)'] ELSE [
  '% Stats for ' || model || ' (N=' || total_errors || ' errors)', {', '.join(
      f"'{label} & ' || {c} || ' & ' || printf('%.1f', {c} / total_errors * 100) || '" + chr(92) + "% " + chr(92) * 2 + "'"
      for label, c in zip(R.LABELS, ["hallucination", "legal_ball", "team_mapping", "phase_filter", "aggregation"]))}] END AS ls FROM e)
SELECT model, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS text FROM x""",
    "context_comparison": _BASE + f""",
w AS (SELECT model, CASE WHEN (id + m) % 5 = 0 THEN FALSE ELSE executed END AS executed, schema_ok AND id % 3 <> 0 AS schema_ok,
             CASE WHEN (id + m) % 5 = 0 THEN 0.0 ELSE score END AS score FROM lab),
a AS ({_TOTALS.format(source='lab')}), b AS ({_TOTALS.format(source='w')}),
p AS (SELECT a.model, {', '.join(f"round({t}.{c} * 100.0::DOUBLE / {t}.n, 6) AS {m}_{c}_pct" for m, t in (('context', 'a'), ('schema_only', 'b')) for c in ('executed', 'schema_ok', 'score'))}
      FROM a LEFT JOIN b ON a.model = b.model)
SELECT *, round(context_score_pct - schema_only_score_pct, 6) AS score_gain FROM p""",
    "bag_overlaps": """
WITH a AS (SELECT l_orderkey AS id, l_returnflag || l_linestatus AS r, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT x.id, CAST(SUM(least(x.n, y.n)) AS BIGINT) AS common_rows FROM a x JOIN a y ON x.id = y.id + 1 AND x.r = y.r GROUP BY x.id""",
    "placeholder_row": "SELECT o_orderkey AS id, o_orderstatus AS generated_sql FROM orders UNION ALL SELECT COUNT(*), 'SKIPPED' FROM orders",
    "team_mentions": "SELECT o_orderkey AS id, o_orderkey % 5 IN (1, 2, 3) AS names_team FROM orders",
    "ingest_json_rejects": with_adapter("""
SELECT match_id, CASE WHEN match_id % 100 = 42 THEN 'unreadable document' ELSE reject_reason END AS reject_reason
FROM (SELECT m.match_id, b.reject_reason FROM matches m LEFT JOIN bad b ON b.match_id = m.match_id) x
WHERE match_id % 100 = 42 OR reject_reason IS NOT NULL""", _INGEST_CTES),
}
