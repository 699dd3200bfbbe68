"""Registered evaluation queries (E1-E13, A15-A23, Q8) and their oracles.

The oracle rebuilds gold and generated rows directly from ``lineitem`` (no
text parsing) and scores them with joins: generated row names are unique per
question, so the greedy one-to-one match reduces to an equi-join on the name
plus the tolerance test. The greedy matcher itself is checked against a
brute-force Python implementation on random bags in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators import reports as R
from crease.operators.forensics import complexity_flags, error_labels
from crease.sources import eval_fixtures as X
from crease.sources.tables import table


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evaluate(X.gold_dataset(spark, sf_dir), X.benchmark_results(spark, sf_dir))


def q_item_scores(spark, sf_dir):
    return R.item_scores(_evaluated(spark, sf_dir))


def q_model_summary(spark, sf_dir):
    return R.model_summary(_evaluated(spark, sf_dir))


def q_language_breakdown(spark, sf_dir):
    return R.language_breakdown(_evaluated(spark, sf_dir))


def q_failure_counts(spark, sf_dir):
    return R.failure_counts(_evaluated(spark, sf_dir))


def q_forensic_counts(spark, sf_dir):
    return R.forensic_counts(_evaluated(spark, sf_dir))


def q_report_lines(spark, sf_dir):
    return R.report_lines(_evaluated(spark, sf_dir))


def q_string_errors(spark, sf_dir):
    return R.string_error_analysis(X.gold_dataset(spark, sf_dir), X.benchmark_results(spark, sf_dir))


def q_complexity(spark, sf_dir):
    return R.complexity_counts(X.gold_dataset(spark, sf_dir))


#: Parts of a statement and of a question, each there if its bit of the order key is set.
SQL_PARTS = ["venue_id", "match_year", "D.wides = 0", "CASE WHEN 1 = 1 THEN 1 END", "'Deccan Chargers'", "over_number < 6", "SUM(x)", "a / b", "x JOIN y"]
QUESTION_PARTS = ["Economy", "in Delhi", "death overs", "an Average", "Rising Pune stars"]


def forensic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on texts put together from all combinations of parts; the oracle decides by the bits, not by words."""
    key = F.col("o_orderkey")
    bit = lambda i: F.shiftright(key, i).bitwiseAND(F.lit(1)) == 1
    joined = lambda parts, first: F.concat_ws(" , ", *[F.when(bit(first + i), p) for i, p in enumerate(parts)])
    sql = F.concat(F.lit("select 1 , "), joined(SQL_PARTS, 0))
    question = joined(QUESTION_PARTS, len(SQL_PARTS))
    texts = table(spark, sf_dir, "orders").select(key.alias("id"), sql.alias("sql"), question.alias("q"))
    labels = lambda variant: F.array_join(error_labels(F.col("sql"), F.col("q"), variant), "|")
    classes = F.concat_ws("|", *[F.when(c, k) for k, c in complexity_flags(F.col("sql"), F.col("q")).items()])
    return texts.select("id", labels(False).alias("labels"), labels(True).alias("variant_labels"), classes.alias("classes"))


QUERIES = {
    "forensic_rules": forensic_rules,
    "eval_item_scores": q_item_scores,
    "eval_model_summary": q_model_summary,
    "eval_language_breakdown": q_language_breakdown,
    "eval_failure_counts": q_failure_counts,
    "eval_forensic_counts": q_forensic_counts,
    "eval_report_lines": q_report_lines,
    "eval_string_errors": q_string_errors,
    "eval_complexity": q_complexity,
}


# --- oracles ------------------------------------------------------------------

def _case(values, key):
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({key}) % {len(values)} {whens} END"


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case_text(values, key):
    whens = " ".join(f"WHEN {i} THEN {_sql_lit(v)}" for i, v in enumerate(values))
    return f"CASE ({key}) % {len(values)} {whens} END"


_NAME = ("'P' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || "
         "CAST(l_suppkey AS VARCHAR)")


def _rules_sql(sql: str, q: str, variant: bool) -> list[str]:
    from crease.operators import forensics as FO
    cols = FO.HALLUCINATED_COLUMNS_VARIANT if variant else FO.HALLUCINATED_COLUMNS

    def anyc(col, words):
        return "(" + " OR ".join(f"contains({col}, {_sql_lit(w)})" for w in words) + ")"
    return [
        anyc(sql, cols),
        f"({anyc(q, FO.RATE_WORDS)} AND NOT contains({sql}, 'WIDES'))",
        f"({anyc(q, FO.FRANCHISE_PLACES)} AND NOT contains({sql}, 'CASE') AND {anyc(sql, FO.OLD_TEAM_MARKERS)})",
        f"({anyc(q, FO.PHASE_WORDS)} AND NOT contains({sql}, 'OVER_NUMBER'))",
        f"(contains({q}, 'average') AND contains({sql}, 'SUM(') AND NOT contains({sql}, '/'))",
    ]


_BASE = f"""
WITH om AS (SELECT o_orderkey AS id, 0 AS m FROM orders UNION ALL SELECT o_orderkey, 1 FROM orders),
gl AS (SELECT l_orderkey AS id, {_NAME} AS name, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS qty FROM lineitem),
vl AS (SELECT m, l_orderkey AS id, {_NAME} AS name,
              l_quantity + CAST((l_partkey + m) % 4 AS DOUBLE) * 0.5 AS qty
       FROM (SELECT *, 0 AS m FROM lineitem UNION ALL SELECT *, 1 AS m FROM lineitem) x
       WHERE (l_partkey + m) % 11 <> 0),
ng AS (SELECT id, COUNT(*) AS n_gold FROM gl GROUP BY id),
nv AS (SELECT m, id, COUNT(*) AS n_gen FROM vl GROUP BY m, id),
mt AS (SELECT v.m, v.id, COUNT(*) AS matches FROM gl g JOIN vl v ON v.id = g.id AND v.name = g.name
       WHERE abs(g.qty - v.qty) <= 1.0 GROUP BY v.m, v.id),
res AS (
  SELECT om.id, om.m, {_case(X.MODELS, 'om.m')} AS model, {_case(X.LANGUAGES, 'om.id')} AS language,
         {_case_text(X.QUESTIONS, 'om.id')} AS question,
         {_case_text(X.SQL_TEMPLATES, 'om.id + om.m')} AS generated_sql,
         (om.id + om.m) % 17 = 0 AS failed, (om.id + om.m) % 19 = 0 AS wide,
         (om.id + om.m) % 17 <> 0 AND (om.id + om.m) % 13 <> 0 AS schema_ok,
         CAST((om.id * 7 + om.m * 3) % 100 AS DOUBLE) / 10.0 AS time_taken,
         COALESCE(ng.n_gold, 0) AS n_gold,
         CASE WHEN (om.id + om.m) % 17 = 0 THEN 0 ELSE COALESCE(nv.n_gen, 0) END AS n_gen,
         CASE WHEN (om.id + om.m) % 17 = 0 OR (om.id + om.m) % 19 = 0 OR COALESCE(ng.n_gold, 0) = 0 THEN 0
              ELSE COALESCE(mt.matches, 0) END AS matches
  FROM om LEFT JOIN ng ON ng.id = om.id LEFT JOIN nv ON nv.id = om.id AND nv.m = om.m
  LEFT JOIN mt ON mt.id = om.id AND mt.m = om.m),
sc AS (
  SELECT *, NOT failed AS executed,
         CASE WHEN NOT failed AND n_gold > 0 THEN CAST(matches AS DOUBLE) / CAST(n_gold AS DOUBLE) ELSE 0.0 END AS score
  FROM res),
ev AS (
  SELECT *,
         CASE WHEN failed THEN 'Execution Error'
              WHEN n_gold > 0 AND score < 1.0 THEN
                CASE WHEN NOT schema_ok THEN 'Schema Mismatch' WHEN n_gold <> n_gen THEN 'Row Count Mismatch'
                     ELSE 'Value Mismatch' END END AS failure_class,
         failed OR (n_gen > 0 AND score < 1.0) AS needs_forensics,
         upper(generated_sql) AS usql, lower(question || ' ' || language) AS lq
  FROM sc),
lab AS (
  SELECT *, CASE WHEN needs_forensics THEN concat_ws('|', {', '.join(
      f"CASE WHEN {cond} THEN {_sql_lit(lbl)} END" for cond, lbl in zip(_rules_sql('usql', 'lq', False), R.LABELS))})
      ELSE '' END AS forensic_labels
  FROM ev)
"""

_PCT = "ROUND(CASE WHEN {b} > 0 THEN COALESCE({a}, 0.0) * 100.0 / {b} ELSE 0.0 END, 6)"

ORACLES = {
    "eval_item_scores": _BASE + """
SELECT model, id, language, executed, schema_ok, CAST(matches AS INTEGER) AS matches, score, failure_class,
       forensic_labels FROM lab""",

    "eval_model_summary": _BASE + f"""
SELECT model, total_queries, exec_success, schema_matches, ROUND(s, 6) AS data_match_score,
       ROUND(COALESCE(lat, 0.0), 6) AS avg_latency,
       {_PCT.format(a='CAST(exec_success AS DOUBLE)', b='total_queries')} AS exec_pct,
       {_PCT.format(a='CAST(schema_matches AS DOUBLE)', b='total_queries')} AS schema_pct,
       {_PCT.format(a='s', b='total_queries')} AS data_pct,
       {_PCT.format(a='es', b='en')} AS english_pct,
       {_PCT.format(a='hs', b='hn')} AS hindi_pct
FROM (SELECT model, COUNT(*) AS total_queries, COUNT(CASE WHEN executed THEN 1 END) AS exec_success,
             COUNT(CASE WHEN schema_ok THEN 1 END) AS schema_matches, SUM(score) AS s, AVG(time_taken) AS lat,
             SUM(CASE WHEN language = 'English' THEN score END) AS es,
             COUNT(CASE WHEN language = 'English' THEN 1 END) AS en,
             SUM(CASE WHEN language IN ('Hindi_1', 'Hindi_2') THEN score END) AS hs,
             COUNT(CASE WHEN language IN ('Hindi_1', 'Hindi_2') THEN 1 END) AS hn
      FROM lab GROUP BY model) a""",

    "eval_language_breakdown": _BASE + """
SELECT model, language, COUNT(*) AS n, COUNT(CASE WHEN executed THEN 1 END) AS exec_success,
       ROUND(SUM(score), 6) AS data_match_score, ROUND(SUM(score) * 100.0 / COUNT(*), 6) AS data_pct
FROM lab WHERE language IN ('English', 'Hindi_1', 'Hindi_2') GROUP BY model, language""",

    "eval_failure_counts": _BASE + """
SELECT model, failure_class, COUNT(*) AS n FROM lab WHERE failure_class IS NOT NULL GROUP BY model, failure_class""",

    "eval_forensic_counts": _BASE + """,
lbl AS (SELECT model, unnest(string_split(forensic_labels, '|')) AS label FROM lab WHERE forensic_labels <> ''),
tot AS (SELECT model, greatest(CAST(COUNT(*) AS DOUBLE) - SUM(score), 1.0) AS failures FROM lab GROUP BY model)
SELECT l.model, label, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / MIN(failures), 6) AS share_pct
FROM lbl l JOIN tot t ON t.model = l.model GROUP BY l.model, label""",

    "eval_complexity": None,  # filled below
}



def _report_sql() -> str:
    """The report block written out from its text, one row per line."""
    langs, classes = R.REPORT_LANGUAGES, R.BASIC_CLASSES
    totals = ", ".join(
        [f"SUM(CASE WHEN language = '{x}' THEN score END) AS ls{i}, COUNT(CASE WHEN language = '{x}' THEN 1 END) AS ln{i}" for i, x in enumerate(langs)]
        + [f"COUNT(CASE WHEN failure_class = '{x}' THEN 1 END) AS c{i}" for i, x in enumerate(classes)]
        + [f"COUNT(CASE WHEN list_contains(string_split(forensic_labels, '|'), '{x}') THEN 1 END) AS f{i}" for i, x in enumerate(R.LABELS)])
    share = "printf('%d/%d (%.1f%%)', {0}, n, {0} * 100.0::DOUBLE / n)"
    lines = ["'MODEL: ' || model", f"'{'-' * 40}'", "printf('Total Queries: %d', n)", "printf('Avg Latency:   %.2fs per query', lat)", "''", "'METRICS:'",
             f"'  Execution Success:  ' || {share.format('ex')}", f"'  Schema Compliance:  ' || {share.format('so')}",
             "printf('  Data Match Score:   %.1f/%d (%.1f%%)', s, n, s * 100.0::DOUBLE / n)", "''", "'LANGUAGE BREAKDOWN (Data Match %):'"]
    lines += [f"CASE WHEN ln{i} > 0 THEN printf('  {x:<10}: %.1f%%', ls{i} / ln{i} * 100) END" for i, x in enumerate(langs)]
    lines += ["''", "'BASIC FAILURE COUNTS:'"] + [f"CASE WHEN c{i} > 0 THEN printf('  {x:<20}: %d', c{i}) END" for i, x in enumerate(classes)]
    lines += ["''", "'FORENSIC ERROR ANALYSIS (Semantic Causes):'"]
    lines += [f"CASE WHEN f{i} > 0 THEN printf('  {x:<25}: %d (%.1f%% of failures)', f{i}, f{i} / greatest(n - s, 1) * 100) END" for i, x in enumerate(R.LABELS)]
    lines += ["''", f"'{'=' * 60}'", "''"]
    return _BASE + f""",
t AS (SELECT model, COUNT(*) AS n, COUNT(CASE WHEN executed THEN 1 END) AS ex, COUNT(CASE WHEN schema_ok THEN 1 END) AS so,
             SUM(score) AS s, SUM(time_taken) / COUNT(*) AS lat, {totals} FROM lab GROUP BY model),
x AS (SELECT model, [v for v in [{', '.join(lines)}] if v IS NOT NULL] AS ls FROM t)
SELECT model, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS text FROM x"""


ORACLES["eval_report_lines"] = _report_sql()

ORACLES["forensic_rules"] = """
WITH b AS (SELECT o_orderkey AS id, """ + ", ".join(f"(o_orderkey >> {i}) & 1 = 1 AS b{i}" for i in range(14)) + """ FROM orders),
f AS (SELECT *, b9 AND NOT b2 AS legal, (b10 OR b13) AND b4 AND NOT b3 AS team, b11 AND NOT b5 AS phase, b12 AND b6 AND NOT b7 AS agg FROM b),
r AS (SELECT *, concat_ws('|', CASE WHEN legal THEN 'Legal Delivery Logic' END, CASE WHEN team THEN 'Team Entity Resolution' END,
                          CASE WHEN phase THEN 'Phase Filtering' END, CASE WHEN agg THEN 'Incorrect Aggregation' END) AS rest FROM f)
SELECT id, concat_ws('|', CASE WHEN b0 OR b1 THEN 'Hallucinated Schema' END, nullif(rest, '')) AS labels,
       concat_ws('|', CASE WHEN b1 THEN 'Hallucinated Schema' END, nullif(rest, '')) AS variant_labels,
       concat_ws('|', CASE WHEN b8 THEN 'joins' END, CASE WHEN b1 THEN 'temporal' END, CASE WHEN b3 OR b13 THEN 'franchise' END,
                 CASE WHEN b9 OR b12 THEN 'derived' END) AS classes
FROM r"""

# Complexity classes over the gold dataset (one row per order).
_CX_Q = f"lower({_case_text(X.QUESTIONS, 'o_orderkey')} || ' ' || {_case_text(X.QUESTIONS, 'o_orderkey')})"
_CX_S = f"upper({_case_text(X.SQL_TEMPLATES, 'o_orderkey')})"


def _complexity_sql() -> str:
    from crease.operators import forensics as FO

    def anyc(col, words):
        return "(" + " OR ".join(f"contains({col}, {_sql_lit(w)})" for w in words) + ")"
    conds = {
        "joins": "contains(s, ' JOIN ')",
        "nested": "(regexp_matches(s, '\\(\\s*SELECT') OR contains(s, 'WITH '))",
        "aggregations": "(contains(s, 'GROUP BY') OR contains(s, 'HAVING'))",
        "temporal": anyc("s", FO.TEMPORAL_MARKERS),
        "franchise": f"(contains(s, 'CASE WHEN') OR {anyc('q', FO.HISTORICAL_NAMES)})",
        "derived": f"({anyc('q', FO.DERIVED_WORDS)} OR (contains(s, '/') AND contains(s, 'COUNT')))",
    }
    counts = ",\n  ".join(f"COUNT(CASE WHEN {c} THEN 1 END) AS {k}" for k, c in conds.items())
    rows = " UNION ALL ".join(f"SELECT '{k}' AS complexity_class, {k} AS n, ROUND({k} * 100.0 / total, 6) AS pct FROM a"
                              for k in conds)
    return f"""WITH t AS (SELECT {_CX_S} AS s, {_CX_Q} AS q FROM orders),
a AS (SELECT COUNT(*) AS total,
  {counts}
FROM t)
{rows}"""


ORACLES["eval_complexity"] = _complexity_sql()

# String comparison (X9) with the variant rules.
_X9 = """CASE WHEN {c} IS NULL THEN ''
  WHEN contains(lower(trim({c})), 'error') OR contains(lower(trim({c})), 'timeout') THEN 'ERROR_FLAG'
  WHEN TRY_CAST(regexp_replace(lower(trim({c})), '[\\[\\]\\(\\),''"]', '', 'g') AS DOUBLE) IS NOT NULL THEN
    CASE WHEN TRY_CAST(regexp_replace(lower(trim({c})), '[\\[\\]\\(\\),''"]', '', 'g') AS DOUBLE)
              = floor(TRY_CAST(regexp_replace(lower(trim({c})), '[\\[\\]\\(\\),''"]', '', 'g') AS DOUBLE))
         THEN CAST(CAST(floor(TRY_CAST(regexp_replace(lower(trim({c})), '[\\[\\]\\(\\),''"]', '', 'g') AS DOUBLE)) AS BIGINT) AS VARCHAR)
         ELSE CAST(TRY_CAST(regexp_replace(lower(trim({c})), '[\\[\\]\\(\\),''"]', '', 'g') AS DOUBLE) AS VARCHAR) END
  ELSE trim(regexp_replace(lower(trim({c})), '[\\[\\]\\(\\),''"]', '', 'g')) END"""


def _string_errors_sql(where: str = "") -> str:
    rules = _rules_sql("usql", "lq", True)
    names = ["hallucination", "legal_ball", "team_mapping", "phase_filter", "aggregation"]
    counts = ", ".join(f"COUNT(CASE WHEN {r} THEN 1 END) AS {n}" for r, n in zip(rules, names))
    return f"""
WITH om AS (SELECT o_orderkey AS id, 0 AS m FROM orders UNION ALL SELECT o_orderkey, 1 FROM orders),
ga AS (SELECT o.o_orderkey AS id,
              '[' || COALESCE(string_agg('"(''' || {_NAME} || ''', ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ')"', ', '
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), '') || ']' AS gold_answer
       FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey),
vx AS (SELECT m, l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
              '(''' || {_NAME} || ''', ' || CAST(l_quantity + CAST((l_partkey + m) % 4 AS DOUBLE) * 0.5 AS VARCHAR)
              || CASE WHEN (l_orderkey + m) % 19 = 0 THEN ', 0' ELSE '' END || ')' AS item
       FROM (SELECT *, 0 AS m FROM lineitem UNION ALL SELECT *, 1 AS m FROM lineitem) x
       WHERE (l_partkey + m) % 11 <> 0),
va AS (SELECT m, id, string_agg(item, ', ' ORDER BY CASE WHEN m = 1 THEN -l_linenumber ELSE l_linenumber END,
                                 l_partkey, l_suppkey, l_extendedprice) AS items FROM vx GROUP BY m, id),
r AS (SELECT om.id, {_case(X.MODELS, 'om.m')} AS model,
             CASE WHEN (om.id + om.m) % 17 = 0 THEN {_sql_lit(X.FAILED_ANSWER)}
                  ELSE '[' || COALESCE(va.items, '') || ']' END AS generated_answer,
             upper({_case_text(X.SQL_TEMPLATES, 'om.id + om.m')}) AS usql,
             lower({_case_text(X.QUESTIONS, 'om.id')} || ' ' || {_case(X.LANGUAGES, 'om.id')}) AS lq,
             ga.gold_answer
      FROM om LEFT JOIN va ON va.id = om.id AND va.m = om.m JOIN ga ON ga.id = om.id {where}),
n AS (SELECT *, {_X9.format(c='generated_answer')} AS nv, {_X9.format(c='gold_answer')} AS ngd FROM r),
tot AS (SELECT model, COUNT(*) AS total_queries FROM r GROUP BY model),
errs AS (SELECT model, COUNT(*) AS total_errors, {counts} FROM n WHERE nv <> ngd OR nv = 'ERROR_FLAG' GROUP BY model)
SELECT t.model, total_queries, COALESCE(total_errors, 0) AS total_errors,
       {', '.join(f'COALESCE({x}, 0) AS {x}' for x in names)}
FROM tot t LEFT JOIN errs e ON e.model = t.model"""


ORACLES["eval_string_errors"] = _string_errors_sql()
