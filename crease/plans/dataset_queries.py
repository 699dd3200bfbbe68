"""Registered dataset-curation queries and their oracles.

Triplet text files are derived from ``orders``: one text per 16 consecutive
orders, a URL-only chunk first, then one chunk per order (a triplet, a comment,
stray text, or a URL line followed by a triplet).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators import dataset as D
from crease.sources import eval_fixtures as X
from crease.sources.tables import table

ORDERS_PER_TEXT = 16


def triplet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    triplet = F.concat(F.lit("Question: "), X._pick(X.QUESTIONS, k), F.lit("\nSQL: "), X._pick(X.SQL_TEMPLATES, k),
                       F.lit("\nAnswer:\n"), F.col("o_orderpriority"), F.lit("\n  "), F.col("o_orderstatus"),
                       F.lit("\n\n"), F.col("o_custkey").cast("string"))
    chunk = (F.when(k % 13 == 5, F.concat(F.lit("https://example.com/match/"), k.cast("string"), F.lit("\n"), triplet))
             .when(k % 7 == 3, F.concat(F.lit("# note "), k.cast("string")))
             .when(k % 11 == 4, F.concat(F.lit("stray text "), k.cast("string")))
             .otherwise(triplet))
    text_id = F.floor(k / ORDERS_PER_TEXT).cast("long")
    per = (o.select(text_id.alias("text_id"), k.alias("k"), chunk.alias("chunk"))
           .groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("k", "chunk"))).alias("cs")))
    header = F.concat(F.lit("https://example.com/live-cricket-scores/"), F.col("text_id").cast("string"))
    return per.select("text_id", F.concat(header, F.lit("\n---\n"),
                                          F.array_join(F.transform("cs", lambda x: x["chunk"]), "\n---\n"))
                      .alias("text"))


def _converted(spark, sf_dir):
    return D.convert_chunks(D.split_chunks(triplet_texts(spark, sf_dir)))


def dataset_conversion(spark, sf_dir):
    e = D.gold_entries(_converted(spark, sf_dir))
    return e.select("text_id", "pos", "db_id", "context_url", "question", "query",
                    F.array_join("answer", "\n").alias("answer_text"), F.size("answer").alias("answer_lines"))


def dataset_conversion_counts(spark, sf_dir):
    return D.conversion_counts(_converted(spark, sf_dir))


def _gold_with_gaps(spark, sf_dir):
    g = X.gold_dataset(spark, sf_dir)
    return g.withColumn("question_hindi_2", F.when(F.col("id") % 9 == 0, F.lit("")).otherwise(F.col("question_hindi_2")))


def question_worklist(spark, sf_dir):
    done = X.benchmark_results(spark, sf_dir).filter((F.col("model") == X.MODELS[0]) & (F.col("id") % 4 == 0))
    return D.work_list(_gold_with_gaps(spark, sf_dir), done)


def _raw_outputs(spark, sf_dir):
    r = X.benchmark_results(spark, sf_dir)
    sql = F.col("generated_sql")
    raw = (F.when(F.col("id") % 4 == 0, F.concat(F.lit("```sql\n"), sql, F.lit("\n```")))
           .when(F.col("id") % 4 == 1, F.concat(F.lit("SQLQuery: "), sql))
           .when(F.col("id") % 4 == 2, sql)
           .otherwise(F.lit("API_ERROR: upstream timeout")))
    return r.withColumn("raw_output", raw)


def sql_cleaning(spark, sf_dir):
    r = _raw_outputs(spark, sf_dir)
    cleaned = D.clean_sql(F.col("raw_output"))
    return r.select("model", "id", D.safe_model_name(F.col("model")).alias("model_file"),
                    cleaned.alias("cleaned_sql"), D.strip_fences(F.col("raw_output")).alias("fence_stripped"),
                    D.is_invalid_sql(cleaned).alias("invalid_sql"), D.needs_repair(cleaned).alias("needs_repair"),
                    D.truncate_result(F.col("generated_answer")).alias("execution_result"))


def repair_merge(spark, sf_dir):
    c = sql_cleaning(spark, sf_dir)
    results = c.select("id", "model", F.col("cleaned_sql").alias("generated_sql"), "execution_result",
                       (~F.col("invalid_sql")).alias("execution_success"), F.lit(0.0).alias("time_taken"))
    repairs = c.filter("needs_repair").select(
        "id", "model", F.lit("SELECT 1").alias("generated_sql"), F.lit("[(1,)]").alias("execution_result"),
        F.lit(True).alias("execution_success"), F.lit(1.5).alias("time_taken"))
    return D.repair_merge(results, repairs, ["id", "model"])


QUERIES = {
    "dataset_conversion": dataset_conversion,
    "dataset_conversion_counts": dataset_conversion_counts,
    "question_worklist": question_worklist,
    "sql_cleaning": sql_cleaning,
    "repair_merge": repair_merge,
}


# --- oracles ------------------------------------------------------------------

def _lit(s):
    return "'" + s.replace("'", "''") + "'"


def _case_text(values, key):
    return f"CASE ({key}) % {len(values)} " + " ".join(
        f"WHEN {i} THEN {_lit(v)}" for i, v in enumerate(values)) + " END"


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_TRIPLET = "(?is)Question:\\s*(.*?)\\s*SQL:\\s*(.*?)\\s*Answer:\\s*(.*?)$"

_TEXTS = f"""
WITH ch AS (
  SELECT CAST(floor(o_orderkey / {ORDERS_PER_TEXT}) AS BIGINT) AS text_id, o_orderkey,
         'Question: ' || {_case_text(X.QUESTIONS, 'o_orderkey')} || chr(10) || 'SQL: ' ||
         {_case_text(X.SQL_TEMPLATES, 'o_orderkey')} || chr(10) || 'Answer:' || chr(10) || o_orderpriority ||
         chr(10) || '  ' || o_orderstatus || chr(10) || chr(10) || CAST(o_custkey AS VARCHAR) AS trip
  FROM orders),
c2 AS (
  SELECT text_id, o_orderkey,
         CASE WHEN o_orderkey % 13 = 5 THEN 'https://example.com/match/' || CAST(o_orderkey AS VARCHAR) || chr(10) || trip
              WHEN o_orderkey % 7 = 3 THEN '# note ' || CAST(o_orderkey AS VARCHAR)
              WHEN o_orderkey % 11 = 4 THEN 'stray text ' || CAST(o_orderkey AS VARCHAR)
              ELSE trip END AS chunk
  FROM ch),
texts AS (
  SELECT text_id, 'https://example.com/live-cricket-scores/' || CAST(text_id AS VARCHAR) || chr(10) || '---' || chr(10)
         || string_agg(chunk, chr(10) || '---' || chr(10) ORDER BY o_orderkey) AS text
  FROM c2 GROUP BY text_id),
parts AS (
  SELECT text_id, unnest(string_split(text, '---')) AS raw, generate_subscripts(string_split(text, '---'), 1) - 1 AS pos
  FROM texts),
chunks AS (SELECT text_id, pos, {_STRIP.format(x='raw')} AS chunk FROM parts),
c AS (SELECT * FROM chunks WHERE chunk <> ''),
u AS (
  SELECT *, (starts_with(chunk, 'http://') OR starts_with(chunk, 'https://')) AS is_url,
         len(string_split(chunk, chr(10))) = 1 AS single_line,
         {_STRIP.format(x="string_split(chunk, chr(10))[1]")} AS first_line,
         regexp_matches(chunk, '{_TRIPLET}') AS matched
  FROM c),
v AS (
  SELECT *, is_url AND single_line AND (ends_with(chunk, '.com') OR ends_with(chunk, '.html')
                                        OR contains(chunk, '/live-cricket-scores/')) AS url_only,
         CASE WHEN is_url THEN first_line END AS url
  FROM u),
conv AS (
  SELECT text_id, pos,
         last_value(url IGNORE NULLS) OVER (PARTITION BY text_id ORDER BY pos
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context_url,
         CASE WHEN url_only THEN 'url' WHEN matched THEN 'triplet'
              WHEN starts_with(chunk, 'http') OR starts_with(chunk, '#') THEN 'ignored' ELSE 'skipped' END AS chunk_class,
         {_STRIP.format(x=f"regexp_extract(chunk, '{_TRIPLET}', 1)")} AS question,
         {_STRIP.format(x=f"regexp_extract(chunk, '{_TRIPLET}', 2)")} AS query,
         list_filter(list_transform(string_split({_STRIP.format(x=f"regexp_extract(chunk, '{_TRIPLET}', 3)")}, chr(10)),
                                    lambda x: {_STRIP.format(x='x')}), lambda x: x <> '') AS answer
  FROM v)
"""

ORACLES = {
    "dataset_conversion": _TEXTS + """
SELECT text_id, pos, 'ipl_db' AS db_id, context_url, question, query,
       array_to_string(answer, chr(10)) AS answer_text, CAST(len(answer) AS INTEGER) AS answer_lines
FROM conv WHERE chunk_class = 'triplet'""",
    "dataset_conversion_counts": _TEXTS + """
SELECT COUNT(CASE WHEN chunk_class = 'triplet' THEN 1 END) AS parsed,
       COUNT(CASE WHEN chunk_class = 'skipped' THEN 1 END) AS skipped FROM conv""",
}

_Q = _case_text(X.QUESTIONS, "o_orderkey")
ORACLES["question_worklist"] = f"""
WITH s AS (
  SELECT o_orderkey AS id, 'English' AS language, {_Q} AS question FROM orders
  UNION ALL SELECT o_orderkey, 'Hindi_1', {_Q} FROM orders
  UNION ALL SELECT o_orderkey, 'Hindi_2', CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE {_Q} END FROM orders),
done AS (SELECT o_orderkey AS id, {_case_text(X.LANGUAGES, 'o_orderkey')} AS language FROM orders WHERE o_orderkey % 4 = 0)
SELECT s.id, s.language, s.question FROM s
WHERE s.question IS NOT NULL AND length(s.question) > 0
  AND NOT EXISTS (SELECT 1 FROM done d WHERE d.id = s.id AND d.language = s.language)"""

_FENCE = "(?s)```(?:sql)?\\s*(.*?)\\s*```"
_CLEAN_BASE = f"""
WITH om AS (SELECT o_orderkey AS id, 0 AS m FROM orders UNION ALL SELECT o_orderkey, 1 FROM orders),
vx AS (SELECT m, l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
              '(''' || 'P' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
              CAST(l_suppkey AS VARCHAR) || ''', ' || CAST(l_quantity + CAST((l_partkey + m) % 4 AS DOUBLE) * 0.5 AS VARCHAR)
              || CASE WHEN (l_orderkey + m) % 19 = 0 THEN ', 0' ELSE '' END || ')' AS item
       FROM (SELECT *, 0 AS m FROM lineitem UNION ALL SELECT *, 1 AS m FROM lineitem) x
       WHERE (l_partkey + m) % 11 <> 0),
va AS (SELECT m, id, string_agg(item, ', ' ORDER BY CASE WHEN m = 1 THEN -l_linenumber ELSE l_linenumber END,
                                 l_partkey, l_suppkey, l_extendedprice) AS items FROM vx GROUP BY m, id),
r AS (
  SELECT om.id, CASE om.m WHEN 0 THEN {_lit(X.MODELS[0])} ELSE {_lit(X.MODELS[1])} END AS model,
         {_case_text(X.SQL_TEMPLATES, 'om.id + om.m')} AS sql,
         CASE WHEN (om.id + om.m) % 17 = 0 THEN {_lit(X.FAILED_ANSWER)}
              ELSE '[' || COALESCE(va.items, '') || ']' END AS generated_answer
  FROM om LEFT JOIN va ON va.id = om.id AND va.m = om.m),
rw AS (
  SELECT *, CASE id % 4 WHEN 0 THEN '```sql' || chr(10) || sql || chr(10) || '```'
                        WHEN 1 THEN 'SQLQuery: ' || sql WHEN 2 THEN sql
                        ELSE 'API_ERROR: upstream timeout' END AS raw_output
  FROM r),
cl AS (
  SELECT *, CASE WHEN raw_output IS NULL OR raw_output = '' THEN ''
                 WHEN regexp_matches(raw_output, '{_FENCE}')
                   THEN {_STRIP.format(x=f"regexp_extract(raw_output, '{_FENCE}', 1)")}
                 ELSE {_STRIP.format(x="replace(raw_output, 'SQLQuery:', '')")} END AS cleaned_sql
  FROM rw),
sc AS (
  SELECT model, id, replace(replace(model, '/', '_'), ':', '') AS model_file, cleaned_sql,
         {_STRIP.format(x="replace(replace(raw_output, '```sql', ''), '```', '')")} AS fence_stripped,
         (cleaned_sql IS NULL OR contains(cleaned_sql, 'ERROR')) AS invalid_sql,
         (contains(cleaned_sql, 'API_ERROR') OR {_STRIP.format(x='cleaned_sql')} = ''
          OR contains(lower(cleaned_sql), 'timeout')) AS needs_repair,
         substring(generated_answer, 1, 200) AS execution_result
  FROM cl)
"""

ORACLES["sql_cleaning"] = _CLEAN_BASE + "SELECT * FROM sc"
ORACLES["repair_merge"] = _CLEAN_BASE + """
SELECT id, model,
       CASE WHEN needs_repair THEN 'SELECT 1' ELSE cleaned_sql END AS generated_sql,
       CASE WHEN needs_repair THEN '[(1,)]' ELSE execution_result END AS execution_result,
       CASE WHEN needs_repair THEN TRUE ELSE NOT invalid_sql END AS execution_success,
       CASE WHEN needs_repair THEN 1.5 ELSE 0.0 END AS time_taken,
       needs_repair AS repaired
FROM sc"""
