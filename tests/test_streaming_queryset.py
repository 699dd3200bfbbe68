import json
import os


def _result(i, model="gpt-4o", lang="English"):
    return {"id": i, "language": lang, "question": "What is the economy in the powerplay?", "model": model,
            "generated_sql": "SELECT 1", "generated_answer": f"[('a', {i})]",
            "generated_column_names": ["player_name", "total_runs"], "time_taken": 1.0}


def test_incremental_evaluation_is_exactly_once(spark, tmp_path):
    from crease.streaming.incremental import start_incremental_evaluation
    gold = spark.createDataFrame([(i, [f"('a', {i})"], ["player_name", "total_runs"]) for i in range(6)],
                                 "id long, answer array<string>, column_names array<string>")
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    (inbox / "a.json").write_text(json.dumps([_result(0), _result(1), _result(2)]))
    q = start_incremental_evaluation(spark, str(inbox), gold, out, ckpt)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 3
    # A rerun over the same files adds nothing; a new file (with one repeat) adds only new keys.
    (inbox / "b.json").write_text(json.dumps([_result(2), _result(3), _result(4, lang="Hindi_1")]))
    q = start_incremental_evaluation(spark, str(inbox), gold, out, ckpt)
    q.awaitTermination()
    df = spark.read.parquet(out)
    assert df.count() == 5
    assert df.select("model", "id", "language").distinct().count() == 5
    assert {r.score for r in df.collect()} == {1.0}


def test_query_set_runner(spark, tmp_path):
    from crease.operators.queryset import Refused, headers_of, is_read_only, run_query_set, validation_counts
    import pytest
    spark.range(10).createOrReplaceTempView("nums")
    spark.range(3).write.saveAsTable("guarded_t") if not spark.catalog.tableExists("guarded_t") else None
    st, rows = run_query_set(spark, [
        ("ok", "SELECT id AS n, id AS n FROM nums WHERE id < 3 ORDER BY 1"),
        ("many", "SELECT id FROM range(5000)"),
        ("comment", "-- note\nSELECT ';x' AS c;"),
        ("bad", "SELECT missing_col FROM nums"),
        ("write", "DROP TABLE guarded_t"),
        ("cte_write", "WITH x AS (SELECT 1 AS a) INSERT INTO guarded_t SELECT a FROM x"),
        ("none", None),
    ], timeout_s=120.0)
    # Under FIFO scheduling a long job starves its neighbours, so the timeout case runs alone.
    slow, _ = run_query_set(spark, [
        ("slow", "SELECT count(*) FROM range(0, 20000000000) a JOIN range(0, 20000000000) b ON a.id = b.id"),
    ], timeout_s=3.0)
    res = {r.key: r for r in st.unionByName(slow).collect()}
    assert res["ok"].status == "ok" and res["ok"].headers == ["n", "n"] and res["ok"].n_rows == 3
    assert res["many"].n_rows == 5000 and rows.filter("key = 'many'").distinct().count() == 5000
    assert [r.row for r in rows.filter("key = 'ok'").orderBy("row_no").collect()] == ['{"c0":%d,"c1":%d}' % (i, i) for i in range(3)]
    assert [r.row for r in rows.filter("key = 'comment'").collect()] == ['{"c0":";x"}']
    assert res["bad"].status == "error" and res["bad"].result.startswith("EXECUTION_ERROR: ")
    assert {res[k].status for k in ("write", "cte_write", "none")} == {"refused"}
    assert spark.table("guarded_t").count() == 3
    assert res["slow"].status == "timeout" and res["slow"].result == "ERROR: Query Timed Out"
    c = validation_counts(st).collect()[0]
    assert (c.success, c.errors) == (3, 4)
    assert headers_of(spark, "SELECT id AS a, id * 2 AS b FROM nums") == ["a", "b"]
    with pytest.raises(Refused):
        headers_of(spark, "DROP TABLE guarded_t")
    assert not is_read_only(spark, "SELECT 1; DROP TABLE guarded_t")
    spark.sql("DROP TABLE guarded_t")


def test_published_report_arithmetic(spark):
    """Forensic share = count / max(total - data score, 1) reproduces the published percentages."""
    from pyspark.sql import functions as F
    published = [("claude", 478, 228.2, 32, "12.8"), ("deepseek", 478, 241.8, 25, "10.6"),
                 ("gpt-4o", 478, 160.9, 15, "4.7"), ("qwen-raw", 478, 13.7, 17, "3.7")]
    df = spark.createDataFrame(published, "m string, n int, score double, cnt int, pct string")
    got = df.select("pct", F.format_string("%.1f", F.col("cnt") * 100.0 /
                                           F.greatest(F.col("n") - F.col("score"), F.lit(1.0))).alias("calc"))
    for r in got.collect():
        assert r.pct == r.calc


def test_dataset_helpers(spark):
    from pyspark.sql import functions as F
    from crease.operators import dataset as D
    df = spark.createDataFrame([("```sql\nSELECT 1\n```", "P.player_name", "question_hindi_1"),
                                ("SQLQuery: SELECT 2  ", "total_runs", "question_english"),
                                ("", "x", "question_hindi_2")], "raw string, h string, k string")
    got = df.select(D.clean_sql(F.col("raw")).alias("c"), D.clean_header(F.col("h")).alias("h"),
                    D.language_label(F.col("k")).alias("l"), D.needs_repair(D.clean_sql(F.col("raw"))).alias("r"))
    rows = [tuple(r) for r in got.collect()]
    assert rows == [("SELECT 1", "Player Name", "Hindi_1", False), ("SELECT 2", "Total Runs", "English", False),
                    ("", "X", "Hindi_2", True)]
