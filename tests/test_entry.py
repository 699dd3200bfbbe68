def test_entry_smoke(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    df = entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["bowler_id", "player_name", "legal_balls", "overs_bowled", "runs_conceded", "economy"]
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 37


def test_top_k_with_ties_matches_rank(spark):
    from pyspark.sql import Window, functions as F
    from crease.operators import metrics as M
    from crease.sources.adapter import cricket_tables
    t = cricket_tables(spark, "/root/testdata/sf0.001")
    got = {r.bowler_id for r in M.top_wicket_takers(t, k=3).collect()}
    figs = M.bowling_figures(t)
    ranked = figs.withColumn("r", F.rank().over(Window.orderBy(F.col("wickets").desc())))
    want = {r.bowler_id for r in ranked.filter("r <= 3").collect()}
    assert got == want
