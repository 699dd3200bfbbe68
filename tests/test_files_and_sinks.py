"""Readers of gold and result files, resume joins, and sinks, on small files."""

import json


def test_gold_and_result_files(spark, tmp_path):
    from crease.operators import resume as S
    gold = [{"db_id": "d", "question_english": "Q%d" % i, "query": "SELECT %d" % i, "answer": ["(1,)"], "column_names": ["é"]} for i in range(3)]
    (tmp_path / "gold.json").write_text(json.dumps(gold, indent=2))
    got = S.read_gold_file(spark, str(tmp_path / "gold.json")).orderBy("id").collect()
    assert [(r.id, r.query, r.answer) for r in got] == [(i, "SELECT %d" % i, ["(1,)"]) for i in range(3)]
    folder = tmp_path / "results"
    folder.mkdir()
    (folder / "final_benchmark_gpt-4o.json").write_text(json.dumps([{"id": "1", "generated_sql": "S"}, {"id": "x", "generated_sql": "T"}], indent=1))
    (folder / "final_benchmark_bad.json").write_text("[{\"id\": 1, ")
    (folder / "other.json").write_text("[]")
    rows, bad = S.read_result_files(spark, str(folder))
    assert sorted((r.model, r.id) for r in S.coerce_ids(rows).collect() if r.id is not None) == [("gpt-4o", 1)]
    assert rows.count() == 2 and [r.file_name for r in bad.collect()] == ["final_benchmark_bad.json"]


def test_unreadable_files_are_those_of_the_reader(spark, tmp_path, monkeypatch):
    """Odd files, also with odd names: found by their texts first, told by Spark's reader of whole files, which reads few of the others."""
    from crease.operators import resume as S
    ok = b'{"id": "%d", "question": "q", "generated_column_names": ["a"], "time_taken": 1.5}'
    odd = [b"", b" ", b"[]", b"{}", b"null", b"5", b'"x"', b"[1]", b"[null]", b"[%s" % ok, b"[%s]]" % ok, b"[%s] x" % ok, b"%s,%s" % (ok, ok), b"[[%s]]" % ok,
           b'[{"id": {"a": 1}}]', b'[{"id": "1", "time_taken": "late"}]', b'[{"id": "1", "generated_column_names": 3}]', b'[{"id": "\xff"}]', b"\xef\xbb\xbf[%s]" % ok,
           "[{\"id\": \"1\"}]".encode("utf-16"), b'{"id": "1"}]}', b'[{"id": "1"}]} , [', b"\n\t[%s]\n" % ok, b'[{"id": "1",}]', b"%s\n%s" % (ok, ok), b"], 5"]
    for i, content in enumerate(odd):
        (tmp_path / f"final_benchmark_{i} [a] %20+{{b}}.json").write_bytes(content.replace(b"%d", b"7"))
    for i in range(60):
        (tmp_path / f"final_benchmark_good{i}.json").write_bytes(b"[%s]" % ok)
    records, asked = S._records, []
    monkeypatch.setattr(S, "_records", lambda s, paths, prefix: (asked.append(paths), records(s, paths, prefix))[1])
    _, bad = S.read_result_files(spark, str(tmp_path))
    every = records(spark, str(tmp_path), "final_benchmark_").groupBy("file_name", "file_path").agg({S.CORRUPT: "count", "id": "count"})
    want = {(r[0], r[1]) for r in every.collect() if r[f"count({S.CORRUPT})"] > 0 and r["count(id)"] >= 0}
    assert {tuple(r) for r in bad.collect()} == want and 5 < len(want) < len(odd)
    assert len(asked[-1]) <= len(odd) and not any("good" in x for x in asked[-1])
    monkeypatch.setattr(S, "SUSPECTS", 3)
    assert {tuple(r) for r in S.read_result_files(spark, str(tmp_path))[1].collect()} == want


def test_sinks_round_trip(spark, tmp_path):
    from crease.operators import resume as S
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "é\n2"), (2, None)], "id long, t string")
    S.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema("id long, t string").json(str(tmp_path / "j")).collect())) == [(1, "é\n2"), (2, None)]
    assert "é" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    lines = spark.range(100).select((99 - F.col("id")).alias("n"), F.concat(F.lit("line "), 99 - F.col("id")).alias("text"))
    S.write_text(lines, str(tmp_path / "t"), ["n"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert text.splitlines() == ["line %d" % i for i in range(100)]
    S.write_tables({"a": df, "b": df}, str(tmp_path / "tables"), {"b": "id"})
    S.write_tables({"a": df.limit(1)}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/a")).count() == 1
    assert (tmp_path / "tables/b/id=1").exists()
    r = spark.createDataFrame([("q", "s", "ok")], "q string, s string, st string").select(S.log_text(F.col("q"), F.col("s"), F.col("st")).alias("x")).first().x
    assert r == "QUERY: q\nSQL: s\nSTATUS: ok\n"


def test_queries_run_from_another_folder(tmp_path):
    """The package reaches the Python workers whatever folder the driver starts in."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "import __spark_entry__ as e\nfrom crease.session import get_spark\n"
            "s = get_spark('local[2]', 4)\n"
            "print('ROWS', e.queries()['eval_model_summary'](s, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 2" in out.stdout, out.stderr[-2000:]
