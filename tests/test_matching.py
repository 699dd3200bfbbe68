import random

import time

from crease.functions.answers import answer_rows, float_text, greedy_matches, normalize_answer, normalize_cell


def _clean(v):
    return str(v).strip().lower()


def brute_greedy(gold, gen, types):
    """Plain Python greedy one-to-one matcher, written from the rule text."""
    def cell_ok(g, v, t):
        if g is None or v is None:
            return g is None and v is None
        if t == "STRING" or isinstance(g, str):
            return _clean(g) == _clean(v)
        try:
            return abs(float(g) - float(v)) <= 1.0
        except (TypeError, ValueError):
            return _clean(g) == _clean(v)
    used, n = set(), 0
    for g in gold:
        for i, v in enumerate(gen):
            if i in used or len(v) != len(g):
                continue
            if all(cell_ok(a, b, types[c] if c < len(types) else "DEFAULT_NUM") for c, (a, b) in enumerate(zip(g, v))):
                used.add(i)
                n += 1
                break
    return n


def test_parse_answer_edge_values():
    assert answer_rows(None) == []
    assert answer_rows("ERROR: Query Timed Out") is None
    assert answer_rows("EXECUTION_ERROR: no such table") is None
    assert answer_rows("[]") == [] and answer_rows("7") == [] and answer_rows("('a',)") == []
    rows = answer_rows("[('V Kohli', 973)]")
    assert [c.kind for c in rows[0]] == ["str", "value"] and rows[0][0].text == "v kohli"
    rows = answer_rows(["('V Kohli', 973)", "42", "plain text"])
    assert [len(r) for r in rows] == [2, 1, 1] and rows[2][0].text == "plain text"
    assert answer_rows("[(None,)]")[0][0].kind == "null"
    assert answer_rows("not a literal") is None


def test_greedy_matches_brute_force():
    rnd = random.Random(7)
    names = ["a", "B", " b ", "c"]
    for case in range(4000):
        dense = case % 2 == 0
        width = 1 if dense else rnd.choice([1, 2, 3])

        def row():
            w = width if dense else rnd.choice([1, 2, 3])
            out = []
            for c in range(w):
                if c == 0 and not dense:
                    out.append(rnd.choice(names + [None]))
                else:
                    out.append(rnd.choice([0, 0.5, 1, 1.5, 2, 2.5, 3, None, "2", "x", True, float("nan"), [1]]))
            return tuple(out)
        gold = [row() for _ in range(rnd.randint(0, 6))]
        gen = [row() for _ in range(rnd.randint(0, 6))]
        types = ["DEFAULT_NUM"] if dense else ["STRING", "RUNS", "STRIKE_RATE"]
        assert greedy_matches(answer_rows(gold), answer_rows(gen), types) == brute_greedy(gold, gen, types), (gold, gen)


def test_rows_without_a_match_are_quick():
    """3,000 x 3,000 rows of numbers, none within the tolerance of another; and all in neighbouring grid cells."""
    for gold, gen in (([(i, 2 * i) for i in range(3000)], [(i + 0.5, 2 * i + 7) for i in range(3000)]),
                      ([(0.0, i / 3000) for i in range(3000)], [(1.5, i / 3000) for i in range(3000)]),
                      ([(i / 9, i / 7, i / 5, 0) for i in range(3000)], [(i / 9, i / 7, i / 5, 3) for i in range(3000)])):
        start = time.time()
        assert greedy_matches(answer_rows(gold), answer_rows(gen), []) == 0
        assert time.time() - start < 2


def test_grid_keeps_differences_that_round_to_the_tolerance():
    for a, b in ((0.9999999999999999, 2.0), (-0.1, 0.9), (1e15 + 0.5, 1e15 + 1.5), (float("inf"), float("inf")), (-3.0, -2.0)):
        assert greedy_matches(answer_rows([(a,)]), answer_rows([(b,)]), []) == brute_greedy([(a,)], [(b,)], [])


def test_plain_answers_equal_the_python_path(spark):
    """Where the expressions call an answer plain, their outcome is that of reading and matching in Python."""
    from pyspark.sql import functions as F

    from crease.functions.answers import COMPARED, compare_plain, plain_lines
    rnd = random.Random(11)
    cells = ["'a'", "'B '", '"c"', "'It\\'s'", '"it\'s"', "'x, y'", "'(z)'", "'), ('", "7", "-3", "0", "007", "2.5", "2.50", "1e5", "None", "True", "0.00001",
             "'7'", "'None'", "10000000.0", "'é'", "'Σ'", "-0.0", "1.0"]
    def text_of(row):
        return "(" + ", ".join(row) + ("," if len(row) == 1 and rnd.random() < 0.8 else "") + ")"
    data = []
    for case in range(1500):
        few = cells if case % 3 else ["'a%d'" % i for i in range(12)]
        row = lambda: text_of([rnd.choice(few)] + [rnd.choice(cells[8:] if case % 2 else ["1", "2.5", "4", "None"]) for _ in range(rnd.randint(0, 2))])
        lines = [row() for _ in range(rnd.randint(0, 5))]
        kept = [x if rnd.random() < 0.6 else row() for x in lines if rnd.random() < 0.8]
        rnd.shuffle(kept)
        gen = rnd.choice(["[" + ", ".join(kept) + "]"] * 12 + ["[]", "", "()", "[()]", "ERROR: x", "Time Out", "7", "nonsense", "[1, 2]", "['a']", "[('7')]", None])
        data.append((case, lines, gen, rnd.choice([["STRING"], [], ["DEFAULT_NUM"], ["STRING", "RUNS", "STRING"]])))
    df = spark.createDataFrame(data, "id int, lines array<string>, gen string, types array<string>").repartition(4)
    got = df.select("id", F.inline(F.array(compare_plain(plain_lines(F.col("lines")), F.col("gen"), F.col("types"), F.size("lines"))))).collect()
    plain = 0
    assert [f.name for f in COMPARED] == ["executed", "n_gold", "n_gen", "matches"]
    for r in got:
        _, lines, gen, types = data[r.id]
        if r.plain:
            want, read = answer_rows(lines), answer_rows(gen)
            expected = (read is not None, len(want), len(read or ()), greedy_matches(want, read, types) if want and read else 0)
            assert (r.executed, r.n_gold, r.n_gen, r.matches) == expected, data[r.id]
            plain += 1
    assert plain > 400


def test_plain_answers_reach_no_python_worker(spark):
    from crease.operators.reports import evaluate
    gold = spark.createDataFrame([(1, ["('a', 1)", "('b', 2)"], ["name", "n"])], "id long, answer array<string>, column_names array<string>")
    res = spark.createDataFrame([(1, "m", "English", "q", "S", "[('b', 2.5), ('a', 3)]", ["name", "n"], 4.0)],
                                "id long, model string, language string, question string, generated_sql string, "
                                "generated_answer string, generated_column_names array<string>, time_taken double")
    ev = evaluate(gold, res)
    assert ev.select("matches", "executed").collect() == [(1, True)]
    lines = ev._jdf.queryExecution().optimizedPlan().toString().splitlines()
    python = next(i for i, x in enumerate(lines) if "compare_answers" in x and "EvalPython" in x)
    below = next(x for x in lines[python + 1:] if "Filter" in x)
    assert "NOT _plain" in below, below  # so only the other answers reach the Python node


def test_large_answers_are_quick():
    for gold in ([(i,) for i in range(3000)], [(i % 3,) for i in range(3000)], [("n%d" % i, i / 7, i % 5) for i in range(3000)]):
        start = time.time()
        types = ["STRING"] + ["DEFAULT_NUM"] * 2 if len(gold[0]) == 3 else []
        assert greedy_matches(answer_rows(gold), answer_rows(gold[::-1]), types) > 1000
        assert time.time() - start < 2


def test_missing_fields_and_normalisation(spark):
    from crease.operators.reports import evaluate, model_summary
    from pyspark.sql import functions as F
    gold = spark.createDataFrame([(1, ["('a', 1)"], ["name", "n"])], "id long, answer array<string>, column_names array<string>")
    res = spark.createDataFrame([(1, "m", None, "q", "S", "[('a', 2)]", ["name", "n"], 4.0),
                                 (1, "m", "English", "q", "S", "oops", ["name", "n"], None)],
                                "id long, model string, language string, question string, generated_sql string, "
                                "generated_answer string, generated_column_names array<string>, time_taken double")
    r = model_summary(evaluate(gold, res)).collect()[0]
    assert (r.english_pct, r.avg_latency, r.exec_success) == (50.0, 2.0, 1)
    texts = ["5f", "1d", "abc\n", "\xa0x\t", "7.0", "(3, )", "Timeout!", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(
        normalize_answer("t").alias("a"), normalize_cell("t").alias("c")).collect()
    assert [x.a for x in got] == ["5f", "1d", "abc", "x", "7", "3", "ERROR_FLAG", ""]
    assert [x.c for x in got] == ["5f", "1d", "abc", "x", "7.0", "(3, )", "timeout!", "none"]
    nums = [0.1, 1e-5, 1.5e-7, 0.001, 1e7, 123456789.25, -2.5e8, 1e16, 1.25e20, 3.0, 0.00012]
    back = [r[0] for r in spark.createDataFrame([(x,) for x in nums], "x double").coalesce(1).select(float_text(F.col("x"))).collect()]
    assert back == [str(x) for x in nums]
