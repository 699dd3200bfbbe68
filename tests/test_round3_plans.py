"""Work done once, and batches of plain answers (F7 to F10, F21, F22, F24 of FINDINGS_r03)."""

import random

import pyarrow as pa
from test_round3 import plan_of, tables  # noqa: F401

from crease.functions.answers import answer_rows, greedy_matches, match_plain
from crease.operators.reports import string_error_analysis
from crease.plans.ingest_queries import constraint_violations
from crease.sources import eval_fixtures as X


def test_batches_of_plain_answers_equal_the_greedy_matcher():
    rnd = random.Random(5)
    cell = lambda c: rnd.choice(["'a'", "'B'", '"c d"', "None", "7", "8.5", "''"] if c else ["'x%d'" % rnd.randint(0, 9), "'X1'", "3", "None"])
    lines, texts, kinds = [], [], []
    for _ in range(600):
        row = lambda: "(" + ", ".join(cell(c) for c in range(rnd.randint(1, 3))) + ",)"
        gold = [row() for _ in range(rnd.randint(0, 4))]
        gen = [x if rnd.random() < 0.7 else row() for x in gold] + [row()] * rnd.randint(0, 2)
        lines.append(rnd.choice([gold] * 9 + [None]))
        texts.append(rnd.choice(["[" + ", ".join(gen) + "]"] * 9 + [None]))
        kinds.append(rnd.choice([["STRING"], [], None, ["DEFAULT_NUM", "STRING"]]))
    got = match_plain.func(pa.array(lines, pa.list_(pa.string())), pa.array(texts), pa.array(kinds, pa.list_(pa.string()))).to_pylist()
    for g, t, k, out in zip(lines, texts, kinds, got):
        if g is None or t is None:
            assert out == {"n_gen": None, "matches": None}
        else:
            want, read = answer_rows(g), answer_rows(t)
            assert out == {"n_gen": len(read), "matches": greedy_matches(want, read, k or [])}, (g, t, k)


def test_order_lines_are_not_copied_before_they_are_grouped(spark, tables):  # noqa: F811
    plan = plan_of(X.benchmark_results(spark, tables))
    assert plan.index("Generate explode") < plan.index("Aggregate") and plan.count("l_extendedprice") > 0


def test_answers_are_normalised_once(spark, tables):  # noqa: F811
    plan = plan_of(string_error_analysis(X.gold_dataset(spark, tables), X.benchmark_results(spark, tables)))
    assert plan.count("THEN ERROR_FLAG") == 2


def test_checks_read_deliveries_derived_before(spark, tables):  # noqa: F811
    report = constraint_violations(spark, tables)
    assert "l_orderkey" not in plan_of(report) and report.count() == 20
