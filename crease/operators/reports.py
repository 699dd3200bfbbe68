"""Evaluation pipeline and reports.

``evaluate`` parses both answers (E1, Arrow-batched), joins results to gold by
question id (J5), scores every item (E2-E7) and attaches forensic labels (E8).
Reports are single aggregations keyed by model (and language / class / label),
so each shuffles one row per key per partition after map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions.answers import are_plain_lines, column_types, is_failed, is_plain_answer, normalize_answer
from crease.operators.compare import score_items
from crease.operators.forensics import LABELS, complexity_flags, error_labels, rule_flags
from crease.session import ship

REPORT_LANGUAGES = ["English", "Hindi_1", "Hindi_2"]
BASIC_CLASSES = ["Schema Mismatch", "Row Count Mismatch", "Value Mismatch", "Execution Error"]
# Rounding for sums of fractional scores and latencies (summation order differs between engines).
DIGITS = 6


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, made by a generator: the optimizer does not put their expressions in every place that names them."""
    given = [c for c in df.columns if c not in columns]
    return df.select(*given, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def evaluate(gold: DataFrame, results: DataFrame) -> DataFrame:
    """One scored row per result record that has a gold entry."""
    ship(gold.sparkSession)
    # What is asked of gold entries alone is asked once a question, not once a model.
    g = _once(gold.select("id", F.col("column_names").alias("gold_column_names"), F.col("answer")),
              id=F.col("id"), gold_answer=F.col("answer")).drop("answer")
    g = g.withColumn("gold_plain", are_plain_lines(F.col("gold_answer"))).withColumn("gold_types", column_types(F.col("gold_column_names")))
    # A record without a language counts as English, one without a time as 0 seconds.
    r = results.withColumn("language", F.coalesce("language", F.lit("English"))).withColumn(
        "time_taken", F.coalesce("time_taken", F.lit(0.0)))
    # With the id as a generator's output Spark deals both sides out by it after answers are made and tried for their shape, not before, and
    # plain and other items read those two exchanges.
    r = _once(r, id=F.col("id"), generated_answer=F.col("generated_answer"))
    r = r.withColumn("gen_failed", is_failed(F.col("generated_answer"))).withColumn("gen_plain", is_plain_answer(F.col("generated_answer")))
    scored = score_items(r.join(g, "id"))
    q_text = F.concat(F.coalesce(F.col("question"), F.lit("")), F.lit(" "), F.coalesce(F.col("language"), F.lit("")))
    return scored.withColumn("forensic_labels",
                             F.when(F.col("needs_forensics"), error_labels(F.col("generated_sql"), q_text))
                             .otherwise(F.array().cast("array<string>")))


def item_scores(ev: DataFrame) -> DataFrame:
    return ev.select("model", "id", "language", "executed", "schema_ok", "matches", "score", "failure_class",
                     F.array_join("forensic_labels", "|").alias("forensic_labels"))


#: Sums and counts that partial rows hold; rows of different items add up.
ADDABLE = ["n", "executed", "schema_ok", "score", "seconds"]


def partial_totals(ev: DataFrame) -> DataFrame:
    """A15-A18 in one pass: a row of addable figures per model and language; a run's rows are kept beside those of others."""
    return ev.groupBy("model", "language").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("executed").alias("executed"), F.count_if("schema_ok").alias("schema_ok"),
        F.sum("score").alias("score"), F.sum("time_taken").alias("seconds"))


def rollup_totals(partials: DataFrame) -> DataFrame:
    """Partial rows of any number of runs added up per (model, language), per model and over all; ``level`` is 0, 1 and 3."""
    return partials.rollup("model", "language").agg(*[F.sum(c).alias(c) for c in ADDABLE], F.grouping_id().alias("level"))


def _pct(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, F.coalesce(a, F.lit(0.0)) * 100.0 / b).otherwise(0.0), DIGITS)


def summary_of(partials: DataFrame) -> DataFrame:
    """One row per model, with the languages' shares beside the totals."""
    eng, hin = F.col("language") == "English", F.col("language").isin("Hindi_1", "Hindi_2")
    of = lambda c, cond, name: F.sum(F.when(cond, F.col(c))).alias(name)
    total = partials.groupBy("model").agg(*[F.sum(c).alias(c) for c in ADDABLE], of("score", eng, "eng_s"), of("n", eng, "eng_n"),
                                          of("score", hin, "hin_s"), of("n", hin, "hin_n"))
    return total.select(
        "model", F.col("n").alias("total_queries"), F.col("executed").alias("exec_success"), F.col("schema_ok").alias("schema_matches"),
        F.round("score", DIGITS).alias("data_match_score"), F.round(F.coalesce(F.col("seconds") / F.col("n"), F.lit(0.0)), DIGITS).alias("avg_latency"),
        _pct(F.col("executed").cast("double"), F.col("n")).alias("exec_pct"),
        _pct(F.col("schema_ok").cast("double"), F.col("n")).alias("schema_pct"), _pct(F.col("score"), F.col("n")).alias("data_pct"),
        _pct(F.col("eng_s"), F.coalesce("eng_n", F.lit(0))).alias("english_pct"), _pct(F.col("hin_s"), F.coalesce("hin_n", F.lit(0))).alias("hindi_pct"))


def model_summary(ev: DataFrame) -> DataFrame:
    return summary_of(partial_totals(ev))


def language_breakdown(ev: DataFrame) -> DataFrame:
    """Per model and report language (other labels count only in totals)."""
    return (partial_totals(ev).filter(F.col("language").isin(*REPORT_LANGUAGES))
            .select("model", "language", "n", F.col("executed").alias("exec_success"), F.round("score", DIGITS).alias("data_match_score"),
                    F.round(F.col("score") * 100.0 / F.col("n"), DIGITS).alias("data_pct")))


def rollup_report(partials: DataFrame) -> DataFrame:
    """All levels of the rollup as a report: ``ALL`` stands for every language or model."""
    r = rollup_totals(partials)
    return r.select(F.when(F.col("level") < 2, F.col("model")).otherwise("ALL").alias("model"),
                    F.when(F.col("level") < 1, F.col("language")).otherwise("ALL").alias("language"), "n", F.col("executed").alias("exec_success"),
                    F.col("schema_ok").alias("schema_matches"), F.round("score", DIGITS).alias("data_match_score"),
                    _pct(F.col("score"), F.col("n")).alias("data_pct"), F.round(F.col("seconds") / F.col("n"), DIGITS).alias("avg_latency"))


def failure_counts(ev: DataFrame) -> DataFrame:
    """Basic failure classes per model."""
    return (ev.filter(F.col("failure_class").isNotNull())
            .groupBy("model", "failure_class").agg(F.count(F.lit(1)).alias("n")))


def _totals(ev: DataFrame, *more: str) -> DataFrame:
    """Everything a report needs in one pass: one row per model, a count or sum per class, label and language."""
    label = lambda x: F.count_if(F.array_contains("forensic_labels", x))
    return ev.groupBy("model", *more).agg(
        F.count(F.lit(1)).alias("n"), F.sum("time_taken").alias("seconds"), F.sum("score").alias("score"),
        F.count_if("executed").alias("executed"), F.count_if("schema_ok").alias("schema_ok"),
        F.array(*[F.count_if(F.col("failure_class") == c) for c in BASIC_CLASSES]).alias("classes"),
        F.array(*[label(x) for x in LABELS]).alias("labels"),
        F.array(*[F.struct(F.count_if(F.col("language") == x).alias("n"),
                           F.sum(F.when(F.col("language") == x, F.col("score"))).alias("score"))
                  for x in REPORT_LANGUAGES]).alias("languages"))


def _failures() -> Column:
    """A20's denominator: at least one failure, fractional as scores are."""
    return F.greatest(F.col("n") - F.col("score"), F.lit(1.0))


def forensic_counts(ev: DataFrame) -> DataFrame:
    """Label counts and share of failures (denominator max(count - score, 1))."""
    named = F.arrays_zip(F.array(*[F.lit(x) for x in LABELS]).alias("label"), F.col("labels").alias("n"))
    one = _totals(ev).select("model", _failures().alias("failures"), F.inline(named).alias("label", "n"))
    return one.filter("n > 0").select("model", "label", "n", F.round(F.col("n") * 100.0 / F.col("failures"), DIGITS).alias("share_pct"))


def _fixed(x: Column, digits: int) -> Column:
    """Python's ``.1f``: ties go to the even digit, where Java's formatter rounds up."""
    return F.format_string(f"%.{digits}f", F.bround(x.cast("double"), digits))


# The lines of the report block.
def report_lines(ev: DataFrame) -> DataFrame:
    """The report block of each model as (model, line_no, text), in order, for a text sink (K6)."""
    n, score = F.col("n"), F.col("score")
    share = lambda x: F.concat(x.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("), _fixed(x * 100.0 / n, 1), F.lit("%)"))
    text = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    lines = [text("MODEL: ", F.col("model")), F.lit("-" * 40), text("Total Queries: ", n.cast("string")),
             text("Avg Latency:   ", _fixed(F.col("seconds") / n, 2), "s per query"), F.lit(""), F.lit("METRICS:"),
             text("  Execution Success:  ", share(F.col("executed"))), text("  Schema Compliance:  ", share(F.col("schema_ok"))),
             text("  Data Match Score:   ", _fixed(score, 1), "/", n.cast("string"), " (", _fixed(score * 100.0 / n, 1), "%)"),
             F.lit(""), F.lit("LANGUAGE BREAKDOWN (Data Match %):")]
    for i, name in enumerate(REPORT_LANGUAGES):
        x = F.get("languages", F.lit(i))
        lines.append(F.when(x["n"] > 0, text(f"  {name:<10}: ", _fixed(x["score"] / x["n"] * 100.0, 1), "%")))
    lines += [F.lit(""), F.lit("BASIC FAILURE COUNTS:")]
    for i, name in enumerate(BASIC_CLASSES):
        x = F.get("classes", F.lit(i))
        lines.append(F.when(x > 0, text(f"  {name:<20}: ", x.cast("string"))))
    lines += [F.lit(""), F.lit("FORENSIC ERROR ANALYSIS (Semantic Causes):")]
    for i, name in enumerate(LABELS):
        x = F.get("labels", F.lit(i))
        lines.append(F.when(x > 0, text(f"  {name:<25}: ", x.cast("string"), " (", _fixed(x / _failures() * 100.0, 1), "% of failures)")))
    lines += [F.lit(""), F.lit("=" * 60), F.lit("")]
    kept = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return _totals(ev).select("model", F.posexplode(kept).alias("line_no", "text"))


def latex_rows(errors: DataFrame) -> DataFrame:
    """One table row per model and rule (A22's counts), or a remark for a model without errors."""
    names = ["hallucination", "legal_ball", "team_mapping", "phase_filter", "aggregation"]
    total = F.col("total_errors")
    rows = [F.concat(F.lit(f"{label} & "), F.col(c).cast("string"), F.lit(" & "), _fixed(F.col(c) / total * 100.0, 1), F.lit("\\% \\\\"))
            for label, c in zip(LABELS, names)]
    head = F.concat(F.lit("% Stats for "), F.col("model"), F.lit(" (N="), total.cast("string"), F.lit(" errors)"))
    none = F.concat(F.lit("% "), F.col("model"), F.lit(": Perfect Score (0 Errors)"))
    return errors.select("model", F.posexplode(F.when(total == 0, F.array(none)).otherwise(F.array(head, *rows))).alias("line_no", "text"))


# Short names by the first of these found in a file name.
FAMILIES = [("llama", "Llama-3.1"), ("claude", "Claude-3.7"), ("gpt-4o", "GPT-4o"), ("deepseek", "DeepSeek-R1"),
            ("gemma", "Gemma-2-9B"), ("qwen", "Qwen-2.5")]


def short_name(model: Column) -> Column:
    """X11: the family's short name, else the first ten characters."""
    out = F.substring(model, 1, 10)
    for key, name in reversed(FAMILIES):
        out = F.when(model.contains(key), F.lit(name)).otherwise(out)
    return out


def last_file_wins(per_file: DataFrame, model: str = "model") -> DataFrame:
    """Of several files with one short name the last by file name counts."""
    named = per_file.withColumn("short_name", short_name(F.col(model)))
    last = named.groupBy("short_name").agg(F.max(model).alias("_last"))
    return named.join(last, "short_name").filter(F.col(model) == F.col("_last")).drop("_last")


def context_comparison(ev: DataFrame) -> DataFrame:
    """Percentages of two result sets side by side, one row per model of either.

    ``ev`` holds both, evaluated together, with ``mode`` ``context`` or ``schema_only``.
    """
    pct = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c) * 100.0 / F.col("n")))
    out = _totals(ev, "mode").groupBy("model").agg(*[F.round(pct(m, c), DIGITS).alias(f"{m}_{c}_pct")
                                                     for m in ("context", "schema_only") for c in ("executed", "schema_ok", "score")])
    return out.withColumn("score_gain", F.round(F.col("context_score_pct") - F.col("schema_only_score_pct"), DIGITS))


def string_error_analysis(gold: DataFrame, results: DataFrame) -> DataFrame:
    """Answers compared as normalised text (X9), forensic variant rules."""
    g = gold.select("id", F.concat(F.lit("["), F.array_join(F.transform("answer", lambda x: F.concat(
        F.lit('"'), x, F.lit('"'))), ", "), F.lit("]")).alias("gold_answer"))
    j = _once(results.select("id", "model", "question", "language", "generated_sql", "generated_answer"), _nv=normalize_answer("generated_answer")).drop(
        "generated_answer").join(_once(g, _ng=normalize_answer("gold_answer")).drop("gold_answer"), "id")
    is_err = (F.col("_nv") != F.col("_ng")) | (F.col("_nv") == F.lit("ERROR_FLAG"))
    q_text = F.concat(F.coalesce(F.col("question"), F.lit("")), F.lit(" "), F.coalesce(F.col("language"), F.lit("")))
    flags = rule_flags(F.col("generated_sql"), q_text, variant=True)
    names = ["hallucination", "legal_ball", "team_mapping", "phase_filter", "aggregation"]
    e = j.filter(is_err)
    err_counts = e.groupBy("model").agg(F.count(F.lit(1)).alias("total_errors"),
                                        *[F.count_if(f).alias(n) for (_, f), n in zip(flags, names)])
    totals = results.groupBy("model").agg(F.count(F.lit(1)).alias("total_queries"))
    return totals.join(err_counts, "model", "left").na.fill(0)


def complexity_counts(gold: DataFrame) -> DataFrame:
    """Share of gold queries per complexity class, long format."""
    q_text = F.concat(F.coalesce(F.col("question_english"), F.lit("")), F.lit(" "),
                      F.coalesce(F.col("question_hindi_1"), F.lit("")))
    flags = complexity_flags(F.col("query"), q_text)
    agg = gold.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    stacked = agg.select("total", F.explode(F.array(*[
        F.struct(F.lit(k).alias("complexity_class"), F.col(k).alias("n")) for k in flags])).alias("s"))
    return stacked.select("s.complexity_class", "s.n",
                          F.round(F.col("s.n") * 100.0 / F.col("total"), DIGITS).alias("pct"))


# Labels of the complexity table.
COMPLEXITY_LABELS = {"joins": "Multi-table Joins", "nested": "Nested Queries / CTEs", "aggregations": "Aggregations (Group By/Having)",
                     "temporal": "Temporal Filtering", "franchise": "Franchise Normalization", "derived": "Derived Metrics (SR, Econ)"}


def complexity_rows(counts: DataFrame) -> DataFrame:
    """The table rows of A23, in the order of the classes."""
    names = F.create_map(*[F.lit(x) for pair in COMPLEXITY_LABELS.items() for x in pair])
    order = F.array_position(F.array(*[F.lit(k) for k in COMPLEXITY_LABELS]), F.col("complexity_class")) - 1
    return counts.select(order.cast("int").alias("line_no"), F.concat(
        F.element_at(names, F.col("complexity_class")), F.lit(" & "), F.col("n").cast("string"), F.lit(" & "), _fixed(F.col("pct"), 1), F.lit("\\% \\\\")).alias("text"))


__all__ = ["evaluate", "item_scores", "partial_totals", "rollup_totals", "summary_of", "rollup_report", "model_summary", "language_breakdown",
           "failure_counts", "complexity_rows",
           "forensic_counts", "report_lines", "latex_rows", "short_name", "last_file_wins", "context_comparison", "string_error_analysis", "complexity_counts", "LABELS"]
