"""SQL forensic rules (E8, E9) and query-complexity tags (Q8).

All rules are substring / regex tests on upper-cased SQL and lower-cased
question text, evaluated as Catalyst expressions and collected into a label
array per item.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crease.functions.answers import let

# Forensic rule vocabularies.
HALLUCINATED_COLUMNS = ["TOTAL_RUNS", "BATSMAN_RUNS", "MATCH_YEAR", "WINNER_ID", "CITY_NAME", "VENUE_ID"]
HALLUCINATED_COLUMNS_VARIANT = [c for c in HALLUCINATED_COLUMNS if c != "VENUE_ID"]
RATE_WORDS = ["economy", "strike rate"]
FRANCHISE_PLACES = ["delhi", "punjab", "bangalore", "hyderabad", "pune"]
OLD_TEAM_MARKERS = ["DAREDEVILS", "KINGS XI", "BANGALORE", "CHARGERS"]
PHASE_WORDS = ["powerplay", "death"]

LABELS = ["Hallucinated Schema", "Legal Delivery Logic", "Team Entity Resolution",
          "Phase Filtering", "Incorrect Aggregation"]

# Complexity classes.
COMPLEXITY_CLASSES = ["joins", "nested", "aggregations", "temporal", "franchise", "derived"]
TEMPORAL_MARKERS = ["MATCH_DATE", "SEASON", "YEAR", "DATE("]
HISTORICAL_NAMES = ["delhi daredevils", "kings xi punjab", "deccan chargers", "pune warriors",
                    "rising pune", "royal challengers bangalore"]
DERIVED_WORDS = ["average", "economy", "strike rate", "net run rate"]


def _any(col: Column, words) -> Column:
    out = None
    for w in words:
        c = col.contains(w)
        out = c if out is None else (out | c)
    return out


def rule_flags(sql: Column, question: Column, variant: bool = False) -> list[tuple[str, Column]]:
    """E8 (or E9 with ``variant``): (label, fired) for the five rules.

    ``sql`` is upper-cased and ``question`` lower-cased here.
    """
    return _fired(*_cased(sql, question), variant)


def _cased(sql: Column, question: Column) -> tuple[Column, Column]:
    return F.upper(F.coalesce(sql.cast("string"), F.lit(""))), F.lower(F.coalesce(question.cast("string"), F.lit("")))


def _fired(s: Column, q: Column, variant: bool) -> list[tuple[str, Column]]:
    cols = HALLUCINATED_COLUMNS_VARIANT if variant else HALLUCINATED_COLUMNS
    return [
        (LABELS[0], _any(s, cols)),
        (LABELS[1], _any(q, RATE_WORDS) & ~s.contains("WIDES")),
        (LABELS[2], _any(q, FRANCHISE_PLACES) & ~s.contains("CASE") & _any(s, OLD_TEAM_MARKERS)),
        (LABELS[3], _any(q, PHASE_WORDS) & ~s.contains("OVER_NUMBER")),
        (LABELS[4], q.contains("average") & s.contains("SUM(") & ~s.contains("/")),
    ]


def error_labels(sql: Column, question: Column, variant: bool = False) -> Column:
    """Array of fired labels in rule order (multi-label)."""
    def fired(texts: Column) -> Column:
        flags = _fired(texts["sql"], texts["question"], variant)
        return F.filter(F.array(*[F.when(hit, F.lit(label)) for label, hit in flags]), lambda x: x.isNotNull())

    sql, question = _cased(sql, question)
    return let(F.struct(sql.alias("sql"), question.alias("question")), fired)


def complexity_flags(sql: Column, question_text: Column) -> dict[str, Column]:
    """Q8: six classes from upper-cased SQL and lower-cased question text."""
    s = F.upper(F.coalesce(sql, F.lit("")))
    q = F.lower(F.coalesce(question_text, F.lit("")))
    return {
        "joins": s.contains(" JOIN "),
        "nested": s.rlike(r"\(\s*SELECT") | s.contains("WITH "),
        "aggregations": s.contains("GROUP BY") | s.contains("HAVING"),
        "temporal": _any(s, TEMPORAL_MARKERS),
        "franchise": s.contains("CASE WHEN") | _any(q, HISTORICAL_NAMES),
        "derived": _any(q, DERIVED_WORDS) | (s.contains("/") & s.contains("COUNT")),
    }


def team_mention(question: Column) -> Column:
    """Question names a renamed franchise or its abbreviation (router rule)."""
    # Team names and abbreviations the router looks for.
    terms = ["delhi", "dc", "dd", "punjab", "pbks", "kxip", "hyderabad", "srh", "pune", "rps",
             "bengaluru", "bangalore", "rcb"]
    return F.lower(question).rlike(r"\b(" + "|".join(terms) + r")\b")
