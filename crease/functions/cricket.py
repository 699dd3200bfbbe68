"""Cricket predicates and metric expressions as Catalyst column expressions.

Everything here is a built-in expression: it stays inside whole-stage codegen
and aggregates partially on the map side before any shuffle.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dismissal kinds that are not credited to the bowler.
NOT_BOWLER_WICKETS = ["run out", "retired hurt", "obstructing the field", "retired out"]
# Dismissal kinds that do not count as a batter's dismissal.
NOT_BATTER_DISMISSALS = ["retired hurt", "obstructing the field"]

# Franchise normalisation, old and modern names -> franchise.
FRANCHISES = {
    "Delhi Capitals": ["Delhi Daredevils", "Delhi Capitals"],
    "Punjab Kings": ["Kings XI Punjab", "Punjab Kings"],
    "Sunrisers Hyderabad": ["Deccan Chargers", "Sunrisers Hyderabad"],
    "Rising Pune Supergiant": ["Pune Warriors", "Rising Pune Supergiant", "Rising Pune Supergiants"],
    "Royal Challengers Bengaluru": ["Royal Challengers Bangalore", "Royal Challengers Bengaluru"],
}

POWERPLAY_LAST_OVER = 5      # overs are 0-indexed; powerplay is over_number <= 5
DEATH_FIRST_OVER = 16        # death overs are over_number >= 16


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- F*: predicates -------------------------------------------------------

def name_like(col, fragment: str) -> Column:
    """``LIKE '%fragment%'`` with SQLite's ASCII case-insensitivity."""
    return _c(col).ilike(f"%{fragment}%")


def is_powerplay(over="over_number") -> Column:
    """F2"""
    return _c(over) <= POWERPLAY_LAST_OVER


def is_death_over(over="over_number") -> Column:
    """F3"""
    return _c(over) >= DEATH_FIRST_OVER


def is_bowler_wicket(kind="wicket_type") -> Column:
    """wicket credited to the bowler."""
    return _c(kind).isNotNull() & ~_c(kind).isin(*NOT_BOWLER_WICKETS)


def is_batter_dismissal(out="player_out_id", striker="striker_id", kind="wicket_type") -> Column:
    """the striker was dismissed (NULL kind -> not counted, as in SQL)."""
    return (_c(out) == _c(striker)) & ~_c(kind).isin(*NOT_BATTER_DISMISSALS)


def is_legal_delivery(wides="wides", noballs="noballs") -> Column:
    """F6"""
    return (_c(wides) == 0) & (_c(noballs) == 0)


def is_ball_faced(wides="wides") -> Column:
    """F7"""
    return _c(wides) == 0


def is_dot_ball(wides="wides", runs="runs_scored") -> Column:
    """F8"""
    return (_c(wides) == 0) & (_c(runs) == 0)


def franchise(col) -> Column:
    """map historical team names to their franchise, others unchanged.

    A literal map lookup: no join, no shuffle, evaluated in codegen.
    """
    pairs = [(old, new) for new, olds in FRANCHISES.items() for old in olds]
    lookup = F.create_map(*chain.from_iterable((F.lit(o), F.lit(n)) for o, n in pairs))
    c = _c(col)
    return F.coalesce(F.try_element_at(lookup, c), c)


# --- A*: aggregate expressions -------------------------------------------

def legal_balls() -> Column:
    """A1: legal deliveries."""
    return F.count_if(is_legal_delivery())


def overs(balls: Column | None = None) -> Column:
    """A2: overs bowled/faced = legal balls / 6.0."""
    b = legal_balls() if balls is None else balls
    return b.cast("double") / F.lit(6.0)


def runs_conceded() -> Column:
    """A3: runs charged to the bowler (byes and leg-byes excluded)."""
    return F.sum(F.col("runs_scored") + F.col("wides") + F.col("noballs"))


def economy(conceded: Column | None = None, balls: Column | None = None) -> Column:
    """A4: runs conceded per six legal balls; NULL when no legal ball."""
    rc = runs_conceded() if conceded is None else conceded
    b = legal_balls() if balls is None else balls
    return F.try_divide(rc.cast("double") * F.lit(6.0), b.cast("double"))


def balls_faced() -> Column:
    """A5"""
    return F.count_if(is_ball_faced())


def batter_runs() -> Column:
    """A6"""
    return F.sum("runs_scored")


def strike_rate(runs: Column | None = None, faced: Column | None = None) -> Column:
    """Runs per 100 balls faced; NULL when no ball faced."""
    r = batter_runs() if runs is None else runs
    b = balls_faced() if faced is None else faced
    return F.try_divide(r.cast("double") * F.lit(100.0), b.cast("double"))


def dot_balls() -> Column:
    """A8"""
    return F.count_if(is_dot_ball())


def dismissals() -> Column:
    return F.count_if(is_batter_dismissal())


def batting_average(runs: Column, outs: Column, truncate: bool = False) -> Column:
    """Runs per dismissal; NULL for no dismissal.

    ``truncate=True`` reproduces integer division (runs div outs), as the
    integer/integer quotient of the original definition gives.
    """
    if truncate:
        return F.when(outs != 0, (runs.cast("double") / outs.cast("double")).cast("long"))
    return F.try_divide(runs.cast("double"), outs.cast("double"))


def bowler_wickets() -> Column:
    """A10"""
    return F.count_if(is_bowler_wicket())


def team_runs() -> Column:
    """Runs off the bat plus all extras."""
    return F.sum(F.col("runs_scored") + F.col("extra_runs"))
