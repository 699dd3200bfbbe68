"""Registered cricket-statistics queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crease.operators import metrics as M
from crease.plans.oracle_base import with_adapter
from crease.sources.adapter import cricket_tables

LIKE_FRAGMENT = "PLATE"
SINCE_DATE = "1998-01-01"

# Franchises, written out for the oracle on its own.
_FRANCHISE = """CASE
  WHEN {c} IN ('Delhi Daredevils', 'Delhi Capitals') THEN 'Delhi Capitals'
  WHEN {c} IN ('Kings XI Punjab', 'Punjab Kings') THEN 'Punjab Kings'
  WHEN {c} IN ('Deccan Chargers', 'Sunrisers Hyderabad') THEN 'Sunrisers Hyderabad'
  WHEN {c} IN ('Pune Warriors', 'Rising Pune Supergiant', 'Rising Pune Supergiants') THEN 'Rising Pune Supergiant'
  WHEN {c} IN ('Royal Challengers Bangalore', 'Royal Challengers Bengaluru') THEN 'Royal Challengers Bengaluru'
  ELSE {c} END"""


def _fr(c: str) -> str:
    return _FRANCHISE.format(c=c)


_LEGAL = "COUNT(CASE WHEN wides = 0 AND noballs = 0 THEN 1 END)"
_BOWLER_WKT = ("COUNT(CASE WHEN wicket_type IS NOT NULL AND wicket_type NOT IN "
               "('run out', 'retired hurt', 'obstructing the field', 'retired out') THEN 1 END)")

_BOWLING_FIGS = f"""
bowling AS (
  SELECT bowler_id, {_LEGAL} AS legal_balls,
         CAST(SUM(runs_scored + wides + noballs) AS BIGINT) AS runs_conceded,
         {_BOWLER_WKT} AS wickets
  FROM deliveries {{where}} GROUP BY bowler_id)
"""


def _q(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(cricket_tables(spark, sf_dir))
    run.__name__ = fn.__name__
    return run


QUERIES = {
    "powerplay_economy_top5": _q(lambda t: M.powerplay_economy_top(t, k=5, min_balls=30)),
    "bowler_summary": _q(M.bowler_summary),
    "batting_summary": _q(M.batting_summary),
    "death_overs_by_franchise": _q(M.death_overs_by_franchise),
    "franchise_season_totals": _q(M.franchise_season_totals),
    "franchise_season_totals_since": _q(lambda t: M.franchise_season_totals(t, since_date=SINCE_DATE)),
    "fielding_dismissals": _q(M.fielding_dismissals),
    "player_debuts": _q(M.player_debuts),
    "season_top_scorers": _q(M.season_top_scorers),
    "top_wicket_takers_with_ties": _q(lambda t: M.top_wicket_takers(t, k=5)),
    "batters_named_like": _q(lambda t: M.batters_named_like(t, LIKE_FRAGMENT)),
    "franchise_wins": _q(M.franchise_wins),
    "ball_number_profile": _q(M.ball_number_profile),
}


ORACLES = {
    "powerplay_economy_top5": with_adapter(f"""
SELECT b.bowler_id, p.player_name, legal_balls,
       CAST(legal_balls AS DOUBLE) / 6.0 AS overs_bowled, runs_conceded,
       CAST(runs_conceded AS DOUBLE) * 6.0 / NULLIF(CAST(legal_balls AS DOUBLE), 0) AS economy
FROM (SELECT * FROM bowling WHERE legal_balls >= 30
      ORDER BY CAST(runs_conceded AS DOUBLE) * 6.0 / NULLIF(CAST(legal_balls AS DOUBLE), 0) ASC NULLS LAST,
               bowler_id LIMIT 5) b
JOIN players p ON p.player_id = b.bowler_id
""", _BOWLING_FIGS.format(where="WHERE over_number <= 5")),

    "bowler_summary": with_adapter("""
SELECT b.bowler_id, p.player_name, legal_balls, CAST(legal_balls AS DOUBLE) / 6.0 AS overs_bowled,
       runs_conceded, CAST(runs_conceded AS DOUBLE) * 6.0 / NULLIF(CAST(legal_balls AS DOUBLE), 0) AS economy,
       wickets
FROM bowling b JOIN players p ON p.player_id = b.bowler_id
""", _BOWLING_FIGS.format(where="")),

    "batting_summary": with_adapter("""
SELECT b.striker_id, p.player_name, runs, balls_faced,
       CAST(runs AS DOUBLE) * 100.0 / NULLIF(CAST(balls_faced AS DOUBLE), 0) AS strike_rate,
       dot_balls, dismissals,
       CAST(runs AS DOUBLE) / NULLIF(CAST(dismissals AS DOUBLE), 0) AS batting_average,
       CAST(runs // NULLIF(dismissals, 0) AS BIGINT) AS batting_average_int
FROM (SELECT striker_id, CAST(SUM(runs_scored) AS BIGINT) AS runs,
             COUNT(CASE WHEN wides = 0 THEN 1 END) AS balls_faced,
             COUNT(CASE WHEN wides = 0 AND runs_scored = 0 THEN 1 END) AS dot_balls,
             COUNT(CASE WHEN player_out_id = striker_id
                         AND wicket_type NOT IN ('retired hurt', 'obstructing the field') THEN 1 END) AS dismissals
      FROM deliveries GROUP BY striker_id) b
JOIN players p ON p.player_id = b.striker_id
"""),

    "death_overs_by_franchise": with_adapter(f"""
SELECT franchise, team_runs, legal_balls, CAST(legal_balls AS DOUBLE) / 6.0 AS overs_faced,
       CAST(team_runs AS DOUBLE) / NULLIF(CAST(legal_balls AS DOUBLE) / 6.0, 0) AS run_rate
FROM (SELECT {_fr('batting_team')} AS franchise,
             CAST(SUM(runs_scored + extra_runs) AS BIGINT) AS team_runs, {_LEGAL} AS legal_balls
      FROM deliveries WHERE over_number >= 16 GROUP BY 1) x
"""),

    "franchise_season_totals": with_adapter(f"""
SELECT m.season, {_fr('d.batting_team')} AS franchise,
       CAST(SUM(d.runs_scored + d.extra_runs) AS BIGINT) AS team_runs,
       COUNT(CASE WHEN d.wicket_type IS NOT NULL THEN 1 END) AS wickets_lost
FROM deliveries d JOIN matches m ON d.match_id = m.match_id
GROUP BY 1, 2
"""),

    "franchise_season_totals_since": with_adapter(f"""
SELECT m.season, {_fr('d.batting_team')} AS franchise,
       CAST(SUM(d.runs_scored + d.extra_runs) AS BIGINT) AS team_runs,
       COUNT(CASE WHEN d.wicket_type IS NOT NULL THEN 1 END) AS wickets_lost
FROM deliveries d JOIN matches m ON d.match_id = m.match_id
WHERE m.match_date >= '{SINCE_DATE}'
GROUP BY 1, 2
"""),

    "fielding_dismissals": with_adapter("""
SELECT f.fielder_id, p.player_name,
       COUNT(CASE WHEN d.wicket_type = 'caught' THEN 1 END) AS catches,
       COUNT(CASE WHEN d.wicket_type = 'stumped' THEN 1 END) AS stumpings,
       COUNT(CASE WHEN d.wicket_type = 'run out' THEN 1 END) AS run_outs,
       COUNT(*) AS dismissals
FROM deliveries d JOIN fielder_dismissals f ON f.delivery_id = d.delivery_id
JOIN players p ON p.player_id = f.fielder_id
GROUP BY f.fielder_id, p.player_name
"""),

    "player_debuts": with_adapter("""
SELECT a.player_id, debut_date, debut_match_id, debut_team, matches_played, p.player_name
FROM (SELECT pm.player_id, MIN(m.match_date) AS debut_date,
             arg_min(m.match_id, m.match_date || '|' || lpad(CAST(m.match_id AS VARCHAR), 20, '0')) AS debut_match_id,
             arg_min(pm.team_name, m.match_date || '|' || lpad(CAST(m.match_id AS VARCHAR), 20, '0')) AS debut_team,
             COUNT(*) AS matches_played
      FROM player_in_match pm JOIN matches m ON pm.match_id = m.match_id
      GROUP BY pm.player_id) a
JOIN players p ON p.player_id = a.player_id
"""),

    "season_top_scorers": with_adapter("""
SELECT s.striker_id, season, runs, p.player_name
FROM (SELECT season, striker_id, runs, RANK() OVER (PARTITION BY season ORDER BY runs DESC) AS rnk
      FROM (SELECT m.season, d.striker_id, CAST(SUM(d.runs_scored) AS BIGINT) AS runs
            FROM deliveries d JOIN matches m ON d.match_id = m.match_id
            GROUP BY m.season, d.striker_id) x) s
JOIN players p ON p.player_id = s.striker_id
WHERE rnk = 1
"""),

    "top_wicket_takers_with_ties": with_adapter("""
SELECT b.bowler_id, wickets, p.player_name
FROM (SELECT bowler_id, wickets, RANK() OVER (ORDER BY wickets DESC) AS rnk FROM bowling) b
JOIN players p ON p.player_id = b.bowler_id
WHERE rnk <= 5
""", _BOWLING_FIGS.format(where="")),

    "batters_named_like": with_adapter(f"""
SELECT a.striker_id, runs, balls_faced, p.player_name
FROM (SELECT striker_id, CAST(SUM(runs_scored) AS BIGINT) AS runs,
             COUNT(CASE WHEN wides = 0 THEN 1 END) AS balls_faced
      FROM deliveries GROUP BY striker_id) a
JOIN players p ON p.player_id = a.striker_id
WHERE p.player_name ILIKE '%{LIKE_FRAGMENT}%'
"""),

    "franchise_wins": with_adapter(f"""
SELECT {_fr('match_winner')} AS franchise, stage, COUNT(*) AS wins,
       COUNT(CASE WHEN toss_winner = match_winner THEN 1 END) AS toss_and_match
FROM matches WHERE match_winner IS NOT NULL
GROUP BY 1, 2 HAVING COUNT(*) > 0
"""),

    "ball_number_profile": with_adapter("""
SELECT ball_number, (wides = 0 AND noballs = 0) AS is_legal, COUNT(*) AS deliveries,
       CAST(SUM(runs_scored + extra_runs) AS BIGINT) AS runs
FROM deliveries GROUP BY 1, 2
"""),
}
