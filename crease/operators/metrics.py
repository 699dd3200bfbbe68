"""Cricket statistics jobs.

Shape of every job: filter deliveries, aggregate by an id (partial aggregation
runs map-side, so a bowler or batter holding a third of all deliveries is
combined before the shuffle and never lands whole in one task), and only then
join player names onto the aggregated rows. Name joins therefore see one row per
player, never the delivery-level skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crease.functions import cricket as C
from crease.sources.adapter import CricketTables


def with_names(df: DataFrame, players: DataFrame, id_col: str, name_col: str = "player_name",
               how: str = "inner") -> DataFrame:
    """Attach player names to aggregated rows (``left`` for nullable ids)."""
    names = players.select(F.col("player_id").alias(id_col), F.col("player_name").alias(name_col))
    return df.join(names, id_col, how)


def bowling_figures(t: CricketTables, deliveries: DataFrame | None = None) -> DataFrame:
    """Per bowler: legal balls, overs, runs conceded, economy, wickets (A1-A4, A10)."""
    d = t.deliveries if deliveries is None else deliveries
    return (d.groupBy("bowler_id")
            .agg(C.legal_balls().alias("legal_balls"),
                 C.runs_conceded().cast("long").alias("runs_conceded"),
                 C.bowler_wickets().alias("wickets"))
            .withColumn("overs_bowled", C.overs(F.col("legal_balls")))
            .withColumn("economy", C.economy(F.col("runs_conceded"), F.col("legal_balls"))))


def powerplay_economy_top(t: CricketTables, k: int = 5, min_balls: int = 30) -> DataFrame:
    """Flagship: the k best powerplay economy rates, with names.

    Ties on economy are broken by bowler id so the top-k is deterministic.
    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition keeps
    its own k best and only k rows per partition reach the final merge.
    """
    pp = t.deliveries.filter(C.is_powerplay())
    figs = bowling_figures(t, pp).filter(F.col("legal_balls") >= min_balls)
    top = figs.orderBy(F.col("economy").asc_nulls_last(), F.col("bowler_id")).limit(k)
    return with_names(top, t.players, "bowler_id").select(
        "bowler_id", "player_name", "legal_balls", "overs_bowled", "runs_conceded", "economy")


def bowler_summary(t: CricketTables) -> DataFrame:
    """All bowlers with their full figures (L3: no limit)."""
    return with_names(bowling_figures(t), t.players, "bowler_id").select(
        "bowler_id", "player_name", "legal_balls", "overs_bowled", "runs_conceded", "economy", "wickets")


def batting_summary(t: CricketTables) -> DataFrame:
    """Per batter: runs, balls faced, strike rate, dots, dismissals, averages."""
    agg = (t.deliveries.groupBy("striker_id")
           .agg(C.batter_runs().cast("long").alias("runs"),
                C.balls_faced().alias("balls_faced"),
                C.dot_balls().alias("dot_balls"),
                C.dismissals().alias("dismissals")))
    agg = (agg.withColumn("strike_rate", C.strike_rate(F.col("runs"), F.col("balls_faced")))
              .withColumn("batting_average", C.batting_average(F.col("runs"), F.col("dismissals")))
              .withColumn("batting_average_int",
                          C.batting_average(F.col("runs"), F.col("dismissals"), truncate=True)))
    return with_names(agg, t.players, "striker_id").select(
        "striker_id", "player_name", "runs", "balls_faced", "strike_rate", "dot_balls",
        "dismissals", "batting_average", "batting_average_int")


def death_overs_by_franchise(t: CricketTables) -> DataFrame:
    """Team runs and overs faced in the death overs per batting franchise."""
    d = t.deliveries.filter(C.is_death_over())
    return (d.groupBy(C.franchise("batting_team").alias("franchise"))
            .agg(C.team_runs().cast("long").alias("team_runs"),
                 C.legal_balls().alias("legal_balls"))
            .withColumn("overs_faced", C.overs(F.col("legal_balls")))
            .withColumn("run_rate", F.try_divide(F.col("team_runs").cast("double"), F.col("overs_faced"))))


def franchise_season_totals(t: CricketTables, since_date: str | None = None) -> DataFrame:
    """Runs and wickets per (season, batting franchise), deliveries joined to matches.

    The match side is projected to two columns before the join, so AQE can
    broadcast it from its runtime size; otherwise both sides shuffle on match_id.
    """
    m = t.matches.select("match_id", "season", "match_date")
    if since_date:
        m = m.filter(F.col("match_date") >= since_date)
    d = t.deliveries.select("match_id", "batting_team", "runs_scored", "extra_runs", "wicket_type")
    return (d.join(m, "match_id")
            .groupBy("season", C.franchise("batting_team").alias("franchise"))
            .agg(C.team_runs().cast("long").alias("team_runs"),
                 F.count_if(F.col("wicket_type").isNotNull()).alias("wickets_lost")))


def fielding_dismissals(t: CricketTables) -> DataFrame:
    """Fielders' dismissals by kind: Deliveries -> FielderDismissals -> Players."""
    d = t.deliveries.select("delivery_id", "wicket_type")
    fd = t.fielder_dismissals.select("delivery_id", "fielder_id")
    agg = (fd.join(d, "delivery_id")
           .groupBy("fielder_id")
           .agg(F.count_if(F.col("wicket_type") == "caught").alias("catches"),
                F.count_if(F.col("wicket_type") == "stumped").alias("stumpings"),
                F.count_if(F.col("wicket_type") == "run out").alias("run_outs"),
                F.count(F.lit(1)).alias("dismissals")))
    return with_names(agg, t.players, "fielder_id").select(
        "fielder_id", "player_name", "catches", "stumpings", "run_outs", "dismissals")


def player_debuts(t: CricketTables) -> DataFrame:
    """Debut = MIN(match_date) per player; its match by date then id."""
    pm = t.player_in_match.select("match_id", "player_id", "team_name")
    m = t.matches.select("match_id", "match_date")
    agg = (pm.join(m, "match_id")
           .groupBy("player_id")
           .agg(F.min("match_date").alias("debut_date"),
                F.min_by("match_id", F.struct("match_date", "match_id")).alias("debut_match_id"),
                F.min_by("team_name", F.struct("match_date", "match_id")).alias("debut_team"),
                F.count(F.lit(1)).alias("matches_played")))
    return with_names(agg, t.players, "player_id")


def season_top_scorers(t: CricketTables) -> DataFrame:
    """Highest run scorer(s) per season, every tied player kept.

    The rank window runs over one row per (season, batter), partitioned by season.
    """
    m = t.matches.select("match_id", "season")
    per = (t.deliveries.select("match_id", "striker_id", "runs_scored").join(m, "match_id")
           .groupBy("season", "striker_id").agg(C.batter_runs().cast("long").alias("runs")))
    w = Window.partitionBy("season").orderBy(F.col("runs").desc())
    top = per.withColumn("rnk", F.rank().over(w)).filter(F.col("rnk") == 1).drop("rnk")
    return with_names(top, t.players, "striker_id")


def top_wicket_takers(t: CricketTables, k: int = 5) -> DataFrame:
    """Every bowler whose wicket count ranks within the top k, ties included.

    ``rank() <= k`` over all bowlers is the same as ``wickets >= v_k`` where v_k
    is the k-th largest count. v_k comes from a distributed top-k
    (TakeOrderedAndProject) evaluated as a scalar subquery, so no window ever
    pulls all bowlers into one partition.
    """
    figs = bowling_figures(t).select("bowler_id", "wickets")
    kth = (figs.orderBy(F.col("wickets").desc()).limit(k)
           .agg(F.min("wickets")).scalar())
    top = figs.filter(F.col("wickets") >= kth)
    return with_names(top, t.players, "bowler_id")


def batters_named_like(t: CricketTables, fragment: str) -> DataFrame:
    """Runs of batters whose name contains ``fragment`` (F1, case-insensitive LIKE)."""
    p = t.players.filter(C.name_like("player_name", fragment)).select(
        F.col("player_id").alias("striker_id"), "player_name")
    # The filter goes first: a player is one row, so this join adds none, and only the deliveries of the named are aggregated.
    d = t.deliveries.select("striker_id", "runs_scored", "wides").join(p, "striker_id")
    return d.groupBy("striker_id", "player_name").agg(C.batter_runs().cast("long").alias("runs"), C.balls_faced().alias("balls_faced")).select(
        "striker_id", "runs", "balls_faced", "player_name")


def franchise_wins(t: CricketTables) -> DataFrame:
    """Wins per franchise and stage (F9 on match_winner, A13 HAVING wins > 0)."""
    return (t.matches.filter(F.col("match_winner").isNotNull())
            .groupBy(C.franchise("match_winner").alias("franchise"), "stage")
            .agg(F.count(F.lit(1)).alias("wins"),
                 F.count_if(F.col("toss_winner") == F.col("match_winner")).alias("toss_and_match"))
            .filter(F.col("wins") > 0))


def ball_number_profile(t: CricketTables) -> DataFrame:
    """Deliveries per legal-ball number and legality (checks P11/W1 output)."""
    return (t.deliveries.groupBy("ball_number", C.is_legal_delivery().alias("is_legal"))
            .agg(F.count(F.lit(1)).alias("deliveries"),
                 C.team_runs().cast("long").alias("runs")))
