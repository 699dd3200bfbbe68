"""Cricket tables derived from the driver's TPC-H-style tables.

The test data has no match documents, so the five cricket tables are built from
driver tables with arithmetic that Spark and DuckDB evaluate identically:

* one order is one over, 40 consecutive orders are one match (2 innings x 20 overs);
* a match's header attributes come from the first order of its block;
  every line item becomes a delivery, so all of ``lineitem`` is used;
* players are parts (``P<partkey>``, batters) and suppliers (``S<suppkey>``, bowlers).

Plan shape: the 12-team lookup is a literal map expression (no join); deliveries
join matches on ``match_id`` (AQE broadcasts the match side when its runtime size
is under the threshold, otherwise both sides shuffle on ``match_id``); the
legal-ball window is partitioned by ``(match_id, l_orderkey)`` so the join's
hash partitioning on ``match_id`` already satisfies it and no second shuffle is
added.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.sources.tables import table

# Team names by index, as in the adapter definition.
TEAM_NAMES = [
    "Delhi Daredevils", "Delhi Capitals", "Kings XI Punjab", "Punjab Kings",
    "Deccan Chargers", "Sunrisers Hyderabad", "Pune Warriors", "Rising Pune Supergiant",
    "Rising Pune Supergiants", "Royal Challengers Bangalore", "Royal Challengers Bengaluru",
    "Mumbai Indians",
]

# Wicket kind by round(l_tax * 100); anything else is 'hit wicket'.
WICKET_KINDS = [
    "caught", "bowled", "lbw", "run out", "stumped", "retired hurt",
    "obstructing the field", "retired out",
]

OVERS_PER_INNING = 20
ORDERS_PER_MATCH = 40
# Spaces the surrogate delivery ids; an over with more deliveries raises an error.
DELIVERY_ID_STRIDE = 4096


def _team(idx: Column) -> Column:
    lookup = F.create_map(*chain.from_iterable((F.lit(i), F.lit(t)) for i, t in enumerate(TEAM_NAMES)))
    return F.try_element_at(lookup, idx.cast("int"))


def _pct(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("int")


@dataclass
class CricketTables:
    players: DataFrame
    matches: DataFrame
    deliveries: DataFrame
    player_in_match: DataFrame
    fielder_dismissals: DataFrame


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("player_id"),
        F.col("p_name").alias("player_name"))
    supp = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("player_id"),
        F.col("s_name").alias("player_name"))
    return part.unionByName(supp)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The header of a match is the first order there is of its block, found among all of them.
    o = table(spark, sf_dir, "orders")
    header = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"]
    o = (o.groupBy(F.floor(F.col("o_orderkey") / ORDERS_PER_MATCH).alias("_block"))
         .agg(F.min(F.struct(*header)).alias("h")).select("h.*"))
    cust = F.col("o_custkey")
    match_id = F.floor(F.col("o_orderkey") / ORDERS_PER_MATCH).cast("long")
    team1 = _team(cust % 12)
    team2 = _team((cust + 1 + F.floor(F.col("o_orderkey") / ORDERS_PER_MATCH) % 11) % 12)
    status = F.col("o_orderstatus")
    return (
        o.select(
            match_id.alias("match_id"),
            F.year("o_orderdate").cast("string").alias("season"),
            F.col("o_orderdate").cast("date").cast("string").alias("match_date"),
            F.concat(F.lit("Venue "), (cust % 12).cast("string")).alias("venue"),
            F.when(cust % 12 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("City "), (cust % 5).cast("string"))).alias("city"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Final")
             .when(F.col("o_orderpriority") == "2-HIGH", "Eliminator").otherwise("Group").alias("stage"),
            team1.alias("team1"),
            team2.alias("team2"),
            F.when(cust % 2 == 0, team1).otherwise(team2).alias("toss_winner"),
            F.when(cust % 3 == 0, "bat").otherwise("field").alias("toss_decision"),
            F.when(status == "F", team1).when(status == "O", team2).alias("match_winner"),
            F.when(status == "F", "runs").when(status == "O", "wickets").otherwise("no result").alias("result_type"),
            F.when(status == "P", F.lit(None).cast("int"))
             .otherwise((1 + cust % 10).cast("int")).alias("result_margin"),
            F.concat(F.lit("P"), (cust % 200).cast("string")).alias("player_of_match_id"),
        )
    )


def player_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind), key.cast("string"))


def _wicket_type() -> Column:
    kind = F.try_element_at(F.array(*[F.lit(k) for k in WICKET_KINDS]), _pct("l_tax") + 1)
    return F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity").cast("int") % 4 == 0), F.coalesce(kind, F.lit("hit wicket")))


def ball_counts(qty: Column, disc: Column) -> dict[str, Column]:
    """Runs and extras of a delivery by its whole quantity and its discount in per cent."""
    return {"runs_scored": qty % 7, "wides": (disc == 10).cast("int"), "noballs": (disc == 9).cast("int"),
            "byes": (disc == 8).cast("int"), "legbyes": (disc == 7).cast("int")}


def delivery_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with no more than deliveries are made of, of any match: few bytes a row where they are shuffled."""
    return table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL").select(
        F.floor(F.col("l_orderkey") / ORDERS_PER_MATCH).cast("long").alias("match_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", F.col("l_quantity").cast("int").alias("qty"), _pct("l_discount").alias("disc"), _wicket_type().alias("wicket_type"))


def deliveries(spark: SparkSession, sf_dir: str, match_df: DataFrame | None = None) -> DataFrame:
    """Flat deliveries with the legal-ball number and a stable surrogate id."""
    li = table(spark, sf_dir, "lineitem")
    m = (match_df if match_df is not None else matches(spark, sf_dir)).select("match_id", "team1", "team2")
    okey = F.col("l_orderkey")
    disc = _pct("l_discount")
    qty = F.col("l_quantity").cast("int")
    d0 = li.select(
        F.floor(okey / ORDERS_PER_MATCH).cast("long").alias("match_id"),
        (1 + F.floor((okey % ORDERS_PER_MATCH) / OVERS_PER_INNING)).cast("int").alias("inning"),
        (okey % OVERS_PER_INNING).cast("int").alias("over_number"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("striker_id"),
        F.concat(F.lit("P"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey") + 1)
                 .otherwise(F.col("l_partkey") - 1).cast("string")).alias("non_striker_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("bowler_id"),
        *[c.alias(name) for name, c in ball_counts(qty, disc).items()],
        _wicket_type().alias("wicket_type"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    # Partitioning by (match_id, l_orderkey) is the same grouping as by
    # l_orderkey alone (an order lies in one match) and is satisfied by the
    # join's hash partitioning on match_id.
    over_w = (Window.partitionBy("match_id", "l_orderkey")
              .orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    legal = ((F.col("wides") == 0) & (F.col("noballs") == 0)).cast("int")
    j = d0.join(m, "match_id")
    return j.select(
        (okey * DELIVERY_ID_STRIDE + F.when(F.row_number().over(over_w) < DELIVERY_ID_STRIDE, F.row_number().over(over_w))
         .otherwise(F.raise_error(F.lit("an over has too many deliveries for its id range")).cast("int"))).alias("delivery_id"),
        "match_id", "inning", "over_number",
        F.sum(legal).over(over_w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
         .cast("int").alias("ball_number"),
        F.when(F.col("inning") == 1, F.col("team1")).otherwise(F.col("team2")).alias("batting_team"),
        F.when(F.col("inning") == 1, F.col("team2")).otherwise(F.col("team1")).alias("bowling_team"),
        "striker_id", "non_striker_id", "bowler_id", "runs_scored",
        (F.col("wides") + F.col("noballs") + F.col("byes") + F.col("legbyes")).alias("extra_runs"),
        "wides", "noballs", "byes", "legbyes", "wicket_type",
        F.when((F.col("wicket_type") == "run out") & (F.col("l_partkey") % 3 == 0), F.col("non_striker_id"))
         .when(F.col("wicket_type").isNotNull(), F.col("striker_id")).alias("player_out_id"),
        F.when(F.col("wicket_type").isin("caught", "stumped", "run out"),
               F.concat(F.lit("P"), (F.col("l_suppkey") % 200).cast("string"))).alias("fielder_id"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


def player_in_match(delivery_df: DataFrame) -> DataFrame:
    """Batters with their batting team and bowlers with their bowling team;
    the team of the earliest inning is kept per (match, player)."""
    bat = delivery_df.select("match_id", F.col("striker_id").alias("player_id"),
                             F.col("batting_team").alias("team_name"), "inning")
    bowl = delivery_df.select("match_id", F.col("bowler_id").alias("player_id"),
                              F.col("bowling_team").alias("team_name"), "inning")
    return (bat.unionByName(bowl)
            .groupBy("match_id", "player_id")
            .agg(F.min_by("team_name", "inning").alias("team_name")))


def fielder_dismissals(delivery_df: DataFrame) -> DataFrame:
    return (delivery_df.filter(F.col("fielder_id").isNotNull())
            .select(F.col("delivery_id").alias("fielder_dismissal_id"), "delivery_id", "fielder_id"))


def cricket_tables(spark: SparkSession, sf_dir: str) -> CricketTables:
    m = matches(spark, sf_dir)
    d = deliveries(spark, sf_dir, m)
    return CricketTables(players(spark, sf_dir), m, d, player_in_match(d), fielder_dismissals(d))
