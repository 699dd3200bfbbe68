"""Adapter CTEs shared by the oracle SQL strings.

The text runs unchanged in DuckDB and Spark SQL and builds the same five
cricket tables as :mod:`crease.sources.adapter`. Ratios are written with DOUBLE
casts so both engines produce IEEE doubles; integer sums are cast to BIGINT
(DuckDB's SUM over integers is HUGEINT).
"""

ADAPTER_CTES = """
teams AS (
  SELECT * FROM (VALUES
    (0,'Delhi Daredevils'),(1,'Delhi Capitals'),(2,'Kings XI Punjab'),(3,'Punjab Kings'),
    (4,'Deccan Chargers'),(5,'Sunrisers Hyderabad'),(6,'Pune Warriors'),(7,'Rising Pune Supergiant'),
    (8,'Rising Pune Supergiants'),(9,'Royal Challengers Bangalore'),(10,'Royal Challengers Bengaluru'),
    (11,'Mumbai Indians')) AS t(team_idx, team)),
players AS (
  SELECT concat('P', CAST(p_partkey AS STRING)) AS player_id, p_name AS player_name FROM part
  UNION ALL
  SELECT concat('S', CAST(s_suppkey AS STRING)), s_name FROM supplier),
matches AS (
  SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS match_id,
         CAST(year(o_orderdate) AS STRING) AS season,
         CAST(CAST(o_orderdate AS DATE) AS STRING) AS match_date,
         concat('Venue ', CAST(o_custkey % 12 AS STRING)) AS venue,
         CASE WHEN o_custkey % 12 = 0 THEN NULL ELSE concat('City ', CAST(o_custkey % 5 AS STRING)) END AS city,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Final' WHEN '2-HIGH' THEN 'Eliminator' ELSE 'Group' END AS stage,
         t1.team AS team1, t2.team AS team2,
         CASE WHEN o_custkey % 2 = 0 THEN t1.team ELSE t2.team END AS toss_winner,
         CASE WHEN o_custkey % 3 = 0 THEN 'bat' ELSE 'field' END AS toss_decision,
         CASE o_orderstatus WHEN 'F' THEN t1.team WHEN 'O' THEN t2.team END AS match_winner,
         CASE o_orderstatus WHEN 'F' THEN 'runs' WHEN 'O' THEN 'wickets' ELSE 'no result' END AS result_type,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(1 + o_custkey % 10 AS INT) END AS result_margin,
         concat('P', CAST(o_custkey % 200 AS STRING)) AS player_of_match_id
  FROM orders
  JOIN teams t1 ON t1.team_idx = o_custkey % 12
  JOIN teams t2 ON t2.team_idx = (o_custkey + 1 + floor(o_orderkey / 40) % 11) % 12
  WHERE o_orderkey IN (SELECT MIN(o_orderkey) FROM orders GROUP BY floor(o_orderkey / 40))),
d0 AS (
  SELECT CAST(floor(l_orderkey / 40) AS BIGINT) AS match_id,
         CAST(1 + floor((l_orderkey % 40) / 20) AS INT) AS inning,
         CAST(l_orderkey % 20 AS INT) AS over_number,
         concat('P', CAST(l_partkey AS STRING)) AS striker_id,
         concat('P', CAST(CASE WHEN l_partkey % 2 = 0 THEN l_partkey + 1 ELSE l_partkey - 1 END AS STRING)) AS non_striker_id,
         concat('S', CAST(l_suppkey AS STRING)) AS bowler_id,
         CAST(l_quantity AS INT) % 7 AS runs_scored,
         CASE WHEN CAST(round(l_discount * 100) AS INT) = 10 THEN 1 ELSE 0 END AS wides,
         CASE WHEN CAST(round(l_discount * 100) AS INT) = 9 THEN 1 ELSE 0 END AS noballs,
         CASE WHEN CAST(round(l_discount * 100) AS INT) = 8 THEN 1 ELSE 0 END AS byes,
         CASE WHEN CAST(round(l_discount * 100) AS INT) = 7 THEN 1 ELSE 0 END AS legbyes,
         CASE WHEN l_returnflag = 'R' AND CAST(l_quantity AS INT) % 4 = 0 THEN
           CASE CAST(round(l_tax * 100) AS INT) WHEN 0 THEN 'caught' WHEN 1 THEN 'bowled' WHEN 2 THEN 'lbw'
             WHEN 3 THEN 'run out' WHEN 4 THEN 'stumped' WHEN 5 THEN 'retired hurt'
             WHEN 6 THEN 'obstructing the field' WHEN 7 THEN 'retired out' ELSE 'hit wicket' END END AS wicket_type,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem),
deliveries AS (
  SELECT l_orderkey * 4096 + ROW_NUMBER() OVER (
           PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS delivery_id,
         d0.match_id, inning, over_number,
         CAST(SUM(CASE WHEN wides = 0 AND noballs = 0 THEN 1 ELSE 0 END) OVER (
           PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS ball_number,
         CASE WHEN inning = 1 THEN team1 ELSE team2 END AS batting_team,
         CASE WHEN inning = 1 THEN team2 ELSE team1 END AS bowling_team,
         striker_id, non_striker_id, bowler_id, runs_scored,
         wides + noballs + byes + legbyes AS extra_runs, wides, noballs, byes, legbyes, wicket_type,
         CASE WHEN wicket_type = 'run out' AND l_partkey % 3 = 0 THEN non_striker_id
              WHEN wicket_type IS NOT NULL THEN striker_id END AS player_out_id,
         CASE WHEN wicket_type IN ('caught','stumped','run out') THEN
              concat('P', CAST(l_suppkey % 200 AS STRING)) END AS fielder_id,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM d0 JOIN matches m ON d0.match_id = m.match_id),
player_in_match AS (
  SELECT match_id, player_id, min_by(team_name, inning) AS team_name FROM (
    SELECT match_id, striker_id AS player_id, batting_team AS team_name, inning FROM deliveries
    UNION ALL
    SELECT match_id, bowler_id, bowling_team, inning FROM deliveries) pm
  GROUP BY match_id, player_id),
fielder_dismissals AS (
  SELECT delivery_id AS fielder_dismissal_id, delivery_id, fielder_id
  FROM deliveries WHERE fielder_id IS NOT NULL)
"""


def with_adapter(body: str, extra_ctes: str = "") -> str:
    """``WITH <adapter CTEs>[, extra] <body>``."""
    ctes = ADAPTER_CTES.strip()
    if extra_ctes:
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"
