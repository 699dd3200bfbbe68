"""Match-document ingestion into five tables (P1-P21, C3/C4 at load time).

Input: one row per match document (``match_id``, ``info``, ``innings``), as
produced by :func:`crease.sources.match_docs.read_match_files`.

Per-document rules run on the document row with higher-order functions:
registry clean-up (one index of names per document), the per-over legal-ball counter
(computed before any delivery is dropped), first wicket and fielder names, name lookups and
the drop rules. Deliveries are exploded last, with their place among the kept ones, so that
no row carries a registry and none is sorted for its place.

Shuffles: none of delivery rows. Kept deliveries are written once; what is counted per match and summed up over matches
(:mod:`crease.operators.dense_ids`) goes to them as a broadcast, up to ``BROADCAST_MATCHES`` matches. Players need one
aggregation across matches (partially aggregated map-side).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crease.functions.answers import let, strip
from crease.operators.dense_ids import exclusive_prefix_sums
from crease.session import checkpoint_dir


#: Entries of a registry in one block of its index.
BLOCK = 16
#: Up to so many matches their offsets, four numbers each, go to all tasks; with more they are joined by shuffles.
BROADCAST_MATCHES = 2_000_000


@dataclass
class IngestResult:
    players: DataFrame
    matches: DataFrame
    kept: Callable[[], DataFrame]
    player_in_match: DataFrame
    rejected_files: DataFrame
    rejected_rows: DataFrame
    summary: DataFrame

    @cached_property
    def _placed(self) -> DataFrame:
        return _placed(self.kept())

    @cached_property
    def deliveries(self) -> DataFrame:
        return _deliveries(self._placed)

    @cached_property
    def fielder_dismissals(self) -> DataFrame:
        return _fielder_dismissals(self._placed)


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _registry() -> Column:
    """Struct of ``entries`` (k, pid, pos) over trimmed names and their ``index`` for :func:`_lookup`: entries come in the order
    of names, so blocks of them with each block's first name spare a look at every entry.

    Names or ids that are blank are left out. Of entries with one trimmed name the last supplies the id, the first
    the position: sorted by (name, position) these are the ends of each run of one name.
    """
    def cleaned(raw: Column) -> Column:
        valid = F.filter(raw, lambda e: _nonempty(e["value"]) & _nonempty(e["key"]))
        return F.sort_array(F.transform(valid, lambda e: F.struct(strip(e["key"]).alias("k"), e["pos"].alias("pos"), e["value"].alias("pid"))))

    def ends(s: Column) -> Column:
        firsts = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["k"] != e["k"], F.lit(True)))
        lasts = F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["k"] != e["k"], F.lit(True)))
        return F.zip_with(firsts, lasts, lambda f, l: F.struct(f["k"].alias("k"), l["pid"].alias("pid"), f["pos"].alias("pos")))

    raw = F.transform(F.map_entries(F.col("info.registry.people")),
                      lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("pos")))

    def index(entries: Column) -> Column:
        starts = F.filter(F.transform(entries, lambda e, i: F.when(i % BLOCK == 0, i + 1)), lambda i: i.isNotNull())
        return F.transform(starts, lambda i: F.struct(F.get(entries, i - 1)["k"].alias("first"), F.map_from_entries(
            F.transform(F.slice(entries, i, BLOCK), lambda e: F.struct(e["k"], e["pid"]))).alias("map")))

    return let(let(cleaned(raw), ends), lambda entries: F.struct(entries.alias("entries"), index(entries).alias("index")))


def _lookup(reg: Column, name: Column) -> Column:
    """Trimmed-name lookup in a registry's index; blank or unknown -> NULL."""
    return F.when(_nonempty(name), let(strip(name), lambda n: F.try_element_at(
        F.try_element_at(F.filter(reg, lambda b: b["first"] <= n), F.lit(-1))["map"], n)))


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def _numbered(docs: DataFrame) -> DataFrame:
    """``copy_no``: 1 for the first file of a match id, more for others; 1 where files have no names.

    Only (id, name) pairs of ids with several files are counted and joined back, a set that is empty in a sound load.
    """
    if "file_name" not in docs.columns:
        return docs.withColumn("copy_no", F.lit(1))
    firsts = (docs.groupBy("match_id").agg(F.min("file_name").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .filter("_n > 1 AND match_id IS NOT NULL").select("match_id", "_first"))
    return (docs.join(firsts, "match_id", "left")
            .withColumn("copy_no", F.when(F.col("_first") < F.col("file_name"), 2).otherwise(1)).drop("_first"))


def prepare(docs: DataFrame) -> DataFrame:
    """Add the per-document registry map and the file-level reject reason."""
    # One row per further file of an id; documents themselves are not shuffled.
    d = _numbered(docs).withColumn("registry", _registry())
    info = F.col("info")
    umpires = info["officials"]["umpires"]
    teams = info["teams"]
    pom = info["player_of_match"]
    dates = info["dates"]
    lists = F.coalesce(F.map_values(info["players"]), F.array().cast("array<array<string>>"))
    corrupt = F.col("_corrupt_record") if "_corrupt_record" in docs.columns else F.lit(None).cast("string")
    # File-level rejection, first failing rule wins.
    reason = (F.when(corrupt.isNotNull(), "unreadable document")
              .when(F.col("match_id").isNull(), "file name without numeric match id")
              .when(F.coalesce(F.size(info["registry"]["people"]), F.lit(0)) <= 0, "missing player registry")
              .when(pom.isNotNull() & (F.size(pom) < 1), "empty player_of_match list")
              .when(dates.isNotNull() & (F.size(dates) < 1), "empty dates list")
              .when(dates.isNotNull() & _first(dates).isNull(), "NULL match_date")
              .when(teams.isNotNull() & (F.size(teams) < 2), "fewer than two teams")
              .when(teams.isNotNull() & (_first(teams).isNull() | F.try_element_at(teams, F.lit(2)).isNull()),
                    "NULL team")
              .when(umpires.isNotNull() & (F.size(umpires) < 2), "fewer than two umpires")
              .when(F.exists(lists, lambda names: names.isNull()), "NULL playing XI")
              .when(F.exists(lists, lambda names: F.exists(names, lambda n: n.isNull())), "NULL name in playing XI")
              # The primary key of matches lets the first file of an id in, by file name.
              .when(F.col("copy_no") > 1, "duplicate match id"))
    return d.withColumn("reject_reason", reason)




def _all_deliveries(reg: Column) -> Column:
    """One struct per delivery in load order, names as given and looked up, and whether it is kept."""
    teams = F.col("info.teams")

    def legal(x):
        return (F.coalesce(x["extras"]["wides"], F.lit(0)) == 0) & (F.coalesce(x["extras"]["noballs"], F.lit(0)) == 0)

    def per_delivery(inn, i, ov, dl, k):
        wk = _first(dl["wickets"])
        batting = inn["team"]
        bowling = (F.when((F.size(teams) > 1) & (_first(teams) == batting), F.try_element_at(teams, F.lit(2)))
                   .when(F.coalesce(F.size(teams), F.lit(0)) > 0, _first(teams))
                   .otherwise(F.lit("Unknown")))
        return F.struct(
            (i + 1 + F.when(F.coalesce(inn["super_over"], F.lit(False)), 2).otherwise(0)).alias("inning"),
            ov["over"].alias("over_number"),
            # Legal balls so far in this over array element, inclusive; counted
            # before the unresolved-player rule drops anything.
            F.size(F.filter(F.slice(ov["deliveries"], 1, k + 1), legal)).alias("ball_number"),
            (k + 1).alias("seq"),
            batting.alias("batting_team"),
            bowling.alias("bowling_team"),
            dl["batter"].alias("batter"), dl["non_striker"].alias("non_striker"), dl["bowler"].alias("bowler"),
            F.coalesce(dl["runs"]["batter"], F.lit(0)).alias("runs_scored"),
            F.coalesce(dl["runs"]["extras"], F.lit(0)).alias("extra_runs"),
            F.coalesce(dl["extras"]["wides"], F.lit(0)).alias("wides"),
            F.coalesce(dl["extras"]["noballs"], F.lit(0)).alias("noballs"),
            F.coalesce(dl["extras"]["byes"], F.lit(0)).alias("byes"),
            F.coalesce(dl["extras"]["legbyes"], F.lit(0)).alias("legbyes"),
            wk["kind"].alias("wicket_type"),
            wk["player_out"].alias("player_out"),
            _lookup(reg, dl["batter"]).alias("striker_id"),
            _lookup(reg, dl["non_striker"]).alias("non_striker_id"),
            _lookup(reg, dl["bowler"]).alias("bowler_id"),
            _lookup(reg, wk["player_out"]).alias("player_out_id"),
            F.filter(F.transform(F.coalesce(wk["fielders"], F.array()), lambda f: f["name"]),
                     lambda n: _nonempty(n)).alias("fielder_names"),
        )

    return F.flatten(F.transform(
        F.coalesce(F.col("innings"), F.array()),
        lambda inn, i: F.flatten(F.transform(
            F.coalesce(inn["overs"], F.array()),
            lambda ov: F.transform(F.coalesce(ov["deliveries"], F.array()),
                                   lambda dl, k: per_delivery(inn, i, ov, dl, k))))))


def _fielder_ids(reg: Column, x: Column) -> Column:
    return F.filter(F.transform(x["fielder_names"], lambda n: _lookup(reg, n)), lambda v: v.isNotNull())


def _is_kept(x: Column) -> Column:
    """P12 + C3: all three players resolved, NOT NULL columns present."""
    return (x["striker_id"].isNotNull() & x["non_striker_id"].isNotNull() & x["bowler_id"].isNotNull()
            & x["batting_team"].isNotNull() & x["over_number"].isNotNull())


#: Columns of a delivery as loaded, after its ids.
DELIVERY_COLUMNS = ["inning", "over_number", "ball_number", "batting_team", "bowling_team", "striker_id", "non_striker_id", "bowler_id",
                    "runs_scored", "extra_runs", "wides", "noballs", "byes", "legbyes", "wicket_type", "player_out_id"]


def _placed(kept: DataFrame) -> DataFrame:
    """Kept deliveries with their place in the match and their match's offsets."""
    spark = kept.sparkSession
    # One row a match, written: offsets ask for them several times.
    path = f"{checkpoint_dir(spark).rstrip('/')}/matches-{uuid.uuid4().hex}"
    counted = kept.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n_del"), F.sum(F.size("fielder_ids")).cast("long").alias("n_fld"), (F.min("doc") < F.max("doc")).alias("several"))
    counted.write.parquet(path)
    per_match = spark.read.schema(counted.schema).parquet(path)
    # Dense ids in load order (match asc, inning, over, ball).
    offsets = exclusive_prefix_sums(per_match, "match_id", ["n_del", "n_fld"])
    if per_match.count() <= BROADCAST_MATCHES:
        offsets = F.broadcast(offsets)
    # Documents know their deliveries' places; only those of a match with several documents are dealt out and counted through.
    several = F.broadcast(per_match.filter("several").select("match_id"))
    together = kept.join(several, "match_id", "left_semi").withColumn("mpos", F.row_number().over(Window.partitionBy("match_id").orderBy("pos")))
    return kept.join(several, "match_id", "left_anti").unionByName(together).drop("doc").join(offsets, "match_id")


def _deliveries(placed: DataFrame) -> DataFrame:
    return placed.select((F.col("del_offset") + F.col("mpos")).alias("delivery_id"), "match_id", *DELIVERY_COLUMNS)


def _fielder_dismissals(placed: DataFrame) -> DataFrame:
    """Fielders of the first wicket, numbered across the match in load order."""
    fl = placed.select("match_id", "fld_offset", "pos", (F.col("del_offset") + F.col("mpos")).alias("delivery_id"),
                       F.posexplode("fielder_ids").alias("fpos", "fielder_id"))
    return fl.select((F.col("fld_offset") + F.row_number().over(Window.partitionBy("match_id").orderBy("pos", "fpos"))).alias("fielder_dismissal_id"),
                     "delivery_id", "fielder_id")


def ingest(docs: DataFrame, excluded: DataFrame | None = None) -> IngestResult:
    """Plan the whole load; nothing runs before an output is used. ``excluded`` lists files skipped before parsing (S3).

    Each output reads the document scan with the columns it needs: matches, players and file rejects
    never touch deliveries. Deliveries and dismissals share rows resolved in one pass and written to the shared folder when
    either is first used. To produce all outputs from one pass over costly documents, write
    the documents once and give the table read back.
    """
    p = prepare(docs)
    ok = p.filter(F.col("reject_reason").isNull())
    reg = F.col("reg")
    ok = ok.withColumn("reg", F.col("registry.index"))

    # --- deliveries: names resolved against the document's registry, then exploded.
    def kept() -> DataFrame:
        # Ids need the counts of all matches first: deliveries are resolved once, in one pass over the documents, and written.
        path = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/deliveries-{uuid.uuid4().hex}"

        def of(reg: Column) -> Column:
            numbered = F.transform(_all_deliveries(reg), lambda x, i: F.struct(
                i.alias("pos"), *[x[c].alias(c) for c in DELIVERY_COLUMNS], _fielder_ids(reg, x).alias("fielder_ids")))
            return F.filter(numbered, _is_kept)

        # Documents are numbered before their deliveries are exploded, in a step of its own.
        found = ok.withColumn("doc", F.monotonically_increasing_id()).select("match_id", "doc", F.posexplode(let(reg, of)).alias("mpos", "x")).select(
            "match_id", "doc", (F.col("mpos") + 1).alias("mpos"), "x.*")
        found.write.parquet(path)
        return docs.sparkSession.read.schema(found.schema).parquet(path)

    # --- matches.
    info = F.col("info")
    outcome = info["outcome"]
    by = outcome["by"]
    has_by = F.coalesce(F.size(by), F.lit(0)) > 0
    matches = ok.select(
        F.col("match_id"),
        F.coalesce(info["season"], F.lit("Unknown")).alias("season"),
        F.when(info["dates"].isNull(), F.lit("")).otherwise(_first(info["dates"])).alias("match_date"),
        F.coalesce(info["venue"], F.lit("Unknown")).alias("venue"),
        info["city"].alias("city"),
        F.coalesce(info["event"]["stage"], F.lit("Group")).alias("stage"),
        F.when(info["teams"].isNull(), F.lit("")).otherwise(_first(info["teams"])).alias("team1"),
        F.when(info["teams"].isNull(), F.lit("")).otherwise(F.try_element_at(info["teams"], F.lit(2))).alias("team2"),
        F.coalesce(info["toss"]["winner"], F.lit("Unknown")).alias("toss_winner"),
        F.coalesce(info["toss"]["decision"], F.lit("Unknown")).alias("toss_decision"),
        outcome["winner"].alias("match_winner"),
        F.when(has_by, _first(F.map_keys(by)))
         .otherwise(F.coalesce(outcome["result"], F.lit("no result"))).alias("result_type"),
        F.when(has_by, _first(F.map_values(by))).alias("result_margin"),
        _lookup(reg, _first(info["player_of_match"])).alias("player_of_match_id"),
        _first(info["officials"]["umpires"]).alias("umpire1"),
        F.try_element_at(info["officials"]["umpires"], F.lit(2)).alias("umpire2"),
    )

    # --- PlayerInMatch (P6, P19): XI entries in document order, first (match, player) wins.
    xi = F.flatten(F.transform(
        F.map_entries(F.coalesce(info["players"], F.create_map().cast("map<string,array<string>>"))),
        lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<string>")),
                              lambda n: F.struct(e["key"].alias("team"), n.alias("name")))))
    listed = let(reg, lambda reg: F.transform(xi, lambda x: F.struct(x["team"], x["name"], _lookup(reg, x["name"]).alias("player_id"))))
    player_in_match = (ok.select("match_id", F.posexplode(listed).alias("xpos", "x")).filter("x.player_id IS NOT NULL")
                       .groupBy("match_id", F.col("x.player_id").alias("player_id"))
                       .agg(F.min_by("x.team", "xpos").alias("team_name")))

    # --- Players (P19): first match (lowest id), then registry position, wins per id.
    players = (ok.select("match_id", F.explode("registry.entries").alias("e"))
               .groupBy(F.col("e.pid").alias("player_id"))
               .agg(F.min_by(F.col("e.k"), F.struct("match_id", F.col("e.pos"))).alias("player_name")))

    # --- rejects and load summary.
    rejected_files = p.filter(F.col("reject_reason").isNotNull()).select("match_id", "reject_reason")
    # All kinds of a document in one pass over it.
    rejected_rows = ok.select("match_id", F.inline(F.concat(let(reg, _row_rejects), F.transform(
        F.filter(listed, lambda x: _nonempty(strip(x["name"])) & x["player_id"].isNull()),
        lambda x: _reject(F.lit(None), F.lit(None), F.lit(None), F.lit("XI player not in registry"), x["name"])))))
    files = p.select(F.col("reject_reason").isNull().alias("loaded"))
    summary = files.agg(F.count(F.lit(1)).alias("documents"),
                        F.count_if("loaded").alias("processed"),
                        F.count_if(~F.col("loaded")).alias("rejected"))
    n_excl = (excluded.agg(F.count(F.lit(1)).alias("excluded")) if excluded is not None
              else files.sparkSession.range(1).select(F.lit(0).cast("long").alias("excluded")))
    summary = summary.withColumn("excluded", n_excl.scalar()).select(
        (F.col("documents") + F.col("excluded")).alias("total_files"), "processed",
        (F.col("rejected") + F.col("excluded")).alias("skipped"), "rejected", "excluded")
    return IngestResult(players, matches, kept, player_in_match, rejected_files, rejected_rows, summary)


def _reject(inning: Column, over: Column, seq: Column, reason: Column, detail: Column) -> Column:
    return F.struct(inning.cast("int").alias("inning"), over.cast("int").alias("over_number"), seq.cast("int").alias("seq"),
                    reason.alias("reason"), detail.alias("detail"))


def _row_rejects(reg: Column) -> Column:
    """Warnings of a loaded document's deliveries (dropped ones, failed lookups)."""
    def miss(x, label, name, pid):
        return F.when(_nonempty(x[name]) & x[pid].isNull(), F.concat(F.lit(label + ":'"), x[name], F.lit("'")))

    def of(x: Column) -> Column:
        told = lambda reason, detail: _reject(x["inning"], x["over_number"], x["seq"], reason, detail)
        unresolved = x["striker_id"].isNull() | x["non_striker_id"].isNull() | x["bowler_id"].isNull()
        dropped = told(F.when(unresolved, "delivery skipped: unresolved player").otherwise("delivery skipped: NOT NULL violation"),
                       F.concat_ws(", ", miss(x, "Striker", "batter", "striker_id"), miss(x, "NonStriker", "non_striker", "non_striker_id"),
                                   miss(x, "Bowler", "bowler", "bowler_id")))
        out_failed = F.when(_nonempty(x["player_out"]) & x["player_out_id"].isNull(), told(F.lit("player_out lookup failed"), x["player_out"]))
        fielder_failed = F.when(F.size(x["fielder_names"]) != F.size(_fielder_ids(reg, x)),
                                told(F.lit("fielder lookup failed"), F.array_join(x["fielder_names"], ", ")))
        return F.when(_is_kept(x), F.array(out_failed, fielder_failed)).otherwise(F.array(dropped))

    return F.filter(F.flatten(F.transform(_all_deliveries(reg), of)), lambda r: r.isNotNull())
