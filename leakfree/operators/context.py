"""Availability and situation context for every entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import round_even, translate
from ..functions.names import word_key
from .ranking import room_leader
from .reports import INACTIVE_STATUS, LIVE_SEVERE
from .reshape import team_rows
from .rollups import last_home_value, pass_rate

# Designations that cost a game, and the ones that pass within days.
MISSED = ("Out", "Doubtful")
TRANSIENT = ("Illness",)
NOT_AN_INJURY = "not injury related"
# The starting line and how many of it must be down to matter.
LINE_POSITIONS = ("LT", "LG", "C", "RG", "RT")
LINE_THRESHOLD = 2

AVAILABILITY = ("weeks_out", "last_injury", "last_week", "last_round", "ended_hurt", "status",
                "live_code", "live_body", "live_note", "news_date")


def team_finish(games: DataFrame) -> DataFrame:
    """Each team's last played week per season, from the schedule."""
    played = games.where(F.col("home_score").isNotNull())
    return team_rows(played, {"team": "home_team"}, {"team": "away_team"}, ["season", "week"]).groupBy("season", "team").agg(
        F.max("week").alias("finish"))


def report_finish(reports: DataFrame) -> DataFrame:
    """Fallback finish: the last week anyone on the team filed a report."""
    return reports.groupBy("season", "team").agg(F.max("week").alias("finish"))


def injury_seasons(reports: DataFrame, finish: DataFrame) -> DataFrame:
    """How each season ended per entity: weeks missed, last injury and round, and whether it ended hurt.

    A season ends hurt when the last missed week is within two weeks of the team's own finish and
    the cause is not one that passes in days.
    """
    body = F.lower(F.coalesce("report_primary_injury", F.lit("")))
    hurt = reports.where(
        F.col("player_id").isNotNull() & F.col("week").isNotNull()
        & F.col("report_status").isin(*MISSED) & ~body.contains(NOT_AN_INJURY))
    last = F.max_by(F.struct("team", "week", "game_type", "report_primary_injury"),
                    F.struct("week", "report_primary_injury", "game_type", "team"))
    g = hurt.groupBy("player_id", "season").agg(last.alias("__l"), F.countDistinct("week").alias("weeks_out")).select(
        "player_id", "season", "weeks_out", F.col("__l.report_primary_injury").alias("last_injury"),
        F.col("__l.week").alias("last_week"), F.col("__l.game_type").alias("last_round"), F.col("__l.team").alias("team"))
    longest = finish.groupBy("season").agg(F.max("finish").alias("__season_finish"))
    j = g.join(finish, ["season", "team"], "left").join(longest, "season", "left")
    at_end = F.col("last_week") >= F.coalesce("finish", "__season_finish") - 1
    lasting = ~F.coalesce(F.col("last_injury").isin(*TRANSIENT), F.lit(False))
    return j.select("player_id", "season", "weeks_out", "last_injury", "last_week", "last_round",
                    F.coalesce(at_end & lasting, F.lit(False)).alias("ended_hurt"))


def roster_status(rosters: DataFrame, season: Column | int) -> DataFrame:
    """Wording of the latest roster code of entities that are not available."""
    season = F.lit(season) if isinstance(season, int) else season
    now = rosters.where((F.col("season") == season) & F.col("player_id").isNotNull())
    latest = now.groupBy("player_id").agg(
        F.min_by("status", F.struct(-F.col("week"), F.col("status"))).alias("status"))
    return latest.where(F.col("status").isin(*INACTIVE_STATUS)).withColumn(
        "status", translate("status", INACTIVE_STATUS))


def availability(injuries: DataFrame, status: DataFrame, live: DataFrame) -> DataFrame:
    """One row per entity known to any of the three sources; ``ended_hurt`` is never null."""
    out = injuries.join(status, "player_id", "full_outer").join(live, "player_id", "full_outer")
    have = set(out.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in AVAILABILITY]
    return out.select("player_id", *cols).withColumn("ended_hurt", F.coalesce("ended_hurt", F.lit(False)))


def line_starters(depth: DataFrame) -> DataFrame:
    """Projected starters of the line per team, from either format of the chart."""
    old = F.lit(False)
    if {"depth_team", "depth_position"} <= set(depth.columns):
        old = (F.col("depth_team") == "1") & F.col("depth_position").isin(*LINE_POSITIONS)
    new = F.lit(False)
    if {"pos_rank", "pos_abb"} <= set(depth.columns):
        new = (F.col("pos_rank") == 1) & F.col("pos_abb").isin(*LINE_POSITIONS)
    team = F.coalesce(*[F.col(c) for c in ("team", "club_code") if c in depth.columns])
    wanted = F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))
    return depth.where(F.col("player_id").isNotNull() & wanted).select(team.alias("team"), "player_id").distinct()


def line_context(starters: DataFrame, avail: DataFrame, names: DataFrame, threshold: int = LINE_THRESHOLD) -> DataFrame:
    """Teams with at least ``threshold`` starters of the line down, and who they are.

    A line has a handful of starters, so the collected names are few.
    """
    down = F.col("ended_hurt") | F.col("status").isNotNull() | F.coalesce(F.col("live_code").isin(*LIVE_SEVERE), F.lit(False))
    hit = starters.join(avail.where(down).select("player_id"), "player_id").join(names, "player_id", "left")
    return hit.groupBy("team").agg(
        F.count("*").alias("ol_out"), F.array_join(F.array_sort(F.collect_list("full_name")), ", ").alias("ol_names"),
    ).where(F.col("ol_out") >= threshold)


def player_context(agg: DataFrame, team: DataFrame, adp: DataFrame, depth: DataFrame, weekly: DataFrame, games: DataFrame,
                   avail: DataFrame, line: DataFrame, target_season: int, ranked: DataFrame | None = None) -> DataFrame:
    """Situation of every entity on a roster of the target season.

    Who leads its room (market rank, then score, then name), what production left the room, whether
    it moved, its chart place, the team's pass rate, a new coach, its availability and its line.
    """
    prior = target_season - 1
    last = agg.where(F.col("season") == prior).select("player_id", "player", "position", "fp")
    then = team.where(F.col("season") == prior).select("player_id", F.col("team").alias("prior_team"))
    now = team.where(F.col("season") == target_season).select("player_id", "team")
    src = (last.withColumnRenamed("fp", "score") if ranked is None
           else ranked.select("player_id", "player", "position", F.col("proj").alias("score")))
    best_adp = adp.select(word_key("player").alias("__k"), F.col("adp").try_cast("double").alias("adp")).groupBy("__k").agg(F.min("adp").alias("adp"))
    room = now.join(src, "player_id").where(F.col("position").isNotNull()).withColumn(
        "score", F.coalesce("score", F.lit(0.0))).withColumn("__k", word_key("player")).join(best_adp, "__k", "left").drop("__k")
    top = room_leader(room)
    leads = F.coalesce("player", F.lit("")) == F.coalesce("top_player", F.lit(""))
    room = room.join(top, ["team", "position"], "left").withColumns({
        "blocked_by": F.when(~leads, F.col("top_player")),
        "blocked_by_fp": round_even(F.when(leads, 0.0).otherwise(F.col("top_score")), 1)})
    gone = last.join(then, "player_id").join(now, "player_id", "left").where(~F.col("prior_team").eqNullSafe(F.col("team")))
    vacated = gone.groupBy(F.col("prior_team").alias("team"), "position").agg(F.sum("fp").alias("vacated_fp"))
    coach = last_home_value(games.where(F.col("season").isin(prior, target_season)), "home_coach", "coach")
    new_coach = coach.groupBy("team").agg(
        F.max(F.when(F.col("season") == target_season, F.col("coach"))).alias("__now"),
        F.max(F.when(F.col("season") == prior, F.col("coach"))).alias("__prev"),
    ).select("team", (F.col("__now") != F.col("__prev")).alias("new_coach"))
    out = (
        room.join(vacated, ["team", "position"], "left").join(then, "player_id", "left")
        .join(depth, "player_id", "left")
        .join(pass_rate(weekly.where(F.col("season") == prior)).drop("season"), "team", "left")
        .join(new_coach, "team", "left").join(avail, "player_id", "left").join(line, "team", "left")
    )
    rb = F.col("position") == "RB"
    return out.select(
        "player_id", "team", "prior_team",
        F.coalesce(F.col("prior_team") != F.col("team"), F.lit(False)).alias("moved"),
        "blocked_by", "blocked_by_fp", round_even(F.coalesce("vacated_fp", F.lit(0.0)), 1).alias("vacated_fp"),
        "depth_rank", "pass_rate", F.coalesce("new_coach", F.lit(False)).alias("new_coach"),
        *[c for c in AVAILABILITY if c != "ended_hurt"], F.coalesce("ended_hurt", F.lit(False)).alias("ended_hurt"),
        F.coalesce(F.when(rb, F.col("ol_out")), F.lit(0)).alias("ol_out"), F.when(rb, F.col("ol_names")).alias("ol_names"),
    )
