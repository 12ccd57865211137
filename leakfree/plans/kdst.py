"""Kickers and team defences: scored rows, trailing projections, last-season values, actual outcomes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import defence_name
from ..functions.scoring import PPR, defence_points, kicker_points, with_points
from ..operators.joins import last_known
from ..operators.reshape import team_rows
from ..operators.rollups import SKILL_POSITIONS
from ..operators.trailing import form_before

FORM_WINDOW = 5


def kicker_rows(weekly: DataFrame, rules: Mapping = PPR) -> DataFrame:
    k = weekly.where(F.col("position") == "K")
    return k.withColumn("fp", kicker_points(k, rules))


def defence_rows(games: DataFrame, rules: Mapping = PPR) -> DataFrame:
    """One scored row per team and played game; points allowed is the only stat the schedule has."""
    played = games.where(F.col("home_score").isNotNull() & F.col("week").isNotNull())
    rows = team_rows(
        played, {"team": "home_team", "points_allowed": "away_score"}, {"team": "away_team", "points_allowed": "home_score"},
        ["game_id", "season", "week"]).withColumn("position", F.lit("DEF"))
    return rows.withColumn("fp", defence_points(rows, rules))


def project_kdst(weekly: DataFrame, games: DataFrame, season: int, week: int, rules: Mapping = PPR, window: int = FORM_WINDOW) -> DataFrame:
    """Trailing means of active kickers and defences entering a period, with the kicker's last team."""
    cut = season * 100 + week
    kick = kicker_rows(weekly, rules)
    form = form_before(kick, "player_display_name", cut, window, active_since=season - 1)
    team = last_known(kick, "player_display_name", ["recent_team"], cut, tiebreak=["recent_team"])
    k = form.join(team, "player_display_name", "left").select(
        "player_display_name", F.lit("K").alias("position"), "pred", F.coalesce(F.col("recent_team").cast("string"), F.lit("")).alias("recent_team"))
    dst = form_before(defence_rows(games, rules), "team", cut, window, active_since=season - 1, tiebreak=["game_id"])
    name = defence_name(F.col("team").cast("string"), F.lit("DEF"))
    d = dst.select(name.alias("player_display_name"), F.lit("DEF").alias("position"), "pred", F.col("team").cast("string").alias("recent_team"))
    return k.unionByName(d)


def preseason_values(weekly: DataFrame, games: DataFrame, season: int, rules: Mapping = PPR) -> DataFrame:
    """Kickers and defences valued by last season's total, best first within the position."""
    k = kicker_rows(weekly.where(F.col("season") == season - 1), rules).select(F.col("player_display_name").alias("player"), "position", "fp")
    d = defence_rows(games.where(F.col("season") == season - 1), rules).select(
        defence_name(F.col("team").cast("string"), F.col("position")).alias("player"), "position", "fp")
    total = k.unionByName(d).groupBy("player", "position").agg(F.sum("fp").alias("proj"))
    return total.orderBy("position", F.col("proj").desc(), "player")


def naive_board(agg: DataFrame, season: int) -> DataFrame:
    """Last season's totals as the board to beat."""
    return agg.where(F.col("season") == season - 1).select("player_id", "player", "position", F.col("fp").alias("proj"))


def actual_outcomes(weekly: DataFrame, games: DataFrame, season: int | None = None, rules: Mapping = PPR) -> DataFrame:
    """What everybody really scored per period: skill players, kickers and defences."""
    w = weekly.where(F.col("season_type") == "REG")
    g = games
    if season is not None:
        w, g = w.where(F.col("season") == season), g.where(F.col("season") == season)
    skill = with_points(w.where(F.col("position").isin(*SKILL_POSITIONS)), rules)
    cols = [F.col("player_display_name").alias("player"), "position", "season", "week", "fp"]
    dst = defence_rows(g, rules).select(defence_name(F.col("team").cast("string"), F.col("position")).alias("player"), "position", "season", "week", "fp")
    return skill.select(*cols).unionByName(kicker_rows(w, rules).select(*cols)).unionByName(dst)
