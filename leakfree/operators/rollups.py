"""Aggregations over weekly rows, plays, rosters and schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, round_even, safe_ratio
from ..session import stored
from .joins import strictly_prior
from .reshape import opponents, team_rows

SKILL_POSITIONS = ("QB", "RB", "WR", "TE")

DECAY = 0.6
# Output name and weekly column of each summed stat of the season rollup.
SEASON_SUMS = (
    ("targets", "targets"), ("carries", "carries"), ("receptions", "receptions"),
    ("rec_yds", "receiving_yards"), ("rush_yds", "rushing_yards"), ("pass_yds", "passing_yards"),
    ("pass_tds", "passing_tds"), ("rush_tds", "rushing_tds"), ("rec_tds", "receiving_tds"),
)


def season_rollup(scored: DataFrame) -> DataFrame:
    """Entity-season totals; descriptive columns come from the first period of the season."""
    def first(c: str, name: str) -> Column:
        return F.min_by(c, F.struct("week", c)).alias(name)

    return scored.groupBy("player_id", "season").agg(
        first("position", "position"), first("player_display_name", "player"),
        F.count("*").alias("games"), F.sum("fp").alias("fp"),
        *[F.sum(c).alias(name) for name, c in SEASON_SUMS], F.avg("target_share").alias("tgt_share"))


def points_allowed(scored: DataFrame, period: Sequence[str] = ("season",), value: str = "fp") -> DataFrame:
    """What each opponent allowed to each position per season, or per season and week."""
    return scored.groupBy("opponent_team", "position", *period).agg(F.sum(value).alias("allowed"))


def relative_to_league(df: DataFrame, value: str, group: Sequence[str], out: str, floor: float = 1.0) -> DataFrame:
    """Value over the mean of its group, the mean floored.

    The group means are a small table joined back, so a large group is only ever aggregated.
    """
    means = stored(df.groupBy(*group).agg(F.avg(value).alias("__lg")))
    return df.join(means, list(group)).withColumn(
        out, F.col(value) / F.greatest(F.col("__lg"), F.lit(floor))).drop("__lg")


def modal_value(counts: DataFrame, entity: Sequence[str], value: str, n: str) -> DataFrame:
    """The most frequent value per entity; ties go to the smallest value."""
    return counts.where(F.col(value).isNotNull()).groupBy(*entity).agg(
        F.min_by(value, F.struct(-F.col(n), F.col(value))).alias(value))


def last_home_value(games: DataFrame, value: str, out: str) -> DataFrame:
    """Value at each team's last regular home game of a season."""
    rows = games.where((F.col("game_type") == "REG") & F.col(value).isNotNull())
    return rows.groupBy("season", F.col("home_team").alias("team")).agg(
        F.max_by(value, F.struct("week", "game_id")).alias(out))


def redzone_counts(plays: DataFrame) -> DataFrame:
    """Opportunities near the goal per player and period; roles a player never had stay null.

    The three role columns become rows of one scan instead of three scans and joins.
    """
    roles = F.array(
        F.struct(F.lit("rec").alias("role"), F.when(F.col("play_type") == "pass", F.col("receiver_player_id")).alias("player_id")),
        F.struct(F.lit("rush").alias("role"), F.when(F.col("play_type") == "run", F.col("rusher_player_id")).alias("player_id")),
        F.struct(F.lit("pass").alias("role"), F.when(F.col("play_type") == "pass", F.col("passer_player_id")).alias("player_id")),
    )
    long = plays.select("season", "week", "yardline_100", F.inline(roles)).where(F.col("player_id").isNotNull())

    def near(role: str, yards: int) -> Column:
        return F.sum(F.when(F.col("role") == role, (F.col("yardline_100") <= yards).cast("int")))

    return long.groupBy("player_id", "season", "week").agg(
        near("rec", 20).alias("rz_targets"), near("rec", 10).alias("i10_targets"),
        near("rush", 20).alias("rz_carries"), near("rush", 10).alias("i10_carries"),
        near("pass", 20).alias("rz_pass_att"))


def defence_quality(plays: DataFrame) -> DataFrame:
    """Efficiency allowed and pressure made per defence and period."""
    return plays.where(F.col("defteam").isNotNull()).groupBy(F.col("defteam").alias("opponent_team"), "season", "week").agg(
        F.avg(F.when(F.col("pass") == 1, F.col("epa"))).alias("def_pass_epa"),
        F.avg(F.when(F.col("rush") == 1, F.col("epa"))).alias("def_rush_epa"),
        safe_ratio((F.sum("sack") + F.sum("qb_hit")) * 1.0, F.sum(F.when(F.col("pass") == 1, 1).otherwise(0))).alias("def_pressure"))


def regular_skill(weekly: DataFrame) -> DataFrame:
    """The rows the season operators are about: regular season, skill positions."""
    return weekly.where((F.col("season_type") == "REG") & F.col("position").isin(*SKILL_POSITIONS))


def player_volume(weekly: DataFrame) -> DataFrame:
    """Opportunity volume per entity and regular season, counted the way its (skill) position earns it."""
    sums = regular_skill(weekly).groupBy("player_id", "season", "position").agg(
        *[F.sum(F.coalesce(c, F.lit(0.0))).alias(f"__{c}") for c in ("carries", "targets", "attempts")])
    vol = (F.when(F.col("position") == "RB", F.col("__carries") + F.col("__targets"))
           .when(F.col("position").isin("WR", "TE"), F.col("__targets")).otherwise(F.col("__attempts")))
    return sums.select("player_id", "season", "position", vol.alias("vol"))


def room_shares(volume: DataFrame, team: DataFrame) -> DataFrame:
    """The opportunity each entity walks into in the following season.

    Only last season's volume and the coming season's roster are used: the share of the volume
    returning to the room, the share of the old room that left, and the volume of the others.
    """
    now = team.select("player_id", (F.col("season") - 1).alias("season"), "team")
    then = team.select("player_id", "season", F.col("team").alias("pteam"))
    known = team.select((F.col("season") - 1).alias("season")).distinct()
    d = volume.join(known, "season", "left_semi").join(now, ["player_id", "season"], "left").join(
        then, ["player_id", "season"], "left")
    room_key = ["season", "team", "position"]
    room = d.where(F.col("team").isNotNull()).groupBy(*room_key).agg(F.sum("vol").alias("room_vol"))
    left = F.col("pteam").isNotNull() & ~F.col("pteam").eqNullSafe(F.col("team"))
    old = d.where(F.col("pteam").isNotNull()).groupBy("season", F.col("pteam").alias("team"), "position").agg(
        F.sum(F.when(left, F.col("vol")).otherwise(0.0)).alias("vac_vol"), F.sum("vol").alias("pt_total"))
    j = d.join(room, room_key, "left").join(old, room_key, "left")
    return j.select(
        "player_id", (F.col("season") + 1).alias("tseason"),
        (F.col("vol") / clip("room_vol", low=1.0)).alias("opp_share"),
        (F.coalesce("vac_vol", F.lit(0.0)) / clip("pt_total", low=1.0)).alias("vac_share"),
        clip(F.col("room_vol") - F.col("vol"), low=0.0).alias("comp_vol"))


def room_turnover(agg: DataFrame, team: DataFrame, target_season: int) -> DataFrame:
    """Per (team, position): production that left, that returns, and the best returning entity."""
    prior = agg.where(F.col("season") == target_season - 1).select("player_id", "position", "player", "fp").join(
        team.where(F.col("season") == target_season - 1).select("player_id", "team"), "player_id")
    now = team.where(F.col("season") == target_season).select("player_id", F.col("team").alias("team_now"))
    stays = F.coalesce(F.col("team_now") == F.col("team"), F.lit(False))
    order = F.struct(-F.col("fp"), F.col("player_id"))
    return prior.join(now, "player_id", "left").groupBy("team", "position").agg(
        F.sum(F.when(stays, 0.0).otherwise(F.col("fp"))).alias("vacated_fp"),
        F.sum(F.when(stays, F.col("fp")).otherwise(0.0)).alias("returning_fp"),
        F.min_by(F.when(stays, F.struct("player", "fp")), F.when(stays, order)).alias("__b"),
    ).select("team", "position", "vacated_fp", "returning_fp",
             F.col("__b.player").alias("blocked_by"), F.coalesce(F.col("__b.fp"), F.lit(0.0)).alias("blocked_by_fp"))


def pass_rate(weekly: DataFrame) -> DataFrame:
    """Pass share of offensive plays per team and regular season."""
    p, r = F.sum(F.coalesce("attempts", F.lit(0.0))), F.sum(F.coalesce("carries", F.lit(0.0)))
    return weekly.where(F.col("season_type") == "REG").groupBy("season", F.col("recent_team").alias("team")).agg(round_even(safe_ratio(p, p + r), 3).alias("pass_rate"))


def schedule_faced(scored: DataFrame) -> DataFrame:
    """Mean difficulty of the opponents met, and production divided by it."""
    keys = ["season", "position", "opponent_team"]
    difficulty = relative_to_league(points_allowed(scored), "allowed", ["season", "position"], "difficulty").select(*keys, "difficulty")
    g = scored.join(difficulty, keys, "left").groupBy("player_id", "season").agg(
        F.coalesce(F.avg("difficulty"), F.lit(1.0)).alias("sched_faced"), F.sum("fp").alias("__fp"))
    return g.select("player_id", "season", "sched_faced",
                    round_even(F.col("__fp") / F.greatest(F.col("sched_faced"), F.lit(0.3)), 1).alias("p_fp_adj"))


def defence_difficulty(scored: DataFrame, targets: DataFrame, decay: float = DECAY) -> DataFrame:
    """Ease of scoring on each defence entering a season, from strictly earlier seasons (1 = league mean)."""
    rel = relative_to_league(points_allowed(scored), "allowed", ["season", "position"], "diff").select(
        F.col("opponent_team").alias("def_team"), "position", "season", "diff")
    return strictly_prior(rel, ["def_team", "position"], "diff", targets, 1.0, "d_diff", decay)


def forward_schedule(games: DataFrame, difficulty: DataFrame) -> DataFrame:
    """Mean prior-form difficulty of the scheduled opponents per team, season and position."""
    met = opponents(games.where(F.col("game_type") == "REG"), ["season"]).join(
        difficulty.withColumnRenamed("def_team", "opp"), ["season", "opp"])
    return met.groupBy("team", "season", "position").agg(F.avg("d_diff").alias("sched_ahead"))


def opponent_quality(games: DataFrame, targets: DataFrame, schedule: DataFrame | None = None, decay: float = DECAY) -> DataFrame:
    """Mean prior quality (point differential) of the scheduled opponents per team and season."""
    played = games.where((F.col("game_type") == "REG") & F.col("home_score").isNotNull())
    diff = F.col("home_score") - F.col("away_score")
    per_team = team_rows(played, {"team": "home_team", "diff": diff}, {"team": "away_team", "diff": -diff}, ["season"])
    form = per_team.groupBy("team", "season").agg(F.avg("diff").alias("pd"))
    quality = strictly_prior(form, ["team"], "pd", targets, 0.0, "team_q", decay)
    slate = opponents((games if schedule is None else schedule).where(F.col("game_type") == "REG"), ["season"])
    return slate.join(quality.withColumnRenamed("team", "opp"), ["season", "opp"]).groupBy("team", "season").agg(F.avg("team_q").alias("sos_q"))
