"""Season-level features and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, col, flag, one_hot, round_even
from ..operators.career import career_features
from ..operators.joins import prior_year_strength, shift_season
from ..operators.metrics import apply_calibration, error_metrics, group_spearman, ratio_calibration
from ..operators.ordered import group_quantiles
from ..operators.ranking import top_k_by_table
from ..operators.reshape import opponents
from ..operators.rollups import last_home_value, opponent_quality, player_volume, points_allowed, room_shares, schedule_faced
from ..session import once
from .projection import GradientBoosting

POSITIONS = ("QB", "RB", "WR", "TE")
# Right-open age bins of the calibration, its strength and bounds, the smallest outcome used.
AGE_EDGES = (24, 26, 28, 30)
AGE_STRENGTH, AGE_BOUNDS, AGE_MIN_ACTUAL = 0.35, (0.8, 1.25), 20
# Weight of the model, of the career rate, and the games a starter is regressed to.
MODEL_WEIGHT, CAREER_WEIGHT = 0.4, 0.5
STARTER_GAMES, STARTER_PRIOR_SEASONS = 15.5, 8.0
GAMES_BOUNDS = (8.0, 17.0)
# How many per position count as starters by market rank.
ADP_STARTERS = {"RB": 32, "WR": 40, "TE": 15, "QB": 15}
ADP_STARTERS_OTHER = 20
# Names of the prior-season stats in the feature frame.
PRIOR = {
    "games": "p_games", "fp": "p_fp", "targets": "p_targets", "carries": "p_carries", "receptions": "p_receptions",
    "rec_yds": "p_rec_yds", "rush_yds": "p_rush_yds", "pass_yds": "p_pass_yds", "pass_tds": "p_pass_tds",
    "rush_tds": "p_rush_tds", "rec_tds": "p_rec_tds", "tgt_share": "p_tgt_share",
}
CONTEXT = ("age", "years_exp", "team_changed", "coach_changed", "sos", "sos_q")
CAREER = ("c_fp_wavg", "c_ppg_wavg", "c_tgt_share_wavg", "c_games_avg", "c_games_min", "c_seasons", "c_fp_trend", "c_best_fp")
SCHEDULE = ("sched_faced", "p_fp_adj")
COMPETITION = ("opp_share", "vac_share", "comp_vol")


def age_group(position: Column | str) -> Column:
    """Positions that age alike share a calibration group."""
    p = col(position)
    return F.when(p == "RB", "RB").when(p == "QB", "QB").otherwise("WRTE")


def model_columns(career: bool = False, schedule: bool = False, competition: bool = False) -> list[str]:
    return [*PRIOR.values(), "p_ppg", *CONTEXT, *[f"is_{p}" for p in POSITIONS], *(CAREER if career else ()),
            *(SCHEDULE if schedule else ()), *(COMPETITION if competition else ())]


def feature_frame(agg: DataFrame, scored: DataFrame, games: DataFrame, team: DataFrame, births: DataFrame, targets: DataFrame,
                  career: bool = False, schedule: bool = False, competition: bool = False) -> DataFrame:
    """Last season's production and the coming season's known context, with the coming total as target.

    The target is null where the coming season was not played.
    """
    prior = agg.withColumnsRenamed(PRIOR).withColumn("p_ppg", F.col("p_fp") / F.greatest(F.col("p_games"), F.lit(1)))
    df = shift_season(prior, out="tseason")
    df = df.join(agg.select("player_id", F.col("season").alias("tseason"), F.col("fp").alias("target_fp")), ["player_id", "tseason"], "left")
    df = df.join(births.withColumnRenamed("season", "tseason"), ["player_id", "tseason"], "left")
    df = df.withColumn("age", F.col("tseason") - F.col("birth_year"))
    df = df.join(team.select("player_id", "season", F.col("team").alias("prior_team")), ["player_id", "season"], "left")
    df = df.join(team.select("player_id", F.col("season").alias("tseason"), F.col("team").alias("new_team")), ["player_id", "tseason"], "left")
    df = df.withColumn("team_changed", (~F.col("prior_team").eqNullSafe(F.col("new_team"))).cast("int"))
    coach = last_home_value(games, "home_coach", "coach")
    now = coach.select(F.col("season").alias("tseason"), F.col("team").alias("new_team"), F.col("coach").alias("__new"))
    old = coach.select((F.col("season") + 1).alias("tseason"), F.col("team").alias("new_team"), F.col("coach").alias("__old"))
    df = df.join(now, ["tseason", "new_team"], "left").join(old, ["tseason", "new_team"], "left")
    df = df.withColumn("coach_changed", flag(F.col("__old").isNotNull() & ~F.col("__new").eqNullSafe(F.col("__old")))).drop("__new", "__old")
    slate = opponents(games.where(F.col("game_type") == "REG"), ["season"])
    sos = prior_year_strength(points_allowed(scored), slate).withColumnsRenamed({"season": "tseason", "team": "new_team"})
    quality = opponent_quality(games, targets).withColumnsRenamed({"season": "tseason", "team": "new_team"})
    df = df.join(sos, ["tseason", "new_team", "position"], "left").join(quality, ["tseason", "new_team"], "left")
    median = group_quantiles(df.select("sos"), [], "sos", [0.5], ["m"]).scalar()
    df = df.withColumns({"sos": F.coalesce("sos", median), "sos_q": F.coalesce("sos_q", F.lit(0.0))})
    df = one_hot(df, "position", POSITIONS)
    if career:
        df = df.join(career_features(agg), ["player_id", "season"], "left")
    if schedule:
        df = df.join(schedule_faced(scored), ["player_id", "season"], "left").withColumns({
            "sched_faced": F.coalesce("sched_faced", F.lit(1.0)), "p_fp_adj": F.coalesce("p_fp_adj", "p_fp")})
    if competition:
        df = df.join(room_shares(player_volume(scored), team), ["player_id", "tseason"], "left").fillna(0.0, list(COMPETITION))
    return df


def starters(depth: DataFrame | None, agg: DataFrame, adp: DataFrame | None, target_season: int, has_chart: bool) -> DataFrame:
    """(player_id, season) of the chart's starters; the market's best where the chart is not out yet."""
    from ..functions.names import word_key
    from ..operators.ranking import latest_per_entity

    parts = []
    if depth is not None:
        chart = depth.where((F.col("week") == 1) & (F.col("depth_team") == "1") & F.col("depth_position").isin(*POSITIONS))
        parts.append(chart.where(F.col("player_id").isNotNull()).select("player_id", "season").distinct())
    if not has_chart and adp is not None:
        best = adp.select(word_key("player").alias("__k"), F.col("adp").try_cast("double").alias("adp")).groupBy("__k").agg(F.min("adp").alias("adp"))
        latest = latest_per_entity(agg.select("player_id", "season", "player", "position"), "player_id", [F.col("season")])
        ranked = latest.withColumn("__k", word_key("player")).join(best, "__k").where(F.col("adp").isNotNull())
        top = top_k_by_table(ranked, "position", [F.col("adp").asc(), F.col("player_id").asc()], ADP_STARTERS, ADP_STARTERS_OTHER)
        parts.append(top.select("player_id", F.lit(target_season).alias("season")))
    if not parts:
        return agg.select("player_id", "season").limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def prior_anchor(frame: DataFrame, starting: DataFrame | None = None, schedule: bool = False) -> DataFrame:
    """Add ``anchor``: rate times expected games, or last season's total without career features.

    The rate is half career, half last season; a starter's games are regressed toward a full season.
    """
    if "c_games_avg" not in frame.columns:
        return frame.withColumn("anchor", F.col("p_fp_adj" if schedule and "p_fp_adj" in frame.columns else "p_fp"))
    last = F.col("p_fp") / F.greatest(F.col("p_games"), F.lit(1))
    rate = CAREER_WEIGHT * F.coalesce(F.col("c_ppg_wavg"), last) + (1 - CAREER_WEIGHT) * last
    games = F.coalesce("c_games_avg", F.col("p_games").cast("double"))
    if starting is not None:
        frame = frame.join(starting.select("player_id", F.col("season").alias("tseason"), F.lit(True).alias("__starts")), ["player_id", "tseason"], "left")
        n = F.greatest(F.coalesce(F.col("c_seasons"), F.lit(1)), F.lit(1))
        full = (games * n + STARTER_GAMES * STARTER_PRIOR_SEASONS) / (n + STARTER_PRIOR_SEASONS)
        games = F.when(F.col("__starts"), full).otherwise(games)
    return frame.withColumn("anchor", rate * clip(games, *GAMES_BOUNDS)).drop("__starts")


def blend(df: DataFrame) -> DataFrame:
    """Model and anchor in fixed shares, never negative."""
    mixed = MODEL_WEIGHT * F.greatest(F.col("pred"), F.lit(0.0)) + (1 - MODEL_WEIGHT) * F.col("anchor")
    return df.withColumn("proj", clip(mixed, low=0.0))


def project_season(frame: DataFrame, target_season: int, starting: DataFrame | None = None, columns: Sequence[str] | None = None,
                   schedule: bool = False, model: GradientBoosting | None = None) -> DataFrame:
    """Season totals of everyone entering the target season, from pairs of earlier seasons only."""
    from ..functions.expr import bin_index

    wanted = [c for c in (columns or model_columns()) if c in frame.columns]
    model = model or GradientBoosting(wanted, "target_fp")
    anchored = once(prior_anchor(frame, starting, schedule), "anchored")
    train = anchored.where((F.col("tseason") < target_season) & F.col("target_fp").isNotNull())
    model.fit(train)
    cohort = {"__pg": age_group("position"), "__ab": bin_index("age", AGE_EDGES)}
    fitted = blend(model.predict(train)).where(F.col("target_fp") >= AGE_MIN_ACTUAL).withColumns(cohort)
    ratios = ratio_calibration(fitted, ["__pg", "__ab"], "target_fp", "proj")
    test = blend(model.predict(anchored.where(F.col("tseason") == target_season))).withColumns(cohort)
    out = apply_calibration(test, ratios, ["__pg", "__ab"], "proj", AGE_STRENGTH, AGE_BOUNDS)
    return out.select("player_id", "player", "position", round_even(clip("proj", low=0.0), 1).alias("proj"))


def backtest_rank(projection: DataFrame, agg: DataFrame, target_season: int) -> DataFrame:
    """Rank correlation of a projection and of last season's totals with the outcome, and the error."""
    actual = agg.where(F.col("season") == target_season).select("player_id", "season", "fp")
    last = agg.where(F.col("season") == target_season - 1).select("player_id", F.col("fp").alias("p_fp"))
    m = projection.join(actual, "player_id").join(last, "player_id", "left")
    rho = group_spearman(m, ["season"], "proj", "fp").select("season", F.col("spearman").alias("model_spearman"))
    naive = group_spearman(m, ["season"], "p_fp", "fp").select("season", F.col("spearman").alias("lastyear_spearman"))
    return error_metrics(m, "fp", "proj", ["season"]).join(rho, "season").join(naive, "season").select(
        "season", "n", "model_spearman", "lastyear_spearman", F.col("mae").alias("model_mae"))
