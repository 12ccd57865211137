"""Game tables and forecasts beside the market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import order_key, round_even
from ..functions.odds import fair_probability
from ..operators.pools import tail_shares
from ..operators.reshape import INDOOR_ROOFS, scores_by_team
from ..operators.trailing import trailing_mean_chunked
from ..session import stored
from .projection import GradientBoosting, walk_forward

FORM_WINDOW, FORM_MIN_GAMES = 8, 3


def team_form(games: DataFrame) -> DataFrame:
    """Trailing points for and against per team entering each game (at least three earlier games).

    Teams may play any number of games, so the windows run per (team, season) with carried rows.
    """
    form = trailing_mean_chunked(
        scores_by_team(games), ["pf", "pa"], [FORM_WINDOW], ["team"], ["season", "week", "game_id"], "season",
        min_rows=FORM_MIN_GAMES, suffix="_form")
    return form.select("game_id", "season", "week", "team", "is_home", "pf_form", "pa_form")


FEATURES = ("home_pf_form", "home_pa_form", "away_pf_form", "away_pa_form", "home_rest", "away_rest", "div_game", "dome", "neutral")
LINES = ("spread_line", "total_line", "home_spread_odds", "away_spread_odds", "over_odds", "under_odds", "home_moneyline", "away_moneyline")


def game_table(games: DataFrame) -> DataFrame:
    """One row per game with both sides' form; games without form are dropped, unplayed ones stay."""
    form = team_form(games)

    def side(is_home: int, name: str) -> DataFrame:
        return form.where(F.col("is_home") == is_home).select(
            "game_id", F.col("pf_form").alias(f"{name}_pf_form"), F.col("pa_form").alias(f"{name}_pa_form"))

    out = games.join(side(1, "home"), "game_id").join(side(0, "away"), "game_id").withColumns({
        "home_margin": F.col("result"), "total_points": F.col("total"),
        "dome": F.coalesce(F.col("roof").isin(*INDOOR_ROOFS), F.lit(False)).cast("int"),
        "neutral": (~F.col("location").eqNullSafe(F.lit("Home"))).cast("int")})
    return out.where(F.col("home_pf_form").isNotNull() & F.col("away_pf_form").isNotNull())


def forecast_rows(test: DataFrame, totals: DataFrame, margins: DataFrame) -> DataFrame:
    """Model beside market for every game: leans, empirical probabilities, margin-free market prices.

    ``totals`` and ``margins`` are residual tables; each probability is the share of them that clears
    the line.
    """
    t = test.withColumns({
        "__need_total": F.col("total_line") - F.col("pred_total"), "__need_margin": F.col("spread_line") - F.col("pred_margin"),
        "__need_win": -F.col("pred_margin")})

    def above(df: DataFrame, pool: DataFrame, need: str, out: str) -> DataFrame:
        return tail_shares(df, pool, [], need).withColumnRenamed("p_above", out).drop("p_below", "pool_n")

    t = above(t, totals, "__need_total", "__over")
    t = above(t, margins, "__need_margin", "__cover")
    t = above(t, margins, "__need_win", "__home")
    return t.select(
        "game_id", "season", "week", F.concat_ws(" @ ", F.col("away_team").cast("string"), F.col("home_team").cast("string")).alias("game"),
        round_even("total_line", 1).alias("total_line"), round_even("pred_total", 1).alias("pred_total"),
        F.when(F.col("pred_total") > F.col("total_line"), "over").otherwise("under").alias("total_lean"),
        round_even("__over", 3).alias("model_over"), round_even(fair_probability("over_odds", "under_odds"), 3).alias("mkt_over"),
        round_even("spread_line", 1).alias("spread_line"), round_even("pred_margin", 1).alias("pred_margin"),
        F.when(F.col("pred_margin") > F.col("spread_line"), F.col("home_team")).otherwise(F.col("away_team")).alias("spread_lean"),
        round_even("__cover", 3).alias("model_home_cover"),
        round_even(fair_probability("home_spread_odds", "away_spread_odds"), 3).alias("mkt_home_cover"),
        round_even("__home", 3).alias("model_home_win"),
        round_even(fair_probability("home_moneyline", "away_moneyline"), 3).alias("mkt_home_win"),
        F.when(F.col("__home") >= 0.5, F.col("home_team")).otherwise(F.col("away_team")).alias("ml_lean"))


def game_forecasts(games: DataFrame, season: int, week: int, model=None, refit: str = "period", pool_seasons: int | None = 2) -> DataFrame:
    """Forecast the games of a period: models on all earlier games, residuals of the last ``pool_seasons`` seasons.

    The residuals come from a walk-forward over those seasons (all with None), so they are out of sample;
    ``refit`` says whether the models are fitted anew before every period or every season.
    """
    table = stored(game_table(games))
    earlier = table.where((order_key() < season * 100 + week) & F.col("total_points").isNotNull())
    test = table.where(order_key() == season * 100 + week)
    seasons = sorted((r["season"] for r in earlier.select("season").distinct().collect()), reverse=True)
    recent = seasons[:pool_seasons] if pool_seasons else seasons
    pools, preds = {}, test
    for target, out in (("total_points", "pred_total"), ("home_margin", "pred_margin")):
        make = model or (lambda y: GradientBoosting(FEATURES, y, iterations=300, depth=3))
        walked = walk_forward(earlier, make(target), recent, eval_col=target, min_train_rows=200, keep=("game_id", target), refit=refit)
        pools[out] = walked.select("game_id", (F.col(target) - F.col("pred")).alias("residual"))
        preds = make(target).fit(earlier).predict(preds).withColumnRenamed("pred", out)
    return forecast_rows(preds, pools["pred_total"], pools["pred_margin"])
