"""Entries without history: a monotone curve over the entry pick, calibrated by pick tier."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import coalesce_present, col, round_even
from ..operators.metrics import error_metrics, group_spearman, tiered_calibration
from ..operators.reports import map_team_codes
from ..operators.rollups import pass_rate, room_turnover

# Pick ranges of the calibration tiers; everything else is the last tier.
PICK_TIERS = ((1, 40), (41, 120))
POSITIONS = ("QB", "RB", "WR", "TE")
NAME_COLUMNS = ("pfr_player_name", "full_name", "player_name", "player")


def pick_tier(pick: Column | str) -> Column:
    p = col(pick)
    tier = F.lit(len(PICK_TIERS))
    for i, (lo, hi) in enumerate(PICK_TIERS):
        tier = F.when(p.between(lo, hi), F.lit(i)).otherwise(tier)
    return tier.cast("int")


def draft_capital(picks: DataFrame) -> DataFrame:
    """Entrants with season, round, pick, position, name and team; incomplete rows are dropped."""
    mapped = map_team_codes(picks) if "team" in picks.columns else picks.withColumn("team", F.lit(None).cast("string"))
    pick = F.col("pick").try_cast("double")
    return mapped.select(
        F.col("gsis_id").alias("player_id"), F.col("season").try_cast("int").alias("season"),
        F.coalesce(F.col("round").try_cast("double"), F.floor(pick / 32) + 1).alias("draft_round"), pick.alias("pick"), "position",
        F.coalesce(coalesce_present(mapped, NAME_COLUMNS), F.col("gsis_id").cast("string")).alias("player"), "team",
    ).where(F.col("player_id").isNotNull() & F.col("season").isNotNull() & F.col("pick").isNotNull()
            & F.col("position").isin(*POSITIONS))


class PickCurve:
    """Points as a never rising function of the pick.

    Rows are first averaged per pick, which bounds the fit by the number of picks in a draft.
    """

    def fit(self, train: DataFrame) -> PickCurve:
        per_pick = train.groupBy("pick").agg(F.avg("fp").alias("label"), F.count("*").cast("double").alias("weight"))
        vectors = VectorAssembler(inputCols=["pick"], outputCol="features").transform(per_pick)
        self.model = IsotonicRegression(isotonic=False, weightCol="weight").fit(vectors)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        vectors = VectorAssembler(inputCols=["pick"], outputCol="features").transform(df)
        return self.model.transform(vectors).withColumn(
            "proj", F.greatest(F.col("prediction"), F.lit(0.0))).drop("features", "prediction")


def rookie_projection(picks: DataFrame, agg: DataFrame, target_season: int) -> DataFrame:
    """Projected points of the entrants of a season, from entrants of earlier seasons only.

    The curve sees only entrants who played; the tier ratios bring in those who did not.
    """
    caps = draft_capital(picks)
    fp = agg.select("player_id", "season", "fp")
    curve = PickCurve().fit(caps.where(F.col("season") < target_season).join(fp, ["player_id", "season"]))
    prior = curve.predict(caps.where(F.col("season") < target_season))
    ratios = tiered_calibration(
        prior, fp.withColumnRenamed("fp", "actual"), ["player_id", "season"], pick_tier("pick"), fp.agg(F.min("season")).scalar())
    test = curve.predict(caps.where(F.col("season") == target_season)).withColumn("tier", pick_tier("pick"))
    return test.join(ratios, "tier", "left").select(
        "player_id", "player", "position", "team", "pick", round_even(F.col("proj") * F.coalesce("ratio", F.lit(1.0)), 1).alias("proj"))


def backtest_rookies(projection: DataFrame, agg: DataFrame, target_season: int | None = None) -> DataFrame:
    """Rank correlation and mean error of entrant projections; null metrics for fewer than three.

    ``projection`` is of one season, or has a column ``season`` of its own, and every season is measured.
    """
    keys = ["player_id", "season"]
    mine = projection if target_season is None else projection.withColumn("season", F.lit(target_season))
    m = mine.join(agg.select(*keys, "fp"), keys)
    rho = group_spearman(m, ["season"], "proj", "fp").select("season", "spearman")
    e = error_metrics(m, "fp", "proj", ["season"])
    few = F.col("n") < 3
    return e.join(rho, "season").select(
        "season", "n", F.when(~few, F.col("spearman")).alias("rookie_spearman"), F.when(~few, F.col("mae")).alias("rookie_mae"))


def rookie_context(picks: DataFrame, agg: DataFrame, team: DataFrame, depth: DataFrame, weekly: DataFrame, target_season: int) -> DataFrame:
    """What each entrant walks into: production that left and returns, the man in front, chart place, scheme.

    Without rosters of the target season it is unknown who stayed, so those columns are null.
    """
    caps = draft_capital(picks).where(F.col("season") == target_season)
    known = team.where(F.col("season") == target_season).limit(1).select(F.lit(True).alias("k")).agg(
        F.coalesce(F.max("k"), F.lit(False))).scalar()
    rooms = room_turnover(agg, team, target_season).withColumn("team", F.col("team").cast("string"))
    rate = pass_rate(weekly.where(F.col("season") == target_season - 1)).select(F.col("team").cast("string").alias("team"), "pass_rate")
    out = caps.join(rooms, ["team", "position"], "left").join(depth, "player_id", "left").join(rate, "team", "left")
    def unless_unknown(c: Column) -> Column:
        return F.when(known, c)
    return out.select(
        "player_id", "player", "position", "team", "pick",
        unless_unknown(round_even(F.coalesce("vacated_fp", F.lit(0.0)), 1)).alias("vacated_fp"),
        unless_unknown(round_even(F.coalesce("returning_fp", F.lit(0.0)), 1)).alias("returning_fp"),
        unless_unknown(F.col("blocked_by")).alias("blocked_by"),
        unless_unknown(round_even(F.coalesce("blocked_by_fp", F.lit(0.0)), 1)).alias("blocked_by_fp"),
        "depth_rank", "pass_rate")


