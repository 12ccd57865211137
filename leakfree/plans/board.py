"""The draft board: season projections, entrants, reconciliation, value, penalties and context."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import word_key
from ..operators.joins import first_by
from ..operators.ordered import stacked_ranks
from ..operators.ranking import (
    DEFAULT_LEAGUE, market_delta, open_competition, schedule_ahead, score_board, sort_match, upside_bonus, upside_flags,
)
from ..operators.reports import status_penalty
from ..session import stored


def combine(veterans: DataFrame, entrants: DataFrame | None, entrant_discount: float = 1.0) -> DataFrame:
    """Veterans and entrants in one frame; an entity in both keeps its veteran row."""
    cols = ["player_id", "player", "position", "proj"]
    if entrants is None:
        return veterans.select(*cols)
    late = entrants.select("player_id", "player", "position", (F.col("proj") * entrant_discount).alias("proj"))
    both = veterans.select(*cols, F.lit(0).alias("__p")).unionByName(late.withColumn("__p", F.lit(1)))
    return first_by(both, ["player_id"], [F.col("__p"), -F.col("proj"), F.col("player")]).drop("__p")


def reconcile_rooms(proj: DataFrame, team: DataFrame, chart: DataFrame | None, adp: DataFrame | None, position: str = "RB") -> DataFrame:
    """Give the projections of each room to its members in chart order (market rank where no chart)."""
    b = proj.join(team.select("player_id", "team"), "player_id", "left")
    order = F.lit(None).cast("double")
    if adp is not None:
        best = adp.select(word_key("player").alias("__k"), F.col("adp").try_cast("double").alias("__adp")).groupBy("__k").agg(F.min("__adp").alias("__adp"))
        b = b.withColumn("__k", word_key("player")).join(best, "__k", "left").drop("__k")
        order = F.col("__adp")
    if chart is not None:
        b = b.join(chart.select("player_id", F.col("depth_rank").cast("double").alias("__chart")), "player_id", "left")
        order = F.coalesce(F.col("__chart"), order)
    b = b.withColumn("__ord", order)
    return sort_match(b, ["team"], "__ord", "proj", "player_id", F.col("position") == position).select(*proj.columns)


def draft_board(veterans: DataFrame, entrants: DataFrame | None = None, league: Mapping = DEFAULT_LEAGUE, team: DataFrame | None = None,
                chart: DataFrame | None = None, adp: DataFrame | None = None, shape: DataFrame | None = None,
                upside_weight: float = 0.0, entrant_discount: float = 1.0) -> DataFrame:
    """Projection, value over replacement and price of everyone who can be drafted."""
    proj = combine(veterans, entrants, entrant_discount)
    if team is not None and (chart is not None or adp is not None):
        proj = reconcile_rooms(proj, team, chart, adp)
    if upside_weight and shape is not None:
        proj = upside_bonus(proj.join(shape.select("player_id", "u_ceiling"), "player_id", "left"), "u_ceiling", upside_weight).drop("u_ceiling")
    return stored(score_board(proj, league), "board")


def with_context(board: DataFrame, league: Mapping, avail: DataFrame, shape: DataFrame, team: DataFrame, ahead: DataFrame,
                 shares: DataFrame, highs: DataFrame, adp: DataFrame) -> DataFrame:
    """Mark down the unavailable, score again, and add everything a reader weighs beside the number.

    Scoring and ranking read the board several times, so it is materialised (one row per entity)
    between the steps; otherwise every step would repeat all the steps before it.
    """
    known = board.select("player_id", "player", "position", "proj").join(
        avail.select("player_id", "status", "live_code"), "player_id", "left")
    b = score_board(status_penalty(known).drop("status", "live_code"), league)
    # all that is only joined comes first, so that the flags and both ranks read one table
    wide = open_competition(schedule_ahead(b, team, ahead), shares).join(highs, "player_id", "left").withColumn(
        "career_year", F.coalesce("career_year", F.lit(False)))
    flagged = stored(upside_flags(wide, shape), "board")
    ranked = stacked_ranks(flagged, {"sched_rank": (["position"], "sched_ahead"), "our_rank": ([], "vor")})
    return market_delta(ranked, adp)


def flag_unrostered(board: DataFrame, roster_names: DataFrame) -> DataFrame:
    """Flag board rows whose loose name is on no roster of the season."""
    names = roster_names.select(word_key("full_name").alias("__k")).distinct().withColumn("__on", F.lit(True))
    return board.withColumn("__k", word_key("player")).join(names, "__k", "left").withColumn(
        "no_team", F.col("__on").isNull()).drop("__k", "__on")
