"""Game rows to team rows, and slates generated as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col


def team_rows(games: DataFrame, home: Mapping[str, Column | str], away: Mapping[str, Column | str],
              keep: Sequence[str] = ("game_id", "season", "week")) -> DataFrame:
    """Two rows per game from one scan: ``home`` and ``away`` name the same output columns."""
    if list(home) != list(away):
        raise ValueError("home and away must name the same columns in the same order")
    sides = [F.struct(*[col(c).alias(n) for n, c in side.items()]) for side in (home, away)]
    return games.select(*keep, F.inline(F.array(*sides)))


def opponents(games: DataFrame, keep: Sequence[str] = ("game_id", "season", "week")) -> DataFrame:
    """(team, opp) rows of every game."""
    return team_rows(games, {"team": "home_team", "opp": "away_team"}, {"team": "away_team", "opp": "home_team"}, keep)


def scores_by_team(games: DataFrame, keep: Sequence[str] = ("game_id", "season", "week")) -> DataFrame:
    """Points for and against per team and game."""
    return team_rows(
        games,
        {"team": "home_team", "pf": "home_score", "pa": "away_score", "is_home": F.lit(1)},
        {"team": "away_team", "pf": "away_score", "pa": "home_score", "is_home": F.lit(0)},
        keep,
    )


def implied_totals(games: DataFrame, keep: Sequence[str] = ("game_id", "season", "week")) -> DataFrame:
    """Points the market expects from each side; games without lines are dropped."""
    lined = games.where(F.col("spread_line").isNotNull() & F.col("total_line").isNotNull())
    total, spread = F.col("total_line") / 2.0, F.col("spread_line") / 2.0

    def side(team: str, sign: int, is_home: int) -> dict:
        own, other = (total + spread, total - spread) if sign > 0 else (total - spread, total + spread)
        line = F.col("spread_line") if sign > 0 else F.lit(0.0) - F.col("spread_line")
        return {
            "team": team, "team_implied_total": own, "opp_implied_total": other,
            "team_spread": line, "game_total": "total_line", "is_home": F.lit(is_home),
        }

    return team_rows(lined, side("home_team", 1, 1), side("away_team", -1, 0), keep)


# Roofs under which weather does not matter, and the calm indoor readings.
INDOOR_ROOFS = ("dome", "closed")
INDOOR_WIND, INDOOR_TEMP = 0.0, 70.0


def weather(games: DataFrame, keep: Sequence[str] = ("game_id", "season", "week")) -> DataFrame:
    """Weather per team and game, known before the game; indoor games are calm."""
    indoor = F.col("roof").isin(*INDOOR_ROOFS)
    columns = {
        "is_dome": indoor.cast("int"),
        "wind": F.when(indoor, F.lit(INDOOR_WIND)).otherwise(F.col("wind").cast("double")),
        "temp": F.when(indoor, F.lit(INDOOR_TEMP)).otherwise(F.col("temp").cast("double")),
    }
    return team_rows(games, {"team": "home_team", **columns}, {"team": "away_team", **columns}, keep)


def round_robin(periods: DataFrame, period: str, n_teams: Column | int, group: Sequence[str] = ()) -> DataFrame:
    """Circle-method pairings for each 0-based period: team 0 stays, the others rotate.

    ``n_teams`` is a number, a column or a scalar subquery. An odd field has one bye per period.
    Each period row is exploded on its own, so the slate is generated in parallel.
    """
    n = n_teams if isinstance(n_teams, Column) else F.lit(n_teams)
    even = n + n % 2
    base = periods.select(*group, period, n.alias("__n"), even.alias("__m"))

    def seat(i: Column) -> Column:
        turn = F.pmod(i - 1 - F.col(period), F.col("__m") - 1) + 1
        return F.when(i == 0, F.lit(0)).otherwise(turn)

    seats = base.where(F.col("__m") >= 2).withColumn(
        "__i", F.explode(F.sequence(F.lit(0), (F.col("__m") / 2 - 1).cast("int")))
    )
    pairs = seats.select(
        *group, period, "__n", seat(F.col("__i")).cast("int").alias("team_a"),
        seat(F.col("__m") - 1 - F.col("__i")).cast("int").alias("team_b"),
    )
    return pairs.where((F.col("team_a") < F.col("__n")) & (F.col("team_b") < F.col("__n"))).drop("__n")
