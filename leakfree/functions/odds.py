"""American odds, de-vigged markets and expected value of a stake."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col


def implied_probability(odds: Column | str) -> Column:
    """Probability implied by American odds, margin included."""
    o = col(odds).cast("double")
    return F.when(o < 0, F.try_divide(-o, -o + 100.0)).otherwise(F.try_divide(F.lit(100.0), o + 100.0))


def unit_profit(odds: Column | str, won: Column | bool = True) -> Column:
    """Profit of a one-unit stake; a lost stake is -1."""
    o = col(odds).cast("double")
    gain = F.when(o > 0, o / 100.0).otherwise(F.try_divide(F.lit(100.0), -o))
    if won is True:
        return gain
    return F.when(won, gain).otherwise(F.lit(-1.0))


def fair_probability(side: Column | str, other: Column | str) -> Column:
    """Margin-free probability of ``side`` in a two-sided market."""
    a, b = implied_probability(side), implied_probability(other)
    return F.try_divide(a, a + b)


def better_side(p_over: Column | str, over_odds: Column | str, under_odds: Column | str) -> Column:
    """Struct(side, ev, odds) of the side with the higher expected value; a tie takes the over."""
    p = col(p_over)
    ev_over = p * unit_profit(over_odds) - (1 - p)
    ev_under = (1 - p) * unit_profit(under_odds) - p
    def pick(side, ev, odds):
        return F.struct(F.lit(side).alias("side"), ev.alias("ev"), col(odds).cast("double").alias("odds"))
    return F.when(ev_over >= ev_under, pick("over", ev_over, over_odds)).otherwise(
        pick("under", ev_under, under_odds)
    )
