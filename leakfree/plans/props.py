"""Pricing of two-sided markets on single stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import round_even
from ..functions.names import word_key
from ..functions.odds import better_side, fair_probability
from ..operators.metrics import error_metrics, interval_coverage
from ..operators.pools import tail_shares

# The positions that accrue the stat of each market.
MARKETS = {
    "passing_yards": ("QB",),
    "passing_tds": ("QB",),
    "receiving_yards": ("WR", "TE", "RB"),
    "receptions": ("WR", "TE", "RB"),
    "rushing_yards": ("RB", "QB", "WR"),
}


def markets_of_position(df: DataFrame, position: str = "position") -> DataFrame:
    """One row per row and market its position is eligible for; other rows vanish."""
    eligible = F.array_compact(F.array(*[
        F.when(F.col(position).isin(*who), F.lit(m)) for m, who in MARKETS.items()
    ]))
    return df.withColumn("market", F.explode(eligible))


def price_lines(lines: DataFrame, projection: DataFrame, residuals: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Price two-sided lines against projections, for all markets at once.

    ``projection`` has one ``pred`` per key of the lines and market, ``residuals`` a pool per market.
    Lines without a projection drop out, and so do lines whose better side is not worth the threshold.
    """
    keys = [c for c in projection.columns if c != "pred"]
    priced = lines.join(projection, keys).withColumn("__need", F.col("line") - F.col("pred"))
    tail = tail_shares(priced, residuals, ["market"], "__need").withColumnRenamed("p_above", "__p")
    out = tail.withColumns({
        "__fair": fair_probability("over_odds", "under_odds"), "__b": better_side("__p", "over_odds", "under_odds")})
    rows = out.select(
        *keys, "line", round_even("pred", 1).alias("proj"), round_even("__p", 3).alias("model_p_over"),
        round_even("__fair", 3).alias("market_p_over"), round_even(F.col("__p") - F.col("__fair"), 3).alias("edge"),
        F.col("__b.side").alias("bet"), F.col("__b.odds").cast("int").alias("odds"), round_even("__b.ev", 3).alias("ev_per_1u"))
    return rows.where(F.col("ev_per_1u") > threshold).orderBy(F.col("ev_per_1u").desc(), *keys)


def lines_by_name(lines: DataFrame, board: DataFrame) -> DataFrame:
    """Listed lines with the player id of the board row under the same loose name; misses drop out."""
    ids = board.groupBy(word_key("player_display_name").alias("__k")).agg(F.min("player_id").alias("player_id"))
    return lines.withColumn("__k", word_key("player")).join(ids, "__k").drop("__k")


def prop_accuracy(evaluated: DataFrame, pool: DataFrame) -> DataFrame:
    """Mean error, interval coverage and mean share below, per market, on a later season than the pool."""
    cover = interval_coverage(evaluated, pool, ["market"], "actual", "pred")
    mae = error_metrics(evaluated, "actual", "pred", ["market"]).select("market", "mae")
    return cover.join(mae, "market").select(
        "market", "n", round_even("mae", 2).alias("mae"), *[round_even(c, 3).alias(c) for c in ("cover80", "cover50", "mean_pit")])


def stat_rows(feats: DataFrame) -> DataFrame:
    """One row per row and market, with the market's stat and its trailing means as common columns."""
    long = markets_of_position(feats)
    def pick(suffix: str):
        choice = F.lit(None).cast("double")
        for m in MARKETS:
            if m + suffix in feats.columns:
                choice = F.when(F.col("market") == m, F.col(m + suffix)).otherwise(choice)
        return choice
    return long.withColumns({"actual": pick(""), "stat_r3": pick("_r3"), "stat_r5": pick("_r5")})
