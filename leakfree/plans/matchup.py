"""Win probability of many matchups at once, from residual pools.

Independent pools need no draws: probabilities come from characteristic functions. Draws of correlated outcomes
are one long table (player, draw) and everything after them is joins and sums. Python appears
only where correlated normals need a Cholesky factor, on the few players of one matchup.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hash_unit, round_even
from ..operators.correlation import PASS_CATCHERS, RHO
from ..operators.pools import bin_edges, inverse_cdf, ranked_pool, with_bins
from ..session import stored

HALVINGS, NEGLIGIBLE = 45, -45.0
CELL = ["position", "bin"]
ALL = "*"


def residual_pools(resid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bin edges per position and the ranked pools per (position, bin), plus one pool of everything.

    The common pool stands in for positions without history.
    """
    resid = stored(resid.select("position", "pred", "residual", "player_id", "season", "week"))
    edges = stored(bin_edges(resid))
    cells = with_bins(resid, edges).select("position", "bin", "residual", "player_id", "season", "week")
    whole = cells.withColumns({"position": F.lit(ALL), "bin": F.lit(-1)})
    return edges, stored(ranked_pool(cells.unionByName(whole), CELL))


def place_in_pools(players: DataFrame, edges: DataFrame, pools: DataFrame) -> DataFrame:
    """The pool cell of every player; an empty or unknown cell falls back to the common pool."""
    cells = stored(pools.where(F.col("idx") == 0).select(
        F.col("position").alias("__p"), F.col("bin").alias("__b"), F.lit(True).alias("__known")))
    placed = with_bins(players, edges)
    j = placed.join(cells, (placed["position"] == F.col("__p")) & (placed["bin"] == F.col("__b")), "left")
    known = F.coalesce("__known", F.lit(False))
    return j.withColumns({
        "__cell_position": F.when(known, F.col("position")).otherwise(F.lit(ALL)),
        "__cell_bin": F.when(known, F.col("bin")).otherwise(F.lit(-1))}).drop("__p", "__b", "__known", "bin")


def independent_draws(players: DataFrame, edges: DataFrame, pools: DataFrame, draws: int) -> DataFrame:
    """Outcome per player and draw: the residual at a hashed position of the pool, added to the projection.

    The hash depends on player and draw only, so a player has the same draws in every matchup.
    """
    placed = place_in_pools(players, edges, pools)
    sizes = stored(pools.where(F.col("idx") == 0).select(
        F.col("position").alias("__cell_position"), F.col("bin").alias("__cell_bin"), F.col("n").alias("__n")))
    spread = placed.join(sizes, ["__cell_position", "__cell_bin"]).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    index = F.least(F.floor(hash_unit("player_id", "draw") * F.col("__n")), F.col("__n") - 1)
    values = pools.select(F.col("position").alias("__cell_position"), F.col("bin").alias("__cell_bin"), F.col("idx").alias("__idx"), "residual")
    hit = spread.withColumn("__idx", index).join(values, ["__cell_position", "__cell_bin", "__idx"])
    return hit.select(*players.columns, "draw", (F.col("pred") + F.col("residual")).alias("outcome"))


def _relation_matrix(team, opp, pos, rho) -> np.ndarray:
    """Correlation matrix of a handful of players from their relationships."""
    same_team = team[:, None] == team[None, :]
    same_game = same_team & (opp[:, None] == opp[None, :])
    same_game |= (team[:, None] == opp[None, :]) & (opp[:, None] == team[None, :])
    is_pc = np.isin(pos, PASS_CATCHERS)
    any_pc, both_pc = is_pc[:, None] | is_pc[None, :], is_pc[:, None] & is_pc[None, :]
    qb, rb = pos == "QB", pos == "RB"
    any_qb, any_rb = qb[:, None] | qb[None, :], rb[:, None] | rb[None, :]
    own = np.select([any_qb & any_pc, both_pc, any_rb & any_pc, any_qb & any_rb],
                    [rho["qb_pc"], rho["pc_pc"], rho["rb_pc"], rho["qb_rb"]], 0.0)
    across = np.select([any_qb & any_pc, both_pc], [rho["opp_qb_pc"], rho["opp_pc_pc"]], 0.0)
    matrix = np.where(same_game, np.where(same_team, own, across), 0.0)
    np.fill_diagonal(matrix, 1.0)
    return matrix


def _positive_definite(matrix: np.ndarray) -> np.ndarray:
    """The matrix with eigenvalues lifted above zero and the diagonal restored to one."""
    values, vectors = np.linalg.eigh(matrix)
    lifted = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    scale = 1.0 / np.sqrt(np.diag(lifted))
    return lifted * scale[:, None] * scale[None, :]


def correlated_uniforms(players: DataFrame, draws: int, block: int = 500, seed: int = 0, rho: dict = RHO) -> DataFrame:
    """Uniforms per (matchup, player, draw), correlated among players of the same game.

    Draws are cut into blocks; one Python group is one matchup and one block of draws, seeded by both.
    """
    blocks = math.ceil(draws / block)
    schema = "matchup_id string, side string, player_id string, draw int, u double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "player_id"], ignore_index=True)
        matchup, b = pdf["matchup_id"].iloc[0], int(pdf["block"].iloc[0])
        first, last = b * block, min(draws, (b + 1) * block)
        matrix = _relation_matrix(pdf["recent_team"].to_numpy(), pdf["opponent_team"].to_numpy(), pdf["position"].to_numpy(), rho)
        factor = np.linalg.cholesky(_positive_definite(matrix))
        rng = np.random.default_rng([seed, zlib.crc32(matchup.encode()), b])
        z = factor @ rng.standard_normal((len(pdf), last - first))
        erf = np.frompyfunc(math.erf, 1, 1)
        u = 0.5 * (1.0 + erf(z / math.sqrt(2.0)).astype(float))
        n = last - first
        return pd.DataFrame({
            "matchup_id": np.repeat(pdf["matchup_id"].to_numpy(), n), "side": np.repeat(pdf["side"].to_numpy(), n),
            "player_id": np.repeat(pdf["player_id"].to_numpy(), n), "draw": np.tile(np.arange(first, last, dtype=np.int32), len(pdf)),
            "u": u.reshape(-1)})

    rows = players.select(
        F.col("matchup_id").cast("string"), "side", F.col("player_id").cast("string"), F.col("recent_team").cast("string"),
        F.col("opponent_team").cast("string"), "position", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return rows.groupBy("matchup_id", "block").applyInPandas(one, schema)


def cell_functions(pools: DataFrame, span: float, frequencies: int) -> DataFrame:
    """(cell, cf, mean, variance): each pool's characteristic function at the odd multiples of pi / span, as log modulus and angle.

    Equal residuals are counted first, and the sums over them are formed before anything is shuffled.
    """
    # few bytes and much work: by the size of the table the planner would leave them to one task
    spread = pools.sparkSession.sparkContext.defaultParallelism
    values = pools.groupBy(*CELL, "residual").agg(F.count("*").alias("__c")).repartition(spread, "residual")
    k, r, c = F.explode(F.sequence(F.lit(0), F.lit(frequencies - 1))).alias("k"), F.col("residual"), F.col("__c")
    t = _frequency(span) * r
    sums = values.select(*CELL, "residual", "__c", k).groupBy(*CELL, "k").agg(
        F.sum(c * F.cos(t)).alias("__re"), F.sum(c * F.sin(t)).alias("__im"), F.sum(c).alias("__n"), F.sum(c * r).alias("__s"), F.sum(c * r * r).alias("__q"))
    modulus = F.ln(F.greatest(F.hypot("__re", "__im") / F.col("__n"), F.lit(1e-300)))
    mean = F.col("__s") / F.col("__n")
    step = F.struct("k", modulus.alias("lm"), F.atan2("__im", "__re").alias("an"))
    return sums.groupBy(*CELL).agg(
        F.sort_array(F.collect_list(step)).alias("cf"), F.max(mean).alias("mean"), F.max(F.col("__q") / F.col("__n") - mean * mean).alias("variance"))


def _frequency(span: float, k: Column | None = None) -> Column:
    return ((F.col("k") if k is None else k) * 2 + 1) * F.lit(math.pi / span)


def exact_win_statistics(players: DataFrame, edges: DataFrame, pools: DataFrame, span: float, frequencies: int = 1024) -> DataFrame:
    """:func:`win_statistics` of independent pools without a draw.

    A side's total is a sum of independent outcomes, so its characteristic function is the product of theirs and that of the
    margin the product of both sides'. Gil-Pelaez inversion on odd multiples of pi / span then gives the probability that the margin is
    above zero, with half of that it is zero, and the distribution of a total, of which the quantiles are found by bisection. ``span``
    must exceed twice the largest possible margin; pi * frequencies / span times a side's deviation should be 8 or more, beyond which the rest of the
    series is below 1e-14. Only the rows of players are shuffled, by matchup.
    """
    cells = stored(cell_functions(pools, span, frequencies))
    placed = place_in_pools(players, edges, pools).join(
        cells.withColumnsRenamed({"position": "__cell_position", "bin": "__cell_bin"}), ["__cell_position", "__cell_bin"])
    own = placed.select("matchup_id", "side", "pred", "cf", "mean", "variance").repartition("matchup_id")
    waves = own.select("matchup_id", "side", "pred", F.inline("cf")).groupBy("matchup_id", "side", "k").agg(
        F.sum("lm").alias("lm"), F.sum(_frequency(span) * F.col("pred") + F.col("an")).alias("an"))
    shapes = waves.groupBy("matchup_id", "side").agg(F.sort_array(F.collect_list(F.struct("k", "lm", "an"))).alias("cf"))
    moments = own.groupBy("matchup_id", "side").agg(F.sum(F.col("pred") + F.col("mean")).alias("mean"), F.sum("variance").alias("variance"))
    sides = shapes.join(moments, ["matchup_id", "side"])

    def total(cf: Column, term) -> Column:
        return F.aggregate(cf, F.lit(0.0), lambda a, x: a + term(x) / (x["k"] * 2 + 1)) * F.lit(2 / math.pi)

    def quantile(p: float) -> Column:
        def halve(at: Column, _: Column) -> Column:
            mid = (at["lo"] + at["hi"]) / 2
            below = 0.5 - total(F.col("felt"), lambda x: F.exp(x["lm"]) * F.sin(x["an"] - _frequency(span, x["k"]) * mid)) < p
            upper, lower = F.struct(mid.alias("lo"), at["hi"].alias("hi")), F.struct(at["lo"].alias("lo"), mid.alias("hi"))
            return F.when(below, upper).otherwise(lower)  # the sum is evaluated once

        start = F.struct((F.col("mean") - span / 2).alias("lo"), (F.col("mean") + span / 2).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda at: (at["lo"] + at["hi"]) / 2)

    # what is far below the rounding of a double is left out of the bisection
    felt = sides.withColumn("felt", F.filter("cf", lambda x: x["lm"] > NEGLIGIBLE))
    known = felt.withColumns({"p10": quantile(0.1), "p90": quantile(0.9)}).drop("felt")
    side = {s: F.max(F.when(F.col("side") == s, F.struct("cf", "mean", "variance", "p10", "p90"))).alias(s) for s in "ab"}
    both = known.groupBy("matchup_id").agg(*side.values())
    waves_of = {s: F.coalesce(F.col(f"{s}.cf"), F.array().cast(known.schema["cf"].dataType)) for s in "ab"}
    pairs = F.zip_with(waves_of["a"], waves_of["b"], lambda x, y: F.struct(
        F.coalesce(x["k"], y["k"]).alias("k"), (F.coalesce(x["lm"], F.lit(0.0)) + F.coalesce(y["lm"], F.lit(0.0))).alias("lm"),
        (F.coalesce(x["an"], F.lit(0.0)) - F.coalesce(y["an"], F.lit(0.0))).alias("an")))

    def of(s: str, name: str) -> Column:
        return F.coalesce(F.col(f"{s}.{name}"), F.lit(0.0))

    win = 0.5 + total(pairs, lambda x: F.exp(x["lm"]) * F.sin(x["an"]))
    return both.select(
        "matchup_id", round_even(win, 4).alias("win_prob_a"), of("a", "mean").alias("sim_mean_a"), of("b", "mean").alias("sim_mean_b"),
        *[of(s, q).alias(f"{s}_{q}") for s in "ab" for q in ("p10", "p90")], (of("a", "mean") - of("b", "mean")).alias("margin_mean"),
        F.sqrt(of("a", "variance") + of("b", "variance")).alias("margin_std"))


def correlated_draws(players: DataFrame, edges: DataFrame, pools: DataFrame, draws: int, **options) -> DataFrame:
    """Outcome per matchup, player and draw through the interpolated inverse of each player's pool."""
    placed = place_in_pools(players, edges, pools).withColumns({
        "matchup_id": F.col("matchup_id").cast("string"), "player_id": F.col("player_id").cast("string")})
    u = correlated_uniforms(players, draws, **options)
    cells = pools.select(F.col("position").alias("__cell_position"), F.col("bin").alias("__cell_bin"), "idx", "residual", "n")
    joined = placed.join(u, ["matchup_id", "side", "player_id"])
    drawn = inverse_cdf(joined, cells, ["__cell_position", "__cell_bin"], "u", out="__residual")
    return drawn.select("matchup_id", "side", "player_id", "draw", (F.col("pred") + F.col("__residual")).alias("outcome"))


def win_statistics(outcomes: DataFrame) -> DataFrame:
    """Per matchup: win probability of side a (ties count half), totals, intervals and margin.

    Exact percentiles are taken over the draws of one matchup, a number the caller chose.
    """
    def side(s: str) -> Column:
        return F.sum(F.when(F.col("side") == s, F.col("outcome")).otherwise(0.0))

    totals = outcomes.groupBy("matchup_id", "draw").agg(side("a").alias("a"), side("b").alias("b"))
    margin = F.col("a") - F.col("b")
    wins = F.avg(F.when(F.col("a") > F.col("b"), 1.0).when(F.col("a") == F.col("b"), 0.5).otherwise(0.0))
    return totals.groupBy("matchup_id").agg(
        round_even(wins, 4).alias("win_prob_a"),
        F.avg("a").alias("sim_mean_a"), F.avg("b").alias("sim_mean_b"),
        F.percentile("a", F.lit(0.1)).alias("a_p10"), F.percentile("a", F.lit(0.9)).alias("a_p90"),
        F.percentile("b", F.lit(0.1)).alias("b_p10"), F.percentile("b", F.lit(0.9)).alias("b_p90"),
        F.avg(margin).alias("margin_mean"), F.stddev_pop(margin).alias("margin_std"))


def win_probability(outcomes: DataFrame, players: DataFrame) -> DataFrame:
    """:func:`win_statistics` rounded for display, beside the projected totals."""
    sims = win_statistics(outcomes)
    proj = players.groupBy(F.col("matchup_id").cast("string").alias("matchup_id")).agg(
        F.sum(F.when(F.col("side") == "a", F.col("pred")).otherwise(0.0)).alias("proj_a"),
        F.sum(F.when(F.col("side") == "b", F.col("pred")).otherwise(0.0)).alias("proj_b"))
    rounded = [c for c in sims.columns if c not in ("matchup_id", "win_prob_a")]
    return sims.withColumn("matchup_id", F.col("matchup_id").cast("string")).join(proj, "matchup_id").select(
        "matchup_id", "win_prob_a",
        *[round_even(c, 1).alias(c) for c in ("proj_a", "proj_b", *rounded)])
