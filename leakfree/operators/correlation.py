"""Pairwise residual correlation without ever emitting pairs.

The correlation over all pairs of a group needs only sums over pairs, and each of those is a
product of sums over the two sides. The work is one aggregation, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col
from ..session import stored

# Residual correlation by relationship, and the pass-catching positions.
RHO = {
    "qb_pc": 0.199, "pc_pc": 0.004, "rb_pc": -0.011, "qb_rb": 0.041,
    "opp_qb_pc": 0.059, "opp_pc_pc": 0.034,
}
PASS_CATCHERS = ("WR", "TE")
MIN_PAIRS = 30

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def relation_rho(team_a, opp_a, pos_a, team_b, opp_b, pos_b, rho: Mapping[str, float] = RHO) -> Column:
    """Correlation assigned to two players; zero unless both are in the same game."""
    team_a, opp_a, pos_a, team_b, opp_b, pos_b = map(col, (team_a, opp_a, pos_a, team_b, opp_b, pos_b))
    same_game = F.array_sort(F.array(team_a, opp_a)) == F.array_sort(F.array(team_b, opp_b))
    same_team = team_a == team_b
    pc_a, pc_b = pos_a.isin(*PASS_CATCHERS), pos_b.isin(*PASS_CATCHERS)

    def either(p: str) -> Column:
        return (pos_a == p) | (pos_b == p)

    own = (
        F.when(either("QB") & (pc_a | pc_b), rho["qb_pc"]).when(pc_a & pc_b, rho["pc_pc"])
        .when(either("RB") & (pc_a | pc_b), rho["rb_pc"]).when(either("QB") & either("RB"), rho["qb_rb"])
        .otherwise(0.0)
    )
    across = F.when(either("QB") & (pc_a | pc_b), rho["opp_qb_pc"]).when(pc_a & pc_b, rho["opp_pc_pc"]).otherwise(0.0)
    return F.when(~same_game, F.lit(0.0)).when(same_team, own).otherwise(across)


def _moments(df: DataFrame, keys: Sequence[str], x: str, tag: str) -> DataFrame:
    v = F.col(x)
    return df.groupBy(*keys).agg(
        F.count(v).alias(f"n{tag}"), F.sum(v).alias(f"s{tag}"), F.sum(v * v).alias(f"q{tag}")
    )


def _cross_sums(sides: DataFrame) -> DataFrame:
    """Pair sums of every group from the moments of its two sides."""
    return sides.select(
        (F.col("na") * F.col("nb")).cast("double").alias("n"),
        (F.col("sa") * F.col("nb")).alias("sx"), (F.col("sb") * F.col("na")).alias("sy"),
        (F.col("qa") * F.col("nb")).alias("sxx"), (F.col("qb") * F.col("na")).alias("syy"),
        (F.col("sa") * F.col("sb")).alias("sxy"),
    )


def cross_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Pair sums of every (i in a, j in b) sharing ``keys``; the sides hold different entities."""
    return _cross_sums(_moments(a, keys, x, "a").join(_moments(b, keys, x, "b"), list(keys)))


def mirrored_pairs(a: DataFrame, b: DataFrame, period: Sequence[str], team: str, opp: str, x: str) -> DataFrame:
    """Pair sums of opponents: (team, opp) of ``a`` meets (opp, team) of ``b``; both orders count."""
    left = _moments(a, [*period, team, opp], x, "a")
    right = _moments(b, [*period, team, opp], x, "b")
    swapped = [F.col(opp).alias(team), F.col(team).alias(opp)]
    right = right.select(*period, *swapped, "nb", "sb", "qb")
    return _cross_sums(left.join(right, [*period, team, opp]))


def ordered_pairs(numbered: DataFrame, keys: Sequence[str], x: str, rank: str, size: str) -> DataFrame:
    """Pair sums of i before j inside a group, from each row's 0-based rank and the group size."""
    v, r, after = F.col(x), F.col(rank), F.col(size) - 1 - F.col(rank)
    g = numbered.groupBy(*keys).agg(
        F.count(v).alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("q"),
        F.sum(v * after).alias("sx"), F.sum(v * r).alias("sy"),
        F.sum(v * v * after).alias("sxx"), F.sum(v * v * r).alias("syy"),
    )
    m, s = F.col("m"), F.col("s")
    return g.select((m * (m - 1) / 2).cast("double").alias("n"), "sx", "sy", "sxx", "syy",
                    ((s * s - F.col("q")) / 2).alias("sxy"))


def pair_correlation(pairs: DataFrame, group: Sequence[str] = (), min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Correlation from pair sums; zero where there are too few pairs."""
    t = pairs.groupBy(*group).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMS])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cov = n * F.col("sxy") - sx * sy
    spread = F.sqrt((n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy))
    rho = F.when(n >= min_pairs, F.coalesce(F.try_divide(cov, spread), F.lit(0.0))).otherwise(F.lit(0.0))
    return t.select(*group, n.cast("bigint").alias("n_pairs"), rho.alias("rho"))


def estimate_relations(resid: DataFrame, value: str = "residual", min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Residual correlation of each of the six relationship classes, listed even without pairs."""
    from .ordered import row_numbers

    sides = ["season", "week", "recent_team", "opponent_team", "position", "player_id", value]
    resid = stored(resid.where(F.col("position").isin("QB", "RB", *PASS_CATCHERS)).select(*sides))
    qb = resid.where(F.col("position") == "QB")
    pc = resid.where(F.col("position").isin(*PASS_CATCHERS))
    rb = resid.where(F.col("position") == "RB")
    team = ["season", "week", "recent_team"]
    numbered = row_numbers(pc.select(*team, "player_id", value), team, [F.col("player_id").asc()], "__rn")
    sized = numbered.withColumn("__r", F.col("__rn") - 1).join(numbered.groupBy(*team).agg(F.count("*").alias("__size")), team)
    classes = {
        "qb_pc": cross_pairs(qb, pc, team, value),
        "pc_pc": ordered_pairs(sized, team, value, "__r", "__size"),
        "rb_pc": cross_pairs(rb, pc, team, value),
        "qb_rb": cross_pairs(qb, rb, team, value),
        "opp_qb_pc": mirrored_pairs(qb, pc, ["season", "week"], "recent_team", "opponent_team", value),
        "opp_pc_pc": mirrored_pairs(pc, pc, ["season", "week"], "recent_team", "opponent_team", value),
    }
    nothing = F.array(*[F.struct(F.lit(c).alias("relation"), *[F.lit(0.0).alias(s) for s in SUMS]) for c in classes])
    pairs = resid.sparkSession.range(1).select(F.inline(nothing))
    for name, p in classes.items():
        pairs = pairs.unionByName(p.withColumn("relation", F.lit(name)))
    return pair_correlation(pairs, ["relation"], min_pairs)
