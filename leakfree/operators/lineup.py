"""Slot assignment for all (team, period) groups at once.

Slots are filled from the most restrictive class to the widest; each takes the best unused eligible
entity. The number of passes is the number of slot classes, and all passes share one partitioning
and one sort: a pass is a running count over the same window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordered import ordered_prefix

# Which positions a flexible slot takes, from narrow to wide.
FLEX_CLASSES: dict[str, tuple[str, ...]] = {
    "WRTE": ("WR", "TE"),
    "RBWR": ("RB", "WR"),
    "FLEX": ("RB", "WR", "TE"),
    "SUPERFLEX": ("QB", "RB", "WR", "TE"),
}
PURE = ("QB", "RB", "WR", "TE", "DEF", "K")


@dataclass(frozen=True)
class Slots:
    """How many starters a lineup takes per position and per flexible class."""

    pure: Mapping[str, int] = field(default_factory=lambda: {"QB": 1, "RB": 2, "WR": 3, "TE": 1})
    flex: Mapping[str, int] = field(default_factory=lambda: {"FLEX": 1})

    @classmethod
    def from_lineup(cls, lineup: Mapping | None) -> Slots:
        """From a league's ``{"starters": {...}, "flex": n, ...}``; empty falls back to the default."""
        if not lineup:
            return cls()
        starters = lineup.get("starters") or {}
        pure = {p: int(starters.get(p) or 0) for p in PURE if starters.get(p)}
        flex = {c: int(lineup.get(c.lower()) or 0) for c in FLEX_CLASSES if lineup.get(c.lower())}
        return cls(pure, flex) if pure or flex else cls()

    def reach(self, position: str) -> int:
        """The most entities of a position a lineup can start."""
        wide = sum(n for c, n in self.flex.items() if position in FLEX_CLASSES[c])
        return self.pure.get(position, 0) + wide

    def total(self) -> int:
        return sum(self.pure.values()) + sum(self.flex.values())


DEFAULT = Slots()
STANDARD = Slots({"QB": 1, "RB": 2, "WR": 2, "TE": 1, "DEF": 1, "K": 1}, {"FLEX": 1})


def _prune(roster: DataFrame, group: Sequence[str], order: Sequence[Column], slots: Slots, position: str) -> DataFrame:
    """Drop entities no slot can reach: Spark prunes each map task to ``reach`` rows per position."""
    deepest = max((slots.reach(p) for p in PURE), default=0)
    w = Window.partitionBy(*group, position).orderBy(*order)
    ranked = roster.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= deepest)
    allowed = F.lit(False)
    for p in PURE:
        if slots.reach(p):
            allowed = allowed | ((F.col(position) == p) & (F.col("__rn") <= slots.reach(p)))
    return ranked.where(allowed).drop("__rn")


def assign_slots(roster: DataFrame, group: Sequence[str], value: str, ident: str, slots: Slots = DEFAULT,
                 position: str = "position", out: str = "slot") -> DataFrame:
    """The starters of every group with the slot each one fills.

    Best means the largest value, then the smallest id; an unknown value sorts last.
    """
    order = [F.coalesce(F.col(value), F.lit(-1.0)).desc(), F.col(ident).asc()]
    rows = _prune(roster, group, order, slots, position)
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    slot = F.lit(None).cast("string")
    for p, n in slots.pure.items():
        mine = F.col(position) == p
        slot = F.when(mine & (F.sum(mine.cast("int")).over(w) <= n), F.lit(p)).otherwise(slot)
    rows = rows.withColumn(out, slot)
    for c, who in FLEX_CLASSES.items():
        n = slots.flex.get(c, 0)
        if n:
            free = F.col(out).isNull() & F.col(position).isin(*who)
            take = free & (F.sum(free.cast("int")).over(w) <= n)
            rows = rows.withColumn(out, F.when(take, F.lit(c)).otherwise(F.col(out)))
    return rows.where(F.col(out).isNotNull())


def score_locked(roster: DataFrame, group: Sequence[str], projection: str, actual: str, ident: str, slots: Slots) -> DataFrame:
    """Points of the lineup locked on projections, and the bench points left over.

    The bench is everything that is not a starter, so its total is the roster total minus the
    starters' total: the roster is only aggregated, never sorted.
    """
    started = assign_slots(roster, group, projection, ident, slots).groupBy(*group).agg(
        F.sum(F.coalesce(actual, F.lit(0.0))).alias("score"), F.count("*").alias("starters"))
    whole = roster.groupBy(*group).agg(F.sum(F.coalesce(actual, F.lit(0.0))).alias("__all"))
    return whole.join(started, list(group), "left").select(
        *group, F.coalesce("score", F.lit(0.0)).alias("score"),
        (F.col("__all") - F.coalesce("score", F.lit(0.0))).alias("bench"),
        F.coalesce("starters", F.lit(0)).alias("starters"),
    )


def _leading(teams: DataFrame, marks: DataFrame, free_agents: DataFrame, keys: Sequence[str], pool: Sequence[str], value: str,
             ident: str, top: int) -> DataFrame:
    """The ``top`` best free agents of each position above, at and below each value of a team."""
    group = [*pool, "__cpos"]
    offered = free_agents.select(
        *pool, F.col("position").alias("__cpos"), F.coalesce(F.col(value), F.lit(-1.0)).alias("__worth"), F.lit(1).alias("__kind"),
        F.col(ident).alias("__cand"), F.col(value).alias("__cval"))
    positions = stored(offered.select(*group).distinct(), "positions")
    # a value stands once before (0) and once behind (2) the free agents (1) that are worth as much
    none = [F.lit(None).cast(offered.schema[c].dataType).alias(c) for c in ("__cand", "__cval")]
    values = marks.select(*pool, "__worth").distinct().join(positions, list(pool))
    points = offered.unionByName(values.select(*group, "__worth", F.explode(F.array(F.lit(0), F.lit(2))).alias("__kind"), *none))
    placed = stored(ordered_prefix(
        points, group, [F.col("__worth").desc(), F.col("__kind").asc(), F.col("__cand").asc()], {"__at": (F.col("__kind") == 1).cast("long")}), "placed")
    bounds = placed.where(F.col("__kind") != 1).select(*group, "__worth", "__kind", "__at")
    # a team's intervals begin at the best free agent and at its values' places
    first = teams.join(positions, list(pool)).select(
        *keys, "__cpos", F.lit(None).cast("double").alias("__worth"), F.lit(-1).alias("__kind"), F.lit(0).cast("long").alias("__at"))
    begins = first.unionByName(marks.join(bounds, [*pool, "__worth"]).select(*first.columns))
    along = Window.partitionBy(*keys, "__cpos").orderBy("__at", F.col("__worth").desc_nulls_first(), "__kind")
    until = F.coalesce(F.least(F.lead("__at").over(along), F.col("__at") + top), F.col("__at") + top)
    numbers = begins.withColumn("__until", until).where(F.col("__until") > F.col("__at")).select(
        *keys, "__cpos", F.explode(F.sequence(F.col("__at"), F.col("__until") - 1)).alias("__at"))
    agents = placed.where(F.col("__kind") == 1).select(*group, "__at", "__cand", "__cval")
    return numbers.join(agents, [*group, "__at"]).select(*keys, "__cand", "__cpos", "__cval")


def marginal_gain(roster: DataFrame, free_agents: DataFrame, team: Sequence[str], pool: Sequence[str], value: str,
                  ident: str, slots: Slots = DEFAULT, top: int = 15, min_gain: float = 1e-6) -> DataFrame:
    """Free agents by how much each would add to a team's best lineup, and whom it would displace.

    ``pool`` names the keys (a league or period) that teams and free agents share. Every free agent of the
    pool is a candidate. Between two neighbouring values of the team's rows that can reach a slot, the
    slots a candidate of a position leads to do not depend on its value, so its gain grows with it: the
    ``top`` best of each position and interval contain the ``top`` best overall, whatever the slot
    classes. Only those are tried. The free agents of a position are numbered once for all teams, best first, and the values of
    the teams are placed among them, so no free agent meets a team it is not tried for. Each trial adds a candidate to the team's
    starters and their runners-up, at most a few dozen rows.
    """
    keys = [*pool, *team]
    order = [F.coalesce(F.col(value), F.lit(-1.0)).desc(), F.col(ident).asc()]
    core = stored(_prune(roster.select(*keys, ident, "position", value), keys, order, slots, "position"), "core")
    base = assign_slots(core, keys, value, ident, slots)
    base_totals = base.groupBy(*keys).agg(
        F.sum(value).alias("__base"), F.collect_set(ident).alias("__started"))
    marks = core.select(*keys, F.coalesce(F.col(value), F.lit(-1.0)).alias("__worth")).distinct()
    tried = stored(_leading(stored(roster.select(*keys).distinct(), "teams"), marks, free_agents, keys, pool, value, ident, top), "tried")
    # a trial's rows are made where it is, so that only the candidates move
    rosters = stored(core.groupBy(*keys).agg(F.collect_list(F.struct(ident, "position", value)).alias("__core")), "rosters")
    own = F.array(F.struct(F.col("__cand").alias(ident), F.col("__cpos").alias("position"), F.col("__cval").alias(value)))
    augmented = tried.repartition(*keys, "__cand").join(rosters, keys, "left").select(
        *keys, "__cand", F.inline(F.concat(F.coalesce("__core", F.array().cast(rosters.schema["__core"].dataType)), own)))
    new = assign_slots(augmented, [*keys, "__cand"], value, ident, slots)
    new_totals = new.groupBy(*keys, "__cand").agg(F.sum(value).alias("__new"), F.collect_set(ident).alias("__now"))
    gains = (
        new_totals.join(base_totals, keys, "left")
        # sums in another order differ in the last bits; equal gains must stay equal
        .withColumn("gain", F.round(F.col("__new") - F.coalesce("__base", F.lit(0.0)), 9)).where(F.col("gain") > min_gain)
        .withColumn("replaces", F.array_min(F.array_except(F.coalesce("__started", F.array().cast("array<string>")), F.col("__now"))))
    )
    w = Window.partitionBy(*keys).orderBy(F.col("gain").desc(), F.col("__cand").asc())
    return gains.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(
        *keys, F.col("__cand").alias(ident), "gain", "replaces", "place")
