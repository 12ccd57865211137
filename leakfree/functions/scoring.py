"""Configurable scoring as generated Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import round_even, step_table, zero_if_null

# Weight of every scoring rule when a league does not say otherwise.
RULE_DEFAULTS: dict[str, float] = {
    "pass_yd": 0.04, "pass_td": 4.0, "interception": -2.0,
    "rush_yd": 0.1, "rush_td": 6.0,
    "reception": 1.0, "rec_yd": 0.1, "rec_td": 6.0, "te_reception_bonus": 0.0,
    "fumble_lost": -2.0, "two_pt": 2.0, "special_teams_td": 6.0,
    "fg_0_39": 3.0, "fg_40_49": 4.0, "fg_50_plus": 5.0, "pat": 1.0, "fg_miss": 0.0,
    "dst_sack": 1.0, "dst_int": 2.0, "dst_fumble_rec": 2.0, "dst_td": 6.0,
    "dst_safety": 2.0, "dst_block": 2.0,
    "bonus_rush_100": 0.0, "bonus_rec_100": 0.0, "bonus_pass_300": 0.0,
}

# Named rule sets, as differences from the defaults.
PRESET_CHANGES: dict[str, dict[str, float]] = {
    "ppr": {},
    "half": {"reception": 0.5},
    "standard": {"reception": 0.0},
}

# Which weekly stat columns each linear rule weighs.
STATS_BY_RULE: dict[str, tuple[str, ...]] = {
    "pass_yd": ("passing_yards",),
    "pass_td": ("passing_tds",),
    "interception": ("interceptions",),
    "rush_yd": ("rushing_yards",),
    "rush_td": ("rushing_tds",),
    "reception": ("receptions",),
    "rec_yd": ("receiving_yards",),
    "rec_td": ("receiving_tds",),
    "fumble_lost": ("rushing_fumbles_lost", "receiving_fumbles_lost", "sack_fumbles_lost"),
    "two_pt": ("passing_2pt_conversions", "rushing_2pt_conversions", "receiving_2pt_conversions"),
    "special_teams_td": ("special_teams_tds",),
}

# Once-per-row bonuses (rule, stat, threshold).
THRESHOLD_BONUSES = (
    ("bonus_rush_100", "rushing_yards", 100),
    ("bonus_rec_100", "receiving_yards", 100),
    ("bonus_pass_300", "passing_yards", 300),
)

# Points for points allowed (upper bound, points) and for more than the last bound.
ALLOWED_STEPS = ((0, 10.0), (6, 7.0), (13, 4.0), (20, 1.0), (27, 0.0), (34, -1.0))
ALLOWED_BEYOND = -4.0

# Weekly columns per kicking distance and per defensive rule.
KICK_BUCKETS: dict[str, tuple[str, ...]] = {
    "fg_0_39": ("fg_made_0_19", "fg_made_20_29", "fg_made_30_39"),
    "fg_40_49": ("fg_made_40_49",),
    "fg_50_plus": ("fg_made_50_59", "fg_made_60_", "fg_made_60_plus"),
}
KICK_BUCKET_MARKERS = ("fg_made_0_19", "fg_made_40_49", "fg_made_50_59")
DEFENCE_STATS: dict[str, str] = {
    "dst_sack": "def_sacks",
    "dst_int": "def_interceptions",
    "dst_fumble_rec": "def_fumbles_recovered",
    "dst_td": "def_tds",
    "dst_safety": "def_safeties",
    "dst_block": "def_blocks",
}


def resolve_rules(preset: str | None = "ppr", custom: Mapping[str, float] | None = None) -> dict:
    """A full rule set from a preset name or from a custom subset (unknown keys are ignored)."""
    if custom:
        known = {k: float(v) for k, v in custom.items() if k in RULE_DEFAULTS}
        return {**RULE_DEFAULTS, **known}
    return {**RULE_DEFAULTS, **PRESET_CHANGES.get((preset or "ppr").lower(), {})}


PPR = resolve_rules("ppr")
HALF = resolve_rules("half")
STANDARD = resolve_rules("standard")


def rules_label(rules: Mapping[str, float]) -> str:
    """The preset a rule set equals, or ``custom``."""
    for name in PRESET_CHANGES:
        if dict(rules) == resolve_rules(name):
            return name
    return "custom"


def rules_label_column(rules: Mapping[str, Column]) -> Column:
    """``rules_label`` for rule sets held in columns, one league per row."""
    label = F.lit("custom")
    for name in reversed(list(PRESET_CHANGES)):
        same = F.lit(True)
        for rule, weight in resolve_rules(name).items():
            same = same & (rules[rule] == F.lit(weight))
        label = F.when(same, F.lit(name)).otherwise(label)
    return label


def _stat(df: DataFrame, name: str) -> Column | None:
    return zero_if_null(name) if name in df.columns else None


def _weighted(df: DataFrame, stats: tuple[str, ...], weight) -> Column | None:
    terms = [s for s in (_stat(df, n) for n in stats) if s is not None]
    if not terms:
        return None
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total * (weight if isinstance(weight, Column) else F.lit(weight))


def _add(terms: list[Column | None]) -> Column:
    present = [t for t in terms if t is not None]
    if not present:
        return F.lit(0.0)
    total = present[0]
    for t in present[1:]:
        total = total + t
    return total


def _is_off(weight) -> bool:
    return not isinstance(weight, Column) and weight == 0


def skill_points(df: DataFrame, rules: Mapping = PPR) -> Column:
    """Points of a weekly row: linear stats, position bonus, threshold bonuses; two decimals.

    ``rules`` holds numbers (folded into the plan) or Columns (one rule set per row). A stat
    column the frame does not have counts as zero, as does a null.
    """
    terms = [_weighted(df, stats, rules[rule]) for rule, stats in STATS_BY_RULE.items()]
    if not _is_off(rules["te_reception_bonus"]) and {"position", "receptions"} <= set(df.columns):
        bonus = rules["te_reception_bonus"]
        bonus = bonus if isinstance(bonus, Column) else F.lit(bonus)
        terms.append(F.when(F.col("position") == "TE", zero_if_null("receptions") * bonus).otherwise(0.0))
    for rule, stat, threshold in THRESHOLD_BONUSES:
        if not _is_off(rules[rule]) and stat in df.columns:
            bonus = rules[rule]
            bonus = bonus if isinstance(bonus, Column) else F.lit(bonus)
            terms.append(F.when(zero_if_null(stat) >= threshold, bonus).otherwise(0.0))
    return round_even(_add(terms), 2)


def kicker_points(df: DataFrame, rules: Mapping = PPR) -> Column:
    """Kicker points: the distance ladder if the frame carries buckets, else a flat made-kick value."""
    if any(c in df.columns for c in KICK_BUCKET_MARKERS):
        made = [_weighted(df, cols, rules[rule]) for rule, cols in KICK_BUCKETS.items()]
    else:
        made = [_weighted(df, ("fg_made",), rules["fg_0_39"])]
    extra = [_weighted(df, ("pat_made",), rules["pat"]), _weighted(df, ("fg_missed",), rules["fg_miss"])]
    return round_even(_add(made + extra), 2)


def defence_points(df: DataFrame, rules: Mapping = PPR) -> Column:
    """Defence points: weighted counts plus the points-allowed step (unknown counts as zero allowed)."""
    terms = [_weighted(df, (stat,), rules[rule]) for rule, stat in DEFENCE_STATS.items()]
    if "points_allowed" in df.columns:
        terms.append(step_table(zero_if_null("points_allowed"), ALLOWED_STEPS, ALLOWED_BEYOND))
    return round_even(_add(terms), 2)


def with_points(df: DataFrame, rules: Mapping = PPR, out: str = "fp") -> DataFrame:
    return df.withColumn(out, skill_points(df, rules))


def with_points_per_rule_set(df: DataFrame, rule_sets: Mapping[str, Mapping], out: str = "fp") -> DataFrame:
    """One output row per input row and rule set, from a single scan and without a join."""
    scored = F.array(*[
        F.struct(F.lit(name).alias("rules"), skill_points(df, rules).alias(out))
        for name, rules in rule_sets.items()
    ])
    return df.select("*", F.inline(scored))
