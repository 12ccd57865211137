"""Temporal joins, entity resolution and table-presence helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expr import order_key
from ..functions.names import word_key


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frame itself, failing at run time if a key repeats (a left join must not fan out)."""
    checked = df.groupBy(*keys).agg(
        F.count("*").alias("__n"), *[F.first(c).alias(c) for c in df.columns if c not in keys]
    )
    guard = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"duplicate key {list(keys)}")).cast("boolean")).otherwise(True)
    return checked.where(guard).select(*df.columns)


def enrich(left: DataFrame, *tables: tuple[DataFrame, Sequence[str]], fill: Mapping | None = None, check: bool = False) -> DataFrame:
    """Left joins of feature tables that are unique on their keys; ``check`` makes a repeated key an error.

    Tables that an aggregation by the keys made are unique by construction and need no check, which costs an aggregation.
    """
    out = left
    for right, keys in tables:
        out = out.join(assert_unique(right, keys) if check else right, list(keys), "left")
    return out.fillna(dict(fill)) if fill else out


def crosswalk(facts: DataFrame, bridge: DataFrame, season: str, foreign: str, ident: str, values: Sequence[str],
              period: str = "week") -> DataFrame:
    """Facts under a foreign id moved to the library's id through a deduplicated bridge."""
    one = bridge.where(F.col(foreign).isNotNull() & F.col(ident).isNotNull()).groupBy(season, foreign).agg(
        F.min(ident).alias("player_id"))
    return facts.join(one, [season, foreign]).groupBy("player_id", season, period).agg(*[F.max(v).alias(v) for v in values])


def outer_merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of several frames on shared keys."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(keys), "full_outer")
    return out


def shift_season(df: DataFrame, by: int = 1, season: str = "season", out: str = "season") -> DataFrame:
    """The same rows seen from a later season."""
    return df.withColumn(out, F.col(season) + by)


def prior_year_strength(allowed: DataFrame, schedule: DataFrame) -> DataFrame:
    """Schedule strength: mean of what each scheduled opponent allowed the year before, by position."""
    prev = shift_season(allowed.withColumnRenamed("opponent_team", "opp"))
    met = schedule.join(prev, ["season", "opp"])
    return met.groupBy("team", "season", "position").agg(F.avg("allowed").alias("sos"))


def strictly_prior(history: DataFrame, entity: Sequence[str], value: str, targets: DataFrame, default: float,
                   out: str, decay: float = 0.6) -> DataFrame:
    """Decayed mean of all earlier seasons, per entity and target season (one of them yet unplayed).

    ``history`` has one row per entity and season. Each row is sent forward to the seasons after it,
    at most one row per calendar season, and summed there; entities with no history get the default.
    """
    span = targets.agg(F.struct(F.min("season").alias("lo"), F.max("season").alias("hi")).alias("s")).scalar()
    rows = history.withColumn("__span", span)
    ahead = rows.where(F.col("season") < F.col("__span.hi")).select(
        *entity, value, F.col("season").alias("__h"),
        F.explode(F.sequence(F.col("season") + 1, F.col("__span.hi"))).alias("season"),
    )
    weight = F.pow(F.lit(decay), (F.col("season") - F.col("__h")).cast("double"))
    known = ahead.groupBy(*entity, "season").agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias(out))
    grid = rows.select(*entity, F.explode(F.sequence("__span.lo", "__span.hi")).alias("season")).distinct()
    return grid.join(known, [*entity, "season"], "left").withColumn(out, F.coalesce(out, F.lit(default)))


def seasons_with_next(df: DataFrame, season: str = "season") -> DataFrame:
    """Every season present plus the one after the last."""
    return df.select(F.col(season).alias("season")).distinct().unionByName(
        df.agg((F.max(season) + 1).alias("season")))


def last_known(df: DataFrame, entity: str, values: Sequence[str], cut: int | Column | None = None,
               inclusive: bool = False, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The latest row before (or at) a cut, as one aggregation without sorting."""
    k = order_key()
    rows = df
    if cut is not None:
        rows = df.where(k <= cut if inclusive else k < cut)
    latest = F.max_by(F.struct(*values), F.struct(k, *[F.col(t) for t in tiebreak]))
    return rows.groupBy(entity).agg(latest.alias("__v")).select(entity, *[F.col(f"__v.{v}").alias(v) for v in values])


def best_match(df: DataFrame, key: str, value: str) -> DataFrame:
    """The smallest numeric value per key; rows that do not parse are dropped."""
    number = df.select(key, F.col(value).try_cast("double").alias(value))
    return number.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def without_names(df: DataFrame, taken: DataFrame, name: str = "player", taken_name: str = "player") -> DataFrame:
    """Rows whose loose name key is not among the taken names."""
    keys = taken.select(word_key(taken_name).alias("__k")).distinct()
    return df.withColumn("__k", word_key(name)).join(keys, "__k", "left_anti").drop("__k")


def match_names(names: DataFrame, board: DataFrame, name: str = "player", board_order: Sequence[Column] = (),
                board_name: str = "player") -> DataFrame:
    """Each listed name with the first board row under its loose key; misses have nulls and ``matched`` false."""
    values = [c for c in board.columns]
    order = F.struct(*board_order) if board_order else F.struct(*[F.col(c) for c in values])
    first = board.groupBy(word_key(board_name).alias("__k")).agg(F.min_by(F.struct(*values), order).alias("__b"))
    hit = names.withColumn("__k", word_key(name)).join(first, "__k", "left")
    return hit.select(*[F.col(c).alias(f"asked_{c}") for c in names.columns],
                      *[F.col(f"__b.{c}").alias(c) for c in values], F.col("__b").isNotNull().alias("matched"))


def resolve_entities(live: DataFrame, roster: DataFrame, values: Sequence[str]) -> DataFrame:
    """Attach player ids to feed rows: by trimmed id first, else by unambiguous (name key, position).

    Keys shared by several roster entries are dropped before joining. One row per player remains,
    the id match winning over the name match.
    """
    unique = roster.groupBy("name_key", "position").agg(
        F.min("player_id").alias("player_id"), F.count("*").alias("__n")
    ).where(F.col("__n") == 1)
    feed = live.withColumn("gsis_id", F.trim("gsis_id"))
    by_id = feed.join(unique.select(F.col("player_id").alias("gsis_id"), "player_id"), "gsis_id").select(
        "player_id", F.lit(0).alias("__how"), *values)
    by_name = feed.join(unique.select("player_id", "name_key", "position"), ["name_key", "position"]).select(
        "player_id", F.lit(1).alias("__how"), *values)
    both = by_id.unionByName(by_name)
    pick = F.min_by(F.struct("__how", *values), F.struct("__how", *values))
    return both.groupBy("player_id").agg(pick.alias("__v")).select(
        "player_id", (F.col("__v.__how") == 0).alias("by_id"), *[F.col(f"__v.{v}").alias(v) for v in values])


def seasons_started(weekly: DataFrame | None, wanted: DataFrame, calendar_season: Column | int | None = None) -> DataFrame:
    """Whether each wanted season has any regular row yet; without data the calendar decides."""
    if weekly is None:
        calendar = calendar_season if isinstance(calendar_season, Column) else F.lit(calendar_season)
        return wanted.select("season", F.coalesce(F.col("season") <= calendar, F.lit(False)).alias("started"))
    have = weekly.where(F.col("season_type") == "REG").select("season").distinct().withColumn("__have", F.lit(True))
    return wanted.join(have, "season", "left").select("season", F.coalesce("__have", F.lit(False)).alias("started"))


def optional_table(spark: SparkSession, name: str, schema: StructType | str) -> DataFrame:
    """A catalog table or view, or an empty frame with the given schema if it is absent."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def strict_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Paired differences a - b on keys that must match one to one; a key left over or repeated fails."""
    left = a.groupBy(*keys).agg(F.count("*").alias("__na"), *[F.first(v).alias(f"__a_{v}") for v in values])
    right = b.groupBy(*keys).agg(F.count("*").alias("__nb"), *[F.first(v).alias(f"__b_{v}") for v in values])
    both = left.join(right, list(keys), "full_outer")
    ok = F.coalesce((F.col("__na") == 1) & (F.col("__nb") == 1), F.lit(False))
    guard = F.when(ok, True).otherwise(F.raise_error(F.lit("pairs do not match one to one")).cast("boolean"))
    return both.where(guard).select(*keys, *[(F.col(f"__a_{v}") - F.col(f"__b_{v}")).alias(f"{v}_delta") for v in values])


def first_by(df: DataFrame, keys: Sequence[str], priority: Sequence[Column]) -> DataFrame:
    """One row per key, the first under a total order, by aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*priority)).alias("__v")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest])



