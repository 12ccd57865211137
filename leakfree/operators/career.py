"""Multi-season views of an entity: decayed means, cumulative stats, peaks, weekly shape.

All windows run on entity-season rows, so a partition is bounded by the number of seasons.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip

CAREER_DECAY = 0.6
# A career high counts from this load on, over a peak of at least this size.
HIGH_LOAD, ESTABLISHED_LOAD = 250, 50


def through(entity: Sequence[str] = ("player_id",), season: str = "season"):
    return Window.partitionBy(*entity).orderBy(season).rowsBetween(Window.unboundedPreceding, 0)


def with_decayed_means(df: DataFrame, values: Mapping[str, Column | str], entity: Sequence[str] = ("player_id",),
                       season: str = "season", decay: float = CAREER_DECAY) -> DataFrame:
    """Add, per output name, the mean through the current season with weight ``decay ** season's age``.

    The factor of the current season cancels, which leaves two cumulative sums instead of a
    self-join; ages count from the entity's first season so the powers stay small.
    """
    w = through(entity, season)
    cols = {k: (F.col(v) if isinstance(v, str) else v) for k, v in values.items()}
    weight = F.pow(F.lit(decay), -(F.col(season) - F.col("__s0")).cast("double"))
    base = df.withColumn("__s0", F.min(season).over(w)).withColumn("__w", weight)
    return base.withColumns({
        name: F.sum(v * F.col("__w")).over(w) / F.sum("__w").over(w) for name, v in cols.items()
    }).drop("__s0", "__w")


def career_features(agg: DataFrame) -> DataFrame:
    """Career form, durability and trend through each season (rows: entity-season totals)."""
    w, o = through(), Window.partitionBy("player_id").orderBy("season")
    base = agg.withColumn("ppg", F.col("fp") / F.greatest(F.col("games"), F.lit(1)))
    out = with_decayed_means(base, {
        "c_fp_wavg": "fp", "c_ppg_wavg": "ppg", "c_tgt_share_wavg": F.coalesce("tgt_share", F.lit(0.0)),
    })
    return out.select(
        "player_id", "season", "c_fp_wavg", "c_ppg_wavg", "c_tgt_share_wavg",
        F.avg("games").over(w).alias("c_games_avg"), F.min("games").over(w).alias("c_games_min"),
        F.count("*").over(w).cast("int").alias("c_seasons"),
        F.coalesce(F.col("fp") - F.lag("fp").over(o), F.lit(0.0)).alias("c_fp_trend"),
        F.max("fp").over(w).alias("c_best_fp"),
    )


def weekly_shape(scored: DataFrame, value: str = "fp", decimals: int | None = None) -> DataFrame:
    """Ceiling, floor, spike share and deviation of the weeks of each entity-season.

    The collected weeks of one entity-season are bounded by the length of a season. With ``decimals`` the values are whole
    multiples of that decimal place and are summed as such, so that the result does not depend on the order of the rows.
    """
    weeks = F.sort_array(F.col("__v"), asc=False)
    unit = 1.0 if decimals is None else float(10**decimals)
    x = F.col(value) if decimals is None else F.round(F.col(value) * unit).cast("long")

    def mean(a: Column) -> Column:
        zero = F.lit(0.0) if decimals is None else F.lit(0).cast("long")
        return F.aggregate(a, zero, lambda acc, v: acc + v).cast("double") / F.size(a) / unit

    n, total = F.count(x), F.sum(x)
    spread = F.stddev_pop(x) if decimals is None else F.sqrt((n * F.sum(x * x) - total * total).cast("double")) / n
    g = scored.groupBy("player_id", "season").agg(
        F.collect_list(x).alias("__v"), total.alias("__t"), n.alias("__n"), F.avg(x).alias("__m"), (spread / unit).alias("__sd"))
    high = (lambda v: v >= 1.5 * F.col("__m")) if decimals is None else (lambda v: v * F.col("__n") * 2 >= F.col("__t") * 3)
    spikes = F.size(F.filter("__v", high)) / F.size("__v")
    bottom = F.slice(weeks, F.greatest(F.size(weeks) - 2, F.lit(1)), F.lit(3))
    return g.select(
        "player_id", "season", mean(F.slice(weeks, 1, 3)).alias("ceiling"), mean(bottom).alias("floor"),
        F.when(F.col("__t") > 0, spikes).otherwise(0.0).alias("boom"), F.coalesce("__sd", F.lit(0.0)).alias("stdev"),
    )


def upside_features(scored: DataFrame, value: str = "fp") -> DataFrame:
    """Decayed career means of the weekly shape."""
    shape = weekly_shape(scored, value)
    names = {"u_ceiling": "ceiling", "u_floor": "floor", "u_boom": "boom", "u_stdev": "stdev"}
    return with_decayed_means(shape, names).select("player_id", "season", *names)


def next_season(agg: DataFrame, value: str) -> DataFrame:
    """Value of the following season where the entity played in it."""
    o = Window.partitionBy("player_id").orderBy("season")
    consecutive = F.lead("season").over(o) == F.col("season") + 1
    return agg.withColumn(f"next_{value}", F.when(consecutive, F.lead(value).over(o)))


def career_high(loads: DataFrame, target_season: int | Column, load: str = "touches") -> DataFrame:
    """Entities whose season before the target set a career high in load.

    Only entities active in that season are listed; a debut never counts as a high.
    """
    prior = (F.lit(target_season) if isinstance(target_season, int) else target_season) - 1
    before = Window.partitionBy("player_id").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    peak = F.coalesce(F.max(load).over(before), F.lit(0.0))
    high = (peak >= ESTABLISHED_LOAD) & (F.col(load) >= HIGH_LOAD) & (F.col(load) >= peak)
    return loads.select("player_id", "season", load, high.alias("career_year")).where(F.col("season") == prior).select(
        "player_id", "career_year", F.rint(load).alias("prior_touches"))


def age_curves(agg: DataFrame, births: DataFrame, before_season: int | Column, positions: Sequence[str],
               ages: tuple[int, int] = (21, 36), min_games: int = 6, min_pairs: int = 8) -> DataFrame:
    """Relative value by age and position, by the delta method.

    The mean year-over-year change of the same entity is cumulated over ages and scaled to the peak,
    which avoids the bias of comparing only the survivors at old ages.
    """
    low, high = ages
    before = F.lit(before_season) if isinstance(before_season, int) else before_season
    played = agg.join(births, ["player_id", "season"]).where((F.col("season") < before) & (F.col("games") >= min_games))
    rates = played.select(
        "player_id", "season", "position", (F.col("season") - F.col("birth_year")).alias("age"),
        (F.col("fp") / F.greatest(F.col("games"), F.lit(1))).alias("ppg"),
    )
    ratio = clip(F.col("next_ppg") / F.greatest(F.col("ppg"), F.lit(1.0)), 0.4, 1.8)
    steps = (
        next_season(rates, "ppg").where(F.col("next_ppg").isNotNull() & F.col("age").between(low, high))
        .groupBy("position", "age").agg(F.avg(ratio).alias("m"), F.count("*").alias("c"))
        .where(F.col("c") >= min_pairs).select("position", (F.col("age") + 1).alias("age"), F.col("m").alias("step"))
    )
    spark = agg.sparkSession
    grid = spark.range(low, high + 1).select(
        F.explode(F.array(*[F.lit(p) for p in positions])).alias("position"), F.col("id").cast("int").alias("age")
    )
    upto = Window.partitionBy("position").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    log_step = F.ln(F.when(F.col("age") == low, 1.0).otherwise(F.coalesce("step", F.lit(1.0))))
    curve = grid.join(steps, ["position", "age"], "left").withColumn("rel", F.exp(F.sum(log_step).over(upto)))
    return curve.select("position", "age", (F.col("rel") / F.max("rel").over(Window.partitionBy("position"))).alias("curve"))
