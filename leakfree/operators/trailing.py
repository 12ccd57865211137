"""Trailing windows that never see the current row.

Entity windows here run on frames with at most one row per (entity, period), so a window partition
holds no more rows than the calendar has periods. For entities with an unbounded history
:func:`trailing_mean_chunked` splits the history and carries over only the last rows of each chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import order_key, round_even
from .ordered import top_per_group

ORDER = ("season", "week")


def _mean(c: str, w, min_rows: int) -> Column:
    mean = F.avg(c).over(w)
    return F.when(F.count(c).over(w) >= min_rows, mean) if min_rows > 1 else mean


def trailing_columns(cols: Sequence[str], windows: Sequence[int], entity: Sequence[str],
                     order: Sequence[str] = ORDER, min_rows: int = 1,
                     suffix: str = "_r{n}") -> dict[str, Column]:
    """Means of the ``n`` rows before the current one; all columns share one partitioning and sort."""
    base = Window.partitionBy(*entity).orderBy(*order)
    return {
        c + suffix.format(n=n): _mean(c, base.rowsBetween(-n, -1), min_rows) for n in windows for c in cols
    }


def trailing_mean(df: DataFrame, cols: Sequence[str], windows: Sequence[int],
                  entity: Sequence[str] = ("player_id",), order: Sequence[str] = ORDER,
                  min_rows: int = 1, suffix: str = "_r{n}") -> DataFrame:
    return df.withColumns(trailing_columns(cols, windows, entity, order, min_rows, suffix))


def trailing_mean_chunked(df: DataFrame, cols: Sequence[str], windows: Sequence[int], entity: Sequence[str],
                          order: Sequence[str], chunk: str, min_rows: int = 1, suffix: str = "_r{n}") -> DataFrame:
    """:func:`trailing_mean` for entities of any size: windows run per (entity, chunk).

    ``chunk`` must grow with ``order``. Each chunk borrows the rows just before it; they are found
    among the last ``max(windows)`` rows of every chunk, which Spark prunes before shuffling.
    """
    depth = max(windows)
    carried = [*order, *cols]
    tails = top_per_group(
        df.select(*entity, chunk, *[c for c in carried if c not in (*entity, chunk)]),
        [*entity, chunk], [F.col(o).desc() for o in order], depth, "__back",
    )
    in_chunk = Window.partitionBy(*entity, chunk)
    earlier = Window.partitionBy(*entity).orderBy(*order).rowsBetween(-depth, -1)
    plain = [c for c in dict.fromkeys(carried) if c not in (*entity, chunk)]
    halo = (
        tails.withColumn("__first", F.col("__back") == F.max("__back").over(in_chunk))
        .withColumn("__prev", F.collect_list(F.struct(*plain)).over(earlier))
        .where("__first").select(*entity, chunk, F.posexplode("__prev").alias("__place", "__row"))
        .select(*entity, chunk, "__place", "__row.*").withColumn("__halo", F.lit(True))
    )
    whole = df.withColumn("__halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    borrowed_first = [F.col("__halo").desc(), F.col("__place"), *[F.col(o) for o in order]]
    base = Window.partitionBy(*entity, chunk).orderBy(*borrowed_first)
    made = {c + suffix.format(n=n): _mean(c, base.rowsBetween(-n, -1), min_rows) for n in windows for c in cols}
    return whole.withColumns(made).where(~F.col("__halo")).drop("__halo", "__place")


def allowed_form(scored: DataFrame, windows: Sequence[int], value: str = "fp") -> DataFrame:
    """What each opponent allowed to each position, as trailing means entering the period."""
    keys = ["opponent_team", "position", "season", "week"]
    allowed = scored.groupBy(*keys).agg(F.sum(value).alias(f"def_{value}_allowed"))
    out = trailing_mean(allowed, [f"def_{value}_allowed"], windows, ("opponent_team", "position"))
    return out.select(*keys, *[f"def_{value}_allowed_r{n}" for n in windows])


def form_before(scored: DataFrame, entity: str, cut: int, window: int, value: str = "fp", active_since: int | None = None,
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """Mean of the last ``window`` rows strictly before ``cut``, for entities active since a season."""
    prior = scored.where(order_key() < cut)
    if active_since is not None:
        live = prior.groupBy(entity).agg(F.max("season").alias("__last")).where(F.col("__last") >= active_since)
        prior = prior.join(live, entity, "left_semi")
    recent = top_per_group(prior, [entity], [F.col(c).desc() for c in ("season", "week", *tiebreak)], window)
    return recent.groupBy(entity).agg(round_even(F.avg(value), 2).alias("pred"))


def running_mean(value: str, entity: Sequence[str], order: Sequence[str] = ORDER) -> Column:
    """Mean through the current row."""
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.avg(value).over(w)


def absence_streaks(df: DataFrame, entity: str, period: str, last_period: Column, injured_after: int = 2) -> DataFrame:
    """Per entity and period since its first appearance: how many periods it has been away.

    Absent periods are generated from the gap to the next appearance, so no entity x period grid
    is built. ``injured`` marks streaks of at least ``injured_after`` periods.
    """
    w = Window.partitionBy(entity).orderBy(period)
    upto = F.coalesce(F.lead(period).over(w) - 1, last_period)
    rows = df.select(entity, period).distinct().withColumn("__upto", upto)
    spread = rows.select(entity, F.col(period).alias("__seen"), F.explode(F.sequence(period, F.greatest("__upto", period))).alias(period))
    streak = F.col(period) - F.col("__seen")
    return spread.select(entity, period, streak.cast("int").alias("absent_streak"), (streak >= injured_after).alias("injured"))


def seed_unseen(value: str, prior: str, entity: Sequence[str], order: Sequence[str] = ORDER) -> Column:
    """The value, or the prior for entities that have never had a value before this row."""
    before = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.col(value).isNotNull()).over(before)
    return F.coalesce(F.col(value), F.when(~F.coalesce(seen, F.lit(False)), F.col(prior)))


def last_k_sequences(df: DataFrame, stats: Sequence[str], k: int, scale: Mapping[str, tuple[Column, Column]],
                     entity: Sequence[str] = ("player_id",), order: Sequence[str] = ORDER, out: str = "sequence") -> DataFrame:
    """The last ``k`` earlier rows per row, standardised, oldest first and zero-padded on the left."""
    z = []
    for s in stats:
        mean, sd = scale[s]
        width = F.when(sd < 1e-6, 1.0).otherwise(sd)
        z.append(F.coalesce((F.col(s) - mean) / width, F.lit(0.0)))
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(-k, -1)
    seen = F.collect_list("__z").over(w)
    blank = F.array_repeat(F.array_repeat(F.lit(0.0), len(stats)), F.lit(k) - F.size("__seen"))
    return df.withColumn("__z", F.array(*z)).withColumn("__seen", seen).withColumn(
        out, F.concat(blank, F.col("__seen"))
    ).drop("__z", "__seen")


def train_scale(train: DataFrame, stats: Sequence[str]) -> dict[str, tuple[Column, Column]]:
    """Mean and population deviation of each stat over the training rows, as scalar subqueries."""
    one = train.agg(F.struct(*[
        F.struct(F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd")).alias(s) for s in stats
    ]).alias("scale")).scalar()
    return {s: (one[s]["mean"], one[s]["sd"]) for s in stats}
