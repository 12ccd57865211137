"""Small Column helpers: rounding, null policies, bins, code translation, dates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even on the binary value (scale, ``rint``, unscale)."""
    scale = float(10**digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def clip(c: Column | str, low=None, high=None) -> Column:
    """Bound a value and keep nulls null (``greatest``/``least`` alone would skip them)."""
    value = col(c)
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """Division that is null when the denominator is zero or null."""
    return F.try_divide(col(num), col(den))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Aggregate correlation that is null, rather than an error, where a side is constant."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def null_if_nan(c: Column | str) -> Column:
    value = col(c)
    return F.when(~F.isnan(value), value)


def flag(condition: Column) -> Column:
    """A condition as 0/1; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def order_key(season: Column | str = "season", period: Column | str = "week") -> Column:
    """One increasing key for a (season, period) pair."""
    return col(season) * 100 + col(period)


def one_hot(df: DataFrame, column: str, values: Iterable[str], prefix: str = "is_") -> DataFrame:
    return df.withColumns({f"{prefix}{v}": flag(F.col(column) == v) for v in values})


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate column the frame has; decided while planning, never per row."""
    have = set(df.columns)
    return next((c for c in candidates if c in have), None)


def coalesce_present(df: DataFrame, candidates: Sequence[str], cast: str = "string") -> Column:
    """Coalesce whichever of the candidate columns exist (schema eras side by side)."""
    have = [F.col(c).cast(cast) for c in candidates if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(cast)


def translate(c: Column | str, codes: Mapping[str, str], keep_unknown: bool = True) -> Column:
    """Map codes to labels; unknown codes stay as they are or become null."""
    value = col(c)
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    hit = F.element_at(table, value)
    return F.coalesce(hit, value) if keep_unknown else hit


def bin_index(c: Column | str, edges: Sequence[float], missing: int = -1) -> Column:
    """Index of the right-open bin: the number of edges at or below the value."""
    value = col(c)
    reached = sum((F.when(value >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(value.isNull(), F.lit(missing)).otherwise(reached).cast("int")


def step_table(c: Column | str, steps: Sequence[tuple[float, float]], otherwise: float) -> Column:
    """Value of the first step whose upper bound is not exceeded."""
    value = col(c)
    ladder = None
    for upper, points in steps:
        hit = value <= F.lit(upper)
        ladder = F.when(hit, F.lit(points)) if ladder is None else ladder.when(hit, F.lit(points))
    return ladder.otherwise(F.lit(otherwise))


def season_label(date: Column | str, first_month: int = 9) -> Column:
    """Seasons carry the year they start in; months before ``first_month`` belong to the last one."""
    d = col(date)
    return F.when(F.month(d) >= first_month, F.year(d)).otherwise(F.year(d) - 1)


def upcoming_season_label(date: Column | str, first_month: int = 9) -> Column:
    """The running season once it has begun, else the one about to begin."""
    d = col(date)
    return F.when(F.month(d) >= first_month, season_label(d, first_month)).otherwise(
        season_label(d, first_month) + 1
    )


def hash_unit(*parts: Column | str) -> Column:
    """A reproducible number in [0, 1] from the first 32 bits of an md5 over the joined parts."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967295.0)


def hash_jitter(name: Column | str, team: Column | str, scale: float) -> Column:
    """Reproducible noise in [-scale, scale] for a (name, team) pair."""
    return (hash_unit(name, team) - 0.5) * 2 * F.lit(float(scale))
