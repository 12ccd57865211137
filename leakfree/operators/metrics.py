"""Accuracy metrics, calibration, resampling, standings and experiment reductions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import clip, correlation
from ..session import stored
from .ordered import group_quantiles, null_safe_join, row_numbers, stacked_ranks
from .pools import tail_shares


def error_metrics(pred: DataFrame, actual: str = "fp", guess: str = "pred", group: Sequence[str] = ()) -> DataFrame:
    """Count, mean absolute error and root mean squared error."""
    e = F.col(guess) - F.col(actual)
    return pred.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def group_spearman(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation per group with mean ranks for ties; null where a side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    rows = df.where(both).select(*group, F.col(a).alias("__a"), F.col(b).alias("__b"))
    ranked = stacked_ranks(rows, {"__ra": (group, "__a"), "__rb": (group, "__b")}, descending=False, method="average")
    spread = [F.max(c) > F.min(c) for c in ("__a", "__b")]
    g = ranked.groupBy(*group).agg(
        F.count("*").alias("n"), correlation("__ra", "__rb").alias("__rho"), (spread[0] & spread[1]).alias("__ok"))
    return g.select(*group, "n", F.when(F.col("__ok"), F.col("__rho")).alias("spearman"))


def mean_spearman(df: DataFrame, group: Sequence[str], a: str, b: str, out: str = "weekly_spearman") -> DataFrame:
    """Mean of the per-group rank correlations."""
    return group_spearman(df, group, a, b).agg(F.avg("spearman").alias(out))


def interval_coverage(evaluated: DataFrame, pool: DataFrame, keys: Sequence[str], actual: str = "fp", guess: str = "pred") -> DataFrame:
    """Coverage of the 80 % and 50 % intervals of an earlier pool, and the mean share of it below.

    The share below counts pool residuals strictly smaller than the error.
    """
    names = ["__q10", "__q25", "__q75", "__q90"]
    bounds = group_quantiles(pool, keys, "residual", [0.10, 0.25, 0.75, 0.90], names)
    rows = evaluated.withColumn("__need", F.col(actual) - F.col(guess))
    rows = tail_shares(rows, pool, keys, "__need").join(bounds, list(keys))
    def within(lo: str, hi: str) -> Column:
        a, p = F.col(actual), F.col(guess)
        return F.avg(((a >= p + F.col(lo)) & (a <= p + F.col(hi))).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), within("__q10", "__q90").alias("cover80"),
        within("__q25", "__q75").alias("cover50"), F.avg("p_below").alias("mean_pit"))


def error_correlation(df: DataFrame, a: str, b: str, actual: str = "fp", group: Sequence[str] = ()) -> DataFrame:
    """Correlation of the errors of two models on the same rows."""
    return df.groupBy(*group).agg(correlation(F.col(a) - F.col(actual), F.col(b) - F.col(actual)).alias("error_corr"))


def ratio_calibration(train: DataFrame, group: Sequence[str], actual: str, guess: str, out: str = "ratio") -> DataFrame:
    """Realised over projected total per group."""
    return train.groupBy(*group).agg((F.sum(actual) / F.greatest(F.sum(guess), F.lit(1.0))).alias(out))


def apply_calibration(df: DataFrame, table: DataFrame, group: Sequence[str], value: str, strength: float,
                      bounds: tuple[float, float], ratio: str = "ratio") -> DataFrame:
    """Scale a value toward its group's ratio, clamped and at partial strength; unknown groups stay."""
    pull = 1 + F.lit(strength) * (clip(F.coalesce(ratio, F.lit(1.0)), *bounds) - 1)
    return df.join(stored(table), list(group), "left").withColumn(value, F.col(value) * pull).drop(ratio)


Draw = Callable[[int, int, int, int, int], Iterator[np.ndarray]]
"""(resamples, stream, n, first, size) to how often each resample draws the rows first, first + 1, ... of n, a chunk of rows at a time.

Rows come in parts of PART, of which ``first`` begins one. Each yield is a matrix of resamples by rows.
"""
PART = 65536
_CHUNK = 512


def hashed_draw(seed: int) -> Draw:
    """n independent draws of n rows a resample: multinomial counts, split binomially over the parts, then within each.

    What a part holds depends on the seed, the group and its rows alone, not on how Spark deals them.
    """
    def counts(resamples: int, stream: int, n: int, first: int, size: int) -> Iterator[np.ndarray]:
        sizes = np.diff(np.append(np.arange(0, n, PART), n))
        part = first // PART
        own = np.random.default_rng([seed, stream, 0]).multinomial(n, sizes / n, size=resamples)[:, part]
        rng, left = np.random.default_rng([seed, stream, part + 1]), size
        while left:
            c = min(_CHUNK, left)
            here = own if c == left else rng.binomial(own, c / left)
            own, left = own - here, left - c
            yield rng.multinomial(here, np.full(c, 1 / c))

    return counts


def arithmetic_draw(seed: int) -> Draw:
    """Draw i of resample b is the row (7919 b + 104729 i + 31 b i + seed) mod n, for checks on engines with other generators.

    How often that is row j has a closed form: the greatest common divisor of n and the factor of i where it divides the rest, else never.
    """
    def counts(resamples: int, stream: int, n: int, first: int, size: int) -> Iterator[np.ndarray]:
        b = np.arange(resamples)[:, None]
        common = np.gcd(104729 + 31 * b, n)
        for at in range(first, first + size, _CHUNK):
            j = np.arange(at, min(at + _CHUNK, first + size))[None, :]
            yield np.where((j - b * 7919 - seed) % common == 0, common, 0)

    return counts


def bootstrap_mean(values: DataFrame, value: str, order: Sequence[str], group: Sequence[str] = (), resamples: int = 2000,
                   confidence: float = 0.95, draw: Draw | None = None, shared: bool = False) -> DataFrame:
    """Mean with a percentile bootstrap interval per group; null values are left out.

    Rows are numbered in their group and parted into runs of PART. A task counts how often each resample draws each of its rows
    and sums the values by resample, so that what is shuffled is one sum a resample and part, never rows times
    resamples. With ``shared`` the groups are resampled together: row i of one is drawn as often as row i of another.
    """
    draw = draw or hashed_draw(0)
    known = values.where(F.col(value).isNotNull())
    numbered = stored(row_numbers(known, group, [F.col(o).asc() for o in order], "__rn").select(
        *group, (F.col("__rn") - 1).cast("bigint").alias("__i"), F.col(value).cast("double").alias("__v")))
    sizes = stored(numbered.groupBy(*group).agg(F.count("*").alias("n"), F.avg("__v").alias("estimate")))
    sized = null_safe_join(numbered, sizes.select(*group, "n"), group) if group else numbered.withColumn("n", sizes.select("n").scalar())
    stream = F.pmod(F.xxhash64(*group), F.lit(1 << 62)) if group and not shared else F.lit(0).cast("bigint")
    parts = sized.select(*group, F.floor(F.col("__i") / PART).alias("__part"), "__i", "__v", "n", stream.alias("__stream"))
    keys = [*group, "__part"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__i")
        v, first = rows.column("__v").to_numpy(), rows.column("__i")[0].as_py()
        sums, at = np.zeros(resamples), 0
        drawn = np.zeros(resamples, np.int64)
        for counts in draw(resamples, rows.column("__stream")[0].as_py(), rows.column("n")[0].as_py(), first, len(v)):
            sums += counts @ v[at:at + counts.shape[1]]
            drawn += counts.sum(axis=1)
            at += counts.shape[1]
        own = {g: pa.array([k.as_py()] * resamples, k.type) for g, k in zip(group, key, strict=False)}
        return pa.table(own | {"__b": pa.array(np.arange(resamples, dtype=np.int32)), "__s": pa.array(sums), "__c": pa.array(drawn)})

    schema = T.StructType([*(parts.schema[g] for g in group), T.StructField("__b", T.IntegerType()),
                           T.StructField("__s", T.DoubleType()), T.StructField("__c", T.LongType())])
    sums = parts.groupBy(*keys).applyInArrow(run, schema)
    means = sums.groupBy(*group, "__b").agg((F.sum("__s") / F.sum("__c")).alias("__mean"))
    tail = (1 - confidence) / 2
    ci = group_quantiles(means, group, "__mean", [tail, 1 - tail], ["low", "high"])
    if group:
        return null_safe_join(sizes, ci, group).select(*group, "n", "estimate", "low", "high")
    both = ci.agg(F.struct(F.max("low").alias("low"), F.max("high").alias("high")).alias("c")).scalar()
    return sizes.withColumn("__c", both).select("n", "estimate", F.col("__c.low").alias("low"), F.col("__c.high").alias("high"))


def cluster_bootstrap_mean(values: DataFrame, value: str, cluster: Sequence[str], group: Sequence[str] = (), **options) -> DataFrame:
    """Bootstrap over whole clusters, each counting once through its mean."""
    means = stored(values.groupBy(*group, *cluster).agg(F.avg(value).alias("__cm"), F.count("*").alias("__n")))
    ci = bootstrap_mean(means, "__cm", cluster, group, **options).withColumnRenamed("n", "n_clusters")
    total = means.groupBy(*group).agg(F.sum("__n").alias("n"))
    if group:
        return null_safe_join(ci, total, group)
    return ci.withColumn("n", total.scalar())


def sweep_intervals(runs: DataFrame, variant: str = "fraction", season: str = "season", slot: str = "slot", base: float = 0.0,
                    playoff_place: int = 6, **options) -> DataFrame:
    """(variant, metric, estimate, low, high, n_clusters, n): intervals of finish, playoff and title rate, and of their differences to ``base``.

    Seasons are resampled whole, the same ones for all variants and metrics. Differences are taken slot by slot, where both
    variants filled the slot.
    """
    place = F.col("place").cast("double")
    metrics = F.array(
        F.struct(F.lit("mean_finish").alias("metric"), place.alias("value")),
        F.struct(F.lit("playoff_rate").alias("metric"), (F.col("place") <= playoff_place).cast("double").alias("value")),
        F.struct(F.lit("title_rate").alias("metric"), F.col("won").cast("double").alias("value")))
    long_ = stored(runs.select(variant, season, slot, F.inline(metrics)))
    naive = long_.where(F.col(variant) == base).select(season, slot, "metric", F.col("value").alias("__base"))
    paired = long_.where(F.col(variant) != base).join(naive, [season, slot, "metric"]).select(
        variant, season, slot, F.concat("metric", F.lit("_delta")).alias("metric"), (F.col("value") - F.col("__base")).alias("value"))
    return cluster_bootstrap_mean(long_.unionByName(paired), "value", [season], [variant, "metric"], shared=True, **options)


def position_counts(roster: DataFrame, team: Sequence[str], positions: Sequence[str]) -> DataFrame:
    """Roster size per team and position, one column per position."""
    return roster.groupBy(*team).pivot("position", list(positions)).agg(F.count(F.lit(1))).fillna(0, list(positions))


def match_results(matches: DataFrame, scores: DataFrame, period: str, bench: str | None = None) -> DataFrame:
    """Two rows per match with the win share of each team.

    A team without a score in a period counts as zero. With ``bench`` a tied score is settled by the
    bench; only a full tie is shared.
    """
    cols = ["score"] + ([bench] if bench else [])

    def side(name: str, tag: str) -> DataFrame:
        return scores.select(period, F.col("team").alias(name), *[F.col(c).alias(f"{tag}{c}") for c in cols])

    def known(tag: str) -> Column:
        return F.struct(*[F.coalesce(F.col(f"{tag}{c}"), F.lit(0.0)).alias(c) for c in cols]).alias(tag)

    m = matches.join(side("team_a", "__sa"), [period, "team_a"], "left").join(side("team_b", "__sb"), [period, "team_b"], "left")
    m = m.select(period, "team_a", "team_b", known("__sa"), known("__sb"))
    share = F.when(F.col("__sa") > F.col("__sb"), 1.0).when(F.col("__sa") < F.col("__sb"), 0.0).otherwise(0.5)
    return m.withColumn("__w", share).select(period, F.inline(F.array(
        F.struct(F.col("team_a").alias("team"), F.col("__w").alias("win")),
        F.struct(F.col("team_b").alias("team"), (1.0 - F.col("__w")).alias("win")))))


def standings(matches: DataFrame, scores: DataFrame, period: str, bench: str | None = None) -> DataFrame:
    """Wins and points of every team, placed by wins, points, then team."""
    wins = match_results(matches, scores, period, bench).groupBy("team").agg(F.sum("win").alias("wins"))
    pf = scores.groupBy("team").agg(F.sum("score").alias("pf"))
    table = pf.join(wins, "team", "left").withColumn("wins", F.coalesce("wins", F.lit(0.0)))
    order = [F.col("wins").desc(), F.col("pf").desc(), F.col("team").asc()]
    return row_numbers(table, [], order, "place")


def sweep_summary(runs: DataFrame, variant: str = "fraction", season: str = "season", playoff_place: int = 6) -> DataFrame:
    """Mean finish, playoff rate and titles per variant, by season and overall (season null)."""
    return runs.rollup(variant, season).agg(
        F.grouping(variant).alias("__g"), F.count("*").alias("n_slots"), F.avg("place").alias("mean_finish"),
        F.avg((F.col("place") <= playoff_place).cast("double")).alias("playoff_rate"),
        F.sum(F.col("won").cast("int")).alias("titles"), F.avg(F.col("won").cast("double")).alias("title_rate"),
    ).where(F.col("__g") == 0).drop("__g")


def lift(runs: DataFrame, label: str, ours: str, base: str, group: Sequence[str] = (), playoff_place: int = 6) -> DataFrame:
    """Rates of two labels side by side and their differences."""
    def rate(name: str, c: Column) -> Column:
        return F.avg(F.when(F.col(label) == name, c.cast("double")))

    playoff = F.col("place") <= playoff_place
    t = runs.groupBy(*group).agg(
        rate(ours, F.col("won")).alias("title_rate"), rate(base, F.col("won")).alias("base_title_rate"),
        rate(ours, playoff).alias("playoff_rate"), rate(base, playoff).alias("base_playoff_rate"),
        rate(ours, F.col("place")).alias("mean_finish"), rate(base, F.col("place")).alias("base_mean_finish"))
    return t.withColumns({
        "title_lift": F.col("title_rate") - F.col("base_title_rate"),
        "playoff_lift": F.col("playoff_rate") - F.col("base_playoff_rate")})


def tiered_calibration(prior: DataFrame, actual: DataFrame, keys: Sequence[str], tier: Column, first_season: Column) -> DataFrame:
    """Realised over projected total per tier, an absent outcome counting as zero.

    Classes before the first season with outcomes are left out: their absence is missing data.
    """
    rows = prior.where(F.col("season") >= first_season).join(actual, list(keys), "left").withColumn("__tier", tier)
    return ratio_calibration(
        rows.withColumn("__a", F.coalesce("actual", F.lit(0.0))).withColumnRenamed("__tier", "tier"), ["tier"], "__a", "proj")


