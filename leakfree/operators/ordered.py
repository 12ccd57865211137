"""Order statistics over groups of any size.

A plain window over (group) puts a whole group into one task. When a group may hold a large
share of all rows the operators below are used instead: rows are first collapsed to one row per
(group, value), then spread by a range partitioning over (group, value), and the running sums of
the partitions are stitched together with a table of at most ``groups + partitions`` rows. The
results are exact. Tables of one row per group are written too: their size is then known, and the
planner broadcasts them when they are small instead of moving large groups to few tasks.

The range-partitioned rows are written to the shared folder with the partition they fell into: the
bounds are data from there on, so neither a lost executor nor a second reader can see other ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import once, stored

_PART = "__part"


def ordered_prefix(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    measures: Mapping[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add, per measure, the sum over all rows strictly before the row in its group.

    ``order`` must be a total order within the group.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    ranged = stored(
        df.withColumns({f"__m_{m}": c for m, c in measures.items()})
        .repartitionByRange(n, *keys, *order)
        .withColumn(_PART, F.spark_partition_id())
    )
    before = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group, _PART)
        .agg(*[F.sum(f"__m_{m}").alias(f"__t_{m}") for m in measures])
        .select(*group, _PART, *[
            F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in measures
        ])
    )
    joined = null_safe_join(ranged, stored(offsets), [*group, _PART], "inner")
    inside = Window.partitionBy(*group, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumns({
        m: F.col(f"__o_{m}") + F.coalesce(F.sum(f"__m_{m}").over(inside), F.lit(0)) for m in measures
    })
    return out.drop(_PART, *[f"__{p}_{m}" for p in "mo" for m in measures])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null meets null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"__k_{k}"])
    return left.join(renamed, condition, how).drop(*[f"__k_{k}" for k in keys])


def value_counts_before(df: DataFrame, group: Sequence[str], value: str, descending: bool = False) -> DataFrame:
    """One row per (group, value) with ``cnt`` and ``before`` = rows with a smaller (larger) value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("cnt"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    return ordered_prefix(counts, group, [order], {"before": F.col("cnt")})


def rank_table(
    df: DataFrame, group: Sequence[str], value: str, out: str, descending: bool = True, method: str = "min",
) -> DataFrame:
    """The rank of every distinct (group, value); ties share the smallest (``min``) or mean (``average``) rank."""
    table = value_counts_before(df, group, value, descending)
    if method == "min":
        rank = (F.col("before") + 1).cast("int")
    elif method == "average":
        rank = F.col("before") + (F.col("cnt") + 1) / 2.0
    else:
        raise ValueError(f"unknown rank method {method!r}")
    return table.select(*group, value, rank.alias(out))


def competition_rank(
    df: DataFrame, group: Sequence[str], value: str, out: str, descending: bool = True, method: str = "min",
) -> DataFrame:
    """Every row with its rank within the group; rows without a value are unranked."""
    table = rank_table(df, group, value, out, descending, method)
    return null_safe_join(df, table, [*group, value], "left")


def stacked_ranks(
    df: DataFrame, measures: Mapping[str, tuple[Sequence[str], str]], descending: bool = True, method: str = "min",
) -> DataFrame:
    """Every row with several ranks: ``measures`` maps each rank's column to its group and value.

    All measures are ranked in one pass over one range-partitioned table of (measure, group, value) rows; rows
    without a value are unranked. Values are compared as doubles, ties share the smallest (``min``) or mean (``average``) rank.
    """
    if method not in ("min", "average"):
        raise ValueError(f"unknown rank method {method!r}")
    df = once(df)

    def parts(group: Sequence[str], value: str) -> tuple[Column, Column]:
        x = F.col(value).cast("double")
        return F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit(""), -x if descending else x

    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("__of"), g.alias("__g"), x.alias("__x"))
        for i, (g, x) in enumerate(parts(*m) for m in measures.values())]))).where(F.col("__x").isNotNull())
    counts = stacked.groupBy("__of", "__g", "__x").agg(F.count("*").alias("cnt"))
    placed = ordered_prefix(counts, ["__of", "__g"], [F.col("__x")], {"before": F.col("cnt")})
    rank = (F.col("before") + 1).cast("int") if method == "min" else F.col("before") + (F.col("cnt") + 1) / 2.0
    table = stored(placed.select("__of", "__g", "__x", rank.alias("__rank")), "ranks")
    out = df
    for i, (name, m) in enumerate(measures.items()):
        g, x = parts(*m)
        own = table.where(F.col("__of") == i).select("__g", "__x", F.col("__rank").alias(name))
        out = out.withColumns({"__g": g, "__x": x}).join(own, ["__g", "__x"], "left").drop("__g", "__x")
    return out


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Exact row numbers from 1 under a total order, without one task per group."""
    return ordered_prefix(df, group, order, {"__before": F.lit(1)}).withColumn(
        out, (F.col("__before") + 1).cast("int")
    ).drop("__before")


def quantile_name(p: float) -> str:
    return f"q{p:g}".replace(".", "_")


def group_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group and one column per probability."""
    names = list(names) if names else [quantile_name(p) for p in probs]
    table = value_counts_before(df, group, value)
    sizes = stored(table.groupBy(*group).agg(F.sum("cnt").alias("__n")))
    placed = null_safe_join(table, sizes, group, "inner") if group else table.withColumn(
        "__n", sizes.scalar()
    )

    def at(index: Column) -> Column:
        hit = (F.col("before") <= index) & (index < F.col("before") + F.col("cnt"))
        return F.max(F.when(hit, F.col(value)))

    picks, results = [], []
    for i, (p, name) in enumerate(zip(probs, names, strict=True)):
        h = (F.col("__n") - 1) * F.lit(float(p))
        picks += [
            at(F.floor(h)).alias(f"__lo{i}"), at(F.ceil(h)).alias(f"__hi{i}"),
            F.max(h - F.floor(h)).alias(f"__w{i}"),
        ]
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        results.append((lo + (hi - lo) * F.col(f"__w{i}")).alias(name))
    return placed.groupBy(*group).agg(*picks).select(*group, *results)


def top_values(df: DataFrame, group: Sequence[str], value: str, k: int, out: str = "rank") -> DataFrame:
    """The ``k`` largest distinct values per group with their tie-sharing ranks.

    Duplicates are collapsed first and Spark prunes each map task to ``k`` rows per group before the
    shuffle, so the result has at most ``groups * k`` rows and no task ever sees a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__cnt"))
    w = Window.partitionBy(*group).orderBy(F.col(value).desc())
    best = counts.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    larger = F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return best.select(*group, value, (larger + 1).cast("int").alias(out))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """The first ``k`` rows per group under a total order (pruned map-side by Spark)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
