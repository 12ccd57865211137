"""Empirical residual distributions kept as ranked tables.

A pool is never collected into an array. It is a table (pool keys, position in order, value), and
every lookup - tail share, share below, inverse distribution - is a join or a running count over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ordered import group_quantiles, ordered_prefix, row_numbers

N_BINS = 5


def bin_edges(df: DataFrame, position: str = "position", pred: str = "pred", n_bins: int = N_BINS) -> DataFrame:
    """Interior quantile edges of the prediction per position, as one array per position."""
    probs = [i / n_bins for i in range(1, n_bins)]
    names = [f"__e{i}" for i in range(1, n_bins)]
    edges = group_quantiles(df, [position], pred, probs, names)
    return edges.select(position, F.array(*names).alias("edges"))


def bin_of(pred: Column | str, edges: Column | str = "edges") -> Column:
    """Right-open bin: how many edges the prediction reaches."""
    p = F.col(pred) if isinstance(pred, str) else pred
    return F.size(F.filter(edges, lambda e: p >= e)).cast("int")


def with_bins(df: DataFrame, edges: DataFrame | None = None, position: str = "position", pred: str = "pred") -> DataFrame:
    """Rows with their bin; positions without edges get a null bin."""
    table = stored(bin_edges(df, position, pred)) if edges is None else edges
    return df.join(table, position, "left").withColumn(
        "bin", F.when(F.col("edges").isNotNull(), bin_of(pred))).drop("edges")


def ranked_pool(resid: DataFrame, keys: Sequence[str], value: str = "residual", ident: Sequence[str] = ("player_id", "season", "week")) -> DataFrame:
    """The pool as a table: keys, 0-based index in ascending order, value, pool size."""
    order = [F.col(value).asc(), *[F.col(i).asc() for i in ident]]
    ranked = row_numbers(resid.select(*dict.fromkeys([*keys, value, *ident])), keys, order, "__rn")
    sizes = stored(ranked.groupBy(*keys).agg(F.count("*").alias("n")))
    indexed = ranked.select(*keys, (F.col("__rn") - 1).cast("bigint").alias("idx"), value)
    return indexed.join(sizes, list(keys)) if keys else indexed.withColumn("n", sizes.select("n").scalar())


def inverse_cdf(draws: DataFrame, pool: DataFrame, keys: Sequence[str], u: str, value: str = "residual", out: str = "draw") -> DataFrame:
    """Linearly interpolated quantile of the pool at ``u`` for every draw, by two equi-joins on the index."""
    sizes = stored(pool.where(F.col("idx") == 0).select(*keys, F.col("n").alias("__n")))
    placed = draws.join(sizes, list(keys)) if keys else draws.withColumn("__n", sizes.select("__n").scalar())
    h = (F.col("__n") - 1) * F.col(u)
    placed = placed.withColumns({"__lo": F.floor(h), "__hi": F.ceil(h), "__w": h - F.floor(h)})
    lo = pool.select(*keys, F.col("idx").alias("__lo"), F.col(value).alias("__vlo"))
    hi = pool.select(*keys, F.col("idx").alias("__hi"), F.col(value).alias("__vhi"))
    both = placed.join(lo, [*keys, "__lo"]).join(hi, [*keys, "__hi"])
    return both.withColumn(out, F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * F.col("__w")).drop(
        "__n", "__lo", "__hi", "__w", "__vlo", "__vhi")


def tail_shares(queries: DataFrame, pool: DataFrame, keys: Sequence[str], need: str, value: str = "residual") -> DataFrame:
    """Share of the pool strictly above (``p_above``) and strictly below (``p_below``) each need.

    Pool values and needs are merged into one table of distinct values per key; a running count over
    it answers all needs at once. No pool x query product is formed.
    """
    points = pool.select(*keys, F.col(value).alias("__x"), F.lit(1).alias("__c")).unionByName(
        queries.select(*keys, F.col(need).alias("__x"), F.lit(0).alias("__c")))
    merged = points.where(F.col("__x").isNotNull()).groupBy(*keys, "__x").agg(F.sum("__c").alias("__cnt"))
    counted = ordered_prefix(merged, keys, [F.col("__x").asc()], {"__below": F.col("__cnt")})
    sizes = stored(pool.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("pool_n")))
    hit = queries.join(counted.withColumnRenamed("__x", need), [*keys, need], "left")
    hit = hit.join(sizes, list(keys), "left") if keys else hit.withColumn("pool_n", sizes.scalar())
    n = F.col("pool_n")
    return hit.withColumns({
        "p_above": (n - F.col("__below") - F.col("__cnt")) / n, "p_below": F.col("__below") / n,
    }).drop("__below", "__cnt")
