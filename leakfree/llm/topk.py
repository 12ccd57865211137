"""Exact top-k inner products with multi-resolution segment statistics.

Components are turned into integers floor(256 x). A vector is cut into segments; with means m and deviations
s of the segments of length l, the inner product of two vectors is at most the sum over segments of
l (m m' + s s'), which is the lower bound of their distance in other words. Levels run from coarse to fine,
each with half the segment length. Candidates whose bound is below a query's k-th best score known so far
go; the exact products of the survivors are computed last.

Queries and rows are packed into blocks of a fixed number of vectors. Every query block meets every row block
once, on a join by row block. A first pass against one row block gives every query its first k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import sorted_groups

K = 5
SCALE = 256
BLOCK = 4096
EVERY = 50
_LONG, _PART, _SLICE = (1 << 63) - 1, 1 << 16, 256


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64))


def levels(dim: int) -> list[np.ndarray]:
    """Starts of the segments of each level, coarse to fine: 1, 2, 4, ... segments of at least 4 components."""
    out, parts = [], 1
    while dim and (parts == 1 or dim // parts >= 4):
        out.append(np.unique(np.linspace(0, dim, parts + 1).astype(int))[:-1])
        parts *= 2
    return out


def statistics(q: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per row and segment the scaled mean and deviation: their inner product bounds that of the rows."""
    sizes = np.diff(np.append(starts, q.shape[1]))
    sums = np.add.reduceat(q, starts, axis=1)
    squares = np.add.reduceat(q * q, starts, axis=1)
    mean = sums / sizes
    deviation = np.sqrt(np.maximum(squares / sizes - mean * mean, 0.0))
    return np.hstack([mean * np.sqrt(sizes), deviation * np.sqrt(sizes)])


def exact_scores(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of pairs of integer rows, exact; beyond a long they stop at its ends."""
    scores = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), _PART):
        x, y = q[rows[at:at + _PART]], c[cols[at:at + _PART]]
        if small:
            scores[at:at + _PART] = np.einsum("ij,ij->i", x, y)
        else:
            whole = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(x, y, strict=True)]
            scores[at:at + _PART] = [min(max(w, -_LONG - 1), _LONG) for w in whole]
    return scores


def best_in_block(
    query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, least: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row id, score): the best rows of the block for each query that may reach ``least``."""
    alive = query_ids[:, None] != ids[None, :]
    slack = 1e-9 * (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :] + 1.0)
    for starts in levels(q.shape[1]) if np.isfinite(least).any() else ():
        if not alive.any():
            break
        alive &= ~(statistics(q, starts) @ statistics(c, starts).T + slack < least[:, None])
    small = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1) < 2.0**53
    if small and alive.mean() > 0.05:
        dense = np.where(alive, q @ c.T, -np.inf)  # sums of integers below 2^53 are exact
        if len(ids) > k:
            alive &= dense >= -np.partition(-dense, k - 1, axis=1)[:, k - 1:k]
        rows, cols = np.nonzero(alive)
        scores = dense[rows, cols].astype(np.int64)
    else:
        rows, cols = np.nonzero(alive)
        scores = exact_scores(q, c, rows, cols, small)
    order = np.lexsort((ids[cols], ~scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(q)))[rows] < k
    return rows[keep], ids[cols[keep]], scores[keep]


_BLOCKS = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())])
_BLOCKS_SQL = "dim int, block long, ids binary, data binary"


def _pack(vectors: DataFrame) -> DataFrame:
    """Rows (dim, block, id, v) as one row per block; a block holds about BLOCK rows by construction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, block), rows in sorted_groups(batches, ["dim", "block"]):
            ids = np.array(rows.column("id").to_pylist(), np.int64)
            data = np.array(rows.column("v").to_pylist(), np.float64).reshape(len(ids), dim)
            yield pa.record_batch([
                pa.array([dim], pa.int32()), pa.array([block], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
                pa.array([quantised(data).tobytes()], pa.binary())], schema=_BLOCKS)

    return vectors.repartition("dim", "block").sortWithinPartitions("dim", "block", "id").mapInArrow(run, _BLOCKS_SQL)


def _compare(k: int):
    schema = pa.schema([("dim", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                query_ids, ids = (np.frombuffer(r[x], np.int64) for x in ("query_ids", "ids"))
                q, c = (np.frombuffer(r[x], np.float64).reshape(len(i), dim) for x, i in (("query_data", query_ids), ("data", ids)))
                least = np.full(len(q), -np.inf)
                if r["seen"] is not None:
                    known = {x["query_id"]: x["least"] for x in r["seen"]}
                    least = np.array([known.get(int(i), -np.inf) for i in query_ids], np.float64)
                for at in range(0, len(q), _SLICE):
                    own = slice(at, at + _SLICE)
                    rows, found, scores = best_in_block(query_ids[own], q[own], ids, c, least[own], k)
                    yield pa.record_batch([
                        pa.array(np.full(len(rows), dim), pa.int32()), pa.array(query_ids[own][rows]), pa.array(found), pa.array(scores)], schema=schema)

    return run


def topk(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query, ties to the smaller id.

    ``queries`` are rows of the same shape; a query never meets rows of its own id. Rows with a null id, a null
    vector, or a null or non-finite component take no part. Rows that repeat an id are one row, that with the
    smallest vector. Vectors of another length than the query's are no candidates; empty vectors score 0.
    Scores beyond a long stop at its ends. Empty tables give no rows.
    """
    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
            "id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) * 256 < double('infinity'))")
        return rows.groupBy("id").agg(F.min("v").alias("v")).select(F.size("v").alias("dim"), "id", "v")

    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))

    def dealt(rows: DataFrame, counts: DataFrame, name: str) -> DataFrame:
        return rows.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64(name), F.col("blocks")))

    def packed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = stored(usable(df), "vectors")
        counts = stored(sizes(rows), "sizes")
        return stored(_pack(dealt(rows, counts, "id").select("dim", "block", "id", "v")), "blocks"), counts

    all_blocks, counts = packed(vectors)
    asked, asked_counts = packed(queries)
    asked = asked.select("dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data"))
    out = "dim int, query_id long, vec_id long, score long"
    nothing = F.lit(None).cast("array<struct<query_id: long, least: long>>").alias("seen")
    first = asked.join(all_blocks.where("block = 0").drop("block"), "dim").select("*", nothing)
    tops = stored(first.mapInArrow(_compare(k), out), "first")
    least = tops.groupBy("dim", "query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    seen = dealt(least, asked_counts, "query_id").groupBy("dim", F.col("block").alias("query_block")).agg(
        F.collect_list(F.struct("query_id", "least")).alias("seen"))
    met = asked.join(seen, ["dim", "query_block"], "left").join(counts, "dim").where("blocks > 1").withColumn(
        "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)))
    rest = met.join(all_blocks, ["dim", "block"]).select("dim", "query_ids", "query_data", "ids", "data", "seen")
    found = tops.union(rest.mapInArrow(_compare(k), out))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by 50."""
    return topk(embeddings, embeddings.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
with usable as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from usable q join usable c on q.vec_id <> c.vec_id and q.vec_id % 50 = 0 and len(q.v) = len(c.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5"""
