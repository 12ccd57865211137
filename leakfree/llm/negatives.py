"""Exact mining of hard negatives with segment summaries.

Components are turned into integers floor(256 x). Every vector is stored with the means m and deviations s of its
segments, of one segment, then two, four and so on. With segments of length l the inner product of two vectors lies within
the sum over segments of l (m m' - s s') and l (m m' + s s'). A pair goes as soon as one level, coarse to fine, shows that its score
lies outside what the anchor still needs; what is left is scored exactly.

Rows are packed into blocks of a fixed number of vectors, anchors into blocks of their own, and every anchor block meets
every block of rows once. The anchors of a block are rows as well: they are the first sample that tells what an anchor needs, before
any data moves. One such pass finds the positives, the next one the negatives within the positives' score windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .topk import exact_scores, levels, quantised

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
"""A negative's score is within these per cent of the positive's."""
BLOCK, LEAST_BLOCK = 16384, 1024
"""Vectors of a block; small tables have smaller ones, down to the second number, so that all cores take part."""
EVERY = 100
_SLICE = 256
_MIN, _MAX = -(1 << 63), (1 << 63) - 1


def summaries(q: np.ndarray) -> np.ndarray:
    """Per row the means, then the deviations of the segments of all levels, each times the root of the segment's length."""
    out = []
    for starts in levels(q.shape[1]):
        sizes = np.diff(np.append(starts, q.shape[1]))
        mean = np.add.reduceat(q, starts, axis=1) / sizes
        spread = np.maximum(np.add.reduceat(q * q, starts, axis=1) / sizes - mean * mean, 0.0)
        out += [mean * np.sqrt(sizes), np.sqrt(spread * sizes)]
    return np.hstack(out) if out else np.zeros((len(q), 0))


class Vectors:
    """The vectors of one block with their summaries."""

    def __init__(self, row: dict, prefix: str = "") -> None:
        self.uids, self.ids, self.labels = (np.frombuffer(row[prefix + n], np.int64) for n in ("uids", "ids", "labels"))
        self.data = np.frombuffer(row[prefix + "data"], np.float64).reshape(len(self.ids), row["dim"])
        self.sums = np.frombuffer(row[prefix + "sums"], np.float64).reshape(len(self.ids), -1)

    def take(self, rows: np.ndarray) -> Vectors:
        out = object.__new__(Vectors)
        out.uids, out.ids, out.labels, out.data, out.sums = (x[rows] for x in (self.uids, self.ids, self.labels, self.data, self.sums))
        return out


def possible(q: Vectors, c: Vectors, alive: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The pairs of ``alive`` whose score may be within least and most of the anchor, by the summaries, coarse to fine."""
    slack = 1e-9 * (np.sqrt((q.data**2).sum(1))[:, None] * np.sqrt((c.data**2).sum(1))[None, :] + 1.0)
    at = 0
    for starts in levels(q.data.shape[1]):
        if not alive.any():
            break
        n = len(starts)
        means = q.sums[:, at:at + n] @ c.sums[:, at:at + n].T
        spread = q.sums[:, at + n:at + 2 * n] @ c.sums[:, at + n:at + 2 * n].T + slack
        alive = alive & ~(means + spread < least[:, None]) & ~(means - spread > most[:, None])  # a bound beyond the doubles keeps the pair
        at += 2 * n
    return alive


def scored(q: Vectors, c: Vectors, alive: np.ndarray) -> np.ndarray:
    """Exact scores of the alive pairs, the least long elsewhere."""
    out = np.full(alive.shape, _MIN, np.int64)
    small = np.abs(q.data).max(initial=0) * np.abs(c.data).max(initial=0) * max(q.data.shape[1], 1) < 2.0**53
    if small and alive.mean() > 0.05:
        return np.where(alive, (q.data @ c.data.T).astype(np.int64), out)  # sums of integers below 2^53 are exact
    rows, cols = np.nonzero(alive)
    out[rows, cols] = exact_scores(q.data, c.data, rows, cols, small)
    return out


def first_k(scores: np.ndarray, alive: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest alive scores of each row, ties to the smaller id, in order."""
    if alive.shape[1] > k:
        kth = np.partition(np.where(alive, scores, _MIN), -k, axis=1)[:, -k]
        alive = alive & (scores >= kth[:, None])
    rows, cols = np.nonzero(alive)
    order = np.lexsort((ids[cols], ~scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(alive)))[rows] < k
    return rows[keep], cols[keep]


def kth_score(scores: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest alive score of each row, minus infinity with fewer."""
    if alive.shape[1] < k:
        return np.full(len(alive), -np.inf)
    kth = np.partition(np.where(alive, scores.astype(np.float64), -np.inf), -k, axis=1)[:, -k]
    return np.nextafter(kth, -np.inf)  # as a double it may have been rounded up


def _parts(q: Vectors) -> Iterator[tuple[int, np.ndarray]]:
    for label in np.unique(q.labels):
        own = np.flatnonzero(q.labels == label)
        for at in range(0, len(own), _SLICE):
            yield int(label), own[at:at + _SLICE]


def positives_of(q: Vectors, c: Vectors, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors' places, places in c, scores) of the best rows of the anchors' own labels."""
    for label, own in _parts(q):
        rows = np.flatnonzero(c.labels == label)
        a, b = q.take(own), c.take(rows)
        alive = possible(a, b, a.uids[:, None] != b.uids[None, :], least[own], np.full(len(own), np.inf))
        scores = scored(a, b, alive)
        i, j = first_k(scores, alive, b.ids, k)
        yield own[i], rows[j], scores[i, j]


def windows(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Per positive score the least and greatest score of its negatives; beyond a long they stop at its ends."""
    def held(x: int) -> int:
        return min(max(x, _MIN), _MAX)

    return [(held(-(-low * s // 100)), held(high * s // 100)) for s in scores]


def negatives_of(q: Vectors, c: Vectors, low: np.ndarray, high: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rank of the positive, anchors' places, places in c, scores) of the first rows of other labels in each window.

    ``low`` and ``high`` hold a window per anchor and positive, empty where low is above high; a score below ``least`` is not needed.
    """
    for label, own in _parts(q):
        rows = np.flatnonzero(c.labels != label)
        a, b = q.take(own), c.take(rows)
        usable = low[own] <= high[own]
        need = np.where(usable, np.maximum(low[own].astype(np.float64), least[own]), np.inf).min(axis=1, initial=np.inf)
        most = np.where(usable, high[own].astype(np.float64), -np.inf).max(axis=1, initial=-np.inf)
        alive = possible(a, b, np.broadcast_to(usable.any(axis=1)[:, None], (len(own), len(rows))), need, most)
        if not alive.any():
            continue
        scores = scored(a, b, alive)
        for p in range(low.shape[1]):
            inside = alive & (scores >= low[own, p][:, None]) & (scores <= high[own, p][:, None]) & (scores >= least[own, p][:, None])
            i, j = first_k(scores, inside, b.ids, k)
            yield p, own[i], rows[j], scores[i, j]


def _pack(rows: DataFrame) -> DataFrame:
    """One row per (dim, block) with its vectors' numbers, ids, labels, components and summaries."""
    names = ("uids", "ids", "labels", "data", "sums")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        table = table.sort_by("uid")
        flat = np.concatenate([np.asarray(x.flatten()) for x in table.column("v").chunks] or [np.zeros(0)])
        q = quantised(flat.reshape(table.num_rows, dim))
        parts = [*(table.column(c).to_numpy() for c in ("uid", "id", "label")), q, summaries(q)]
        return pa.table({"dim": [key[0]], "block": [key[1]]} | {n: pa.array([p.tobytes()], pa.binary()) for n, p in zip(names, parts, strict=True)})

    return rows.groupBy("dim", "block").applyInArrow(run, "dim int, block long, " + ", ".join(f"{n} binary" for n in names))


def _dealt(rows: DataFrame, counts: DataFrame) -> DataFrame:
    return rows.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))


def _asked(packed: DataFrame) -> DataFrame:
    return packed.withColumnsRenamed({"block": "asked"} | {n: f"asked_{n}" for n in ("uids", "ids", "labels", "data", "sums")})


_FOUND = pa.schema([("uid", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "uid long, anchor_id long, place int, id long, score long"


def _rows(q: Vectors, c: Vectors, place: int, i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([
        pa.array(q.uids[i]), pa.array(q.ids[i]), pa.array(np.full(len(i), place, np.int32)), pa.array(c.ids[j]), pa.array(scores)], schema=_FOUND)


def _first_positives(k: int):
    """The k-th best score of every anchor among the other anchors of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                q = Vectors(row, "asked_")
                least = np.full(len(q.ids), -np.inf)
                for label, own in _parts(q):
                    rows = np.flatnonzero(q.labels == label)
                    a, b = q.take(own), q.take(rows)
                    alive = a.uids[:, None] != b.uids[None, :]
                    least[own] = kth_score(scored(a, b, alive), alive, k)
                out.append(least.tobytes())
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "least"])

    return run


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, c = Vectors(row, "asked_"), Vectors(row)
                for i, j, scores in positives_of(q, c, np.frombuffer(row["least"], np.float64), k):
                    yield _rows(q, c, 0, i, j, scores)

    return run


def _first_negatives(positives: int, k: int, low: int, high: int):
    """Windows of every anchor's positives, and the k-th best score in each among the other anchors of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs, leasts = [], [], []
            for row in batch.to_pylist():
                q = Vectors(row, "asked_")
                known = {x["uid"]: x["scores"] for x in row["known"]}
                lo, hi = np.ones((len(q.ids), positives), np.int64), np.zeros((len(q.ids), positives), np.int64)
                for n, uid in enumerate(q.uids.tolist()):
                    for p, (a, b) in enumerate(windows(known.get(uid, []), low, high)):
                        lo[n, p], hi[n, p] = a, b
                least = np.full(lo.shape, -np.inf)
                for p, i, _, scores in negatives_of(q, q, lo, hi, least.copy(), k):
                    whole = np.flatnonzero(np.bincount(i, minlength=len(lo)) == k)
                    last = np.searchsorted(i, whole, "right") - 1
                    least[whole, p] = np.nextafter(scores[last].astype(np.float64), -np.inf)
                lows.append(lo.tobytes())
                highs.append(hi.tobytes())
                leasts.append(least.tobytes())
            kept = [n for n in batch.schema.names if n != "known"]
            yield pa.record_batch([*(batch.column(n) for n in kept), *(pa.array(x, pa.binary()) for x in (lows, highs, leasts))],
                                  names=[*kept, "low", "high", "least"])

    return run


def _negatives(positives: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, c = Vectors(row, "asked_"), Vectors(row)
                lo, hi = (np.frombuffer(row[n], np.int64).reshape(-1, positives) for n in ("low", "high"))
                for p, i, j, scores in negatives_of(q, c, lo, hi, np.frombuffer(row["least"], np.float64).reshape(-1, positives), k):
                    yield _rows(q, c, p + 1, i, j, scores)

    return run


def hard_negatives(
    rows: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``asked`` holds.

    An anchor's positives are the first other rows of its label by score, ties to the smaller key; a positive's negatives
    the first rows of other labels with a score of ``low`` to ``high`` per cent of the positive's. Rows with a
    null key, label or vector or with a null or non-finite component take no part, nor do those whose components leave
    the doubles when quantised. Rows that repeat a key, whole or not, are rows of their own. Vectors of another length
    than the anchor's are neither; empty vectors score 0. Scores beyond a long stop at its ends. Empty tables
    give no rows; other columns are read by ``asked`` only.
    """
    usable = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(asked, F.lit(False)).alias("asked")).where(
        "id is not null and label is not null and v is not null"
        " and forall(v, x -> x is not null and not isnan(x) and abs(x) * 256 < double('infinity'))")
    numbered = stored(usable.select(F.size("v").alias("dim"), F.monotonically_increasing_id().alias("uid"), "id", "label", "v", "asked"), "vectors")
    wanted = 2 * rows.sparkSession.sparkContext.defaultParallelism

    def counted(df: DataFrame) -> DataFrame:
        n = F.count("*")
        return df.groupBy("dim").agg(F.greatest(F.ceil(n / block), F.least(F.ceil(n / LEAST_BLOCK), F.lit(wanted))).cast("long").alias("blocks"))

    sizes = stored(counted(numbered), "sizes")
    packed = stored(_pack(_dealt(numbered, sizes)), "blocks")
    anchors = numbered.where("asked")
    asked_sizes = stored(anchors.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")), "sizes")
    asking = stored(_asked(_pack(_dealt(anchors, asked_sizes))), "anchors")

    def met(left: DataFrame) -> DataFrame:
        """Every anchor block beside every block of rows of its length."""
        spread = left.join(sizes, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        return spread.join(packed, ["dim", "block"])

    blob = "dim int, asked long, asked_uids binary, asked_ids binary, asked_labels binary, asked_data binary, asked_sums binary"
    begun = asking.mapInArrow(_first_positives(positives), f"{blob}, least binary")
    near = met(begun).mapInArrow(_positives(positives), _FOUND_SQL)
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "id")
    chosen = stored(near.withColumn("place", F.row_number().over(order).cast("int")).where(F.col("place") <= positives), "positives")

    scores = chosen.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    where = _dealt(anchors.select("dim", "uid"), asked_sizes).select("dim", "uid", F.col("block").alias("asked"))
    known = where.join(scores, "uid").groupBy("dim", "asked").agg(F.collect_list(F.struct("uid", "scores")).alias("known"))
    windowed = asking.join(known, ["dim", "asked"]).mapInArrow(
        _first_negatives(positives, negatives, low, high), f"{blob}, low binary, high binary, least binary")
    hard = met(windowed).mapInArrow(_negatives(positives, negatives), _FOUND_SQL)
    order = Window.partitionBy("uid", "place").orderBy(F.col("score").desc(), "id")
    ranked = hard.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
    named = chosen.select("uid", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["uid", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors whose vec_id is divisible by 100.

    The label of a row whose vec_id is divisible by 7 is the next of ten.
    """
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings.withColumn("label", turned), F.col("vec_id") % EVERY == 0)


ORACLE = """
with usable as (select row_number() over () as uid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (select a.uid, a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from usable a join usable c on a.vec_id % 100 = 0 and a.uid <> c.uid and len(a.v) = len(c.v)),
positive as (select * from (select uid, anchor_id, vec_id as positive_id, score as positive_score,
    row_number() over (partition by uid order by score desc, vec_id) as place from scored where same) where place <= 5),
ranked as (select p.*, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.uid, place order by s.score desc, s.vec_id)::int as rank
  from positive p join scored s on s.uid = p.uid and not s.same
    and 100 * s.score between 30 * p.positive_score and 90 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10"""
