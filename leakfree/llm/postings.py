"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are collapsed to different ones and given one more component that makes them equally long, so that the
largest inner product is the least distance. Lists are fitted by hierarchical balanced clustering: a sample is halved at the median between two
means until as many parts are left as lists are wanted; lists that come out too long on the whole table are parted again,
each by a sample of its own. Every vector goes to the list with the nearest centroid and, as a boundary vector, to further
ones whose distance is within ``BOUNDARY`` of that. Centroids are found through a graph held in memory: every centroid
knows its nearest ones, and a search goes from a few entries along the open centroids that are nearest.

A query takes all lists whose centroid's distance is within ``PRUNE`` of the nearest one's, however many these are. Its nearest
lists are scanned first; from the others only what beats the k-th best found there is returned. Long lists are scanned in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

K = 20
EVERY = 20
LIST = 256
"""Vectors aimed at for a list."""
CENTROID_BYTES = 32 << 20
"""Bounds the number of lists, and so what every worker holds; on larger tables lists get longer instead."""
SAMPLE, LIST_SAMPLE = 65536, 4096
"""Expected rows of the sample that lists are fitted on, and rows at most of that which parts a list."""
REPLICAS, BOUNDARY = 2, 1.05
PRUNE = 1.12
FIRST = 4
"""Lists that a query scans first."""
NEIGHBOURS, BEAM, EXPANDED = 16, 8, 4
PIECE, ASKED = 8192, 4096
"""Vectors and queries that meet in a task at a time, about."""
_ROUNDS = 4


def halved(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Means of ``parts`` equally large groups of the rows, near groups side by side."""
    parts = min(parts, len(x))
    if parts <= 1:
        return [x.mean(axis=0)] if len(x) else []
    left = parts // 2
    cut = min(max(len(x) * left // parts, left), len(x) - (parts - left))
    low = x[int(((x - x.mean(axis=0)) ** 2).sum(1).argmax())]
    high = x[int(((x - low) ** 2).sum(1).argmax())]
    for _ in range(_ROUNDS):
        order = np.argsort(x @ (low - high), kind="stable")[::-1]
        low, high = x[order[:cut]].mean(axis=0), x[order[cut:]].mean(axis=0)
    return halved(x[order[:cut]], left) + halved(x[order[cut:]], parts - left)


class Graph:
    """Centroids, and for each the places of its nearest ones."""

    def __init__(self, centroids: np.ndarray, near: np.ndarray) -> None:
        self.centroids, self.near = centroids, near
        self.squares = (centroids * centroids).sum(1)
        self.entries = np.arange(0, len(centroids), max(1, int(len(centroids) ** 0.5)))

    def search(self, y: np.ndarray, ratio: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(places, squared distances), nearest first, padded with -1: the centroids within ``ratio`` of each row's nearest one.

        Centroids are opened while they are among the ``beam`` nearest known ones or within the ratio.
        """
        n, own = len(y), np.arange(len(y))[:, None]
        length = (y * y).sum(1)[:, None]
        seen = np.zeros((n, len(self.centroids)), bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (n, 1))
        d = np.maximum(length + self.squares[self.entries] - 2 * (y @ self.centroids[self.entries].T), 0.0)
        opened = np.zeros(d.shape, bool)
        while True:
            limit = np.maximum(d.min(axis=1) * ratio**2, np.partition(d, min(beam, d.shape[1]) - 1, axis=1)[:, min(beam, d.shape[1]) - 1])
            open_ = np.where(opened | (d > limit[:, None]), np.inf, d)
            if not np.isfinite(open_).any():
                break
            pick = np.argpartition(open_, min(EXPANDED, d.shape[1]) - 1, axis=1)[:, :EXPANDED]
            fresh = np.isfinite(np.take_along_axis(open_, pick, 1))
            opened[own, pick] |= fresh
            found = self.near[ids[own, pick]]
            found = np.sort(np.where(fresh[:, :, None], found, -1).reshape(n, -1), axis=1)
            new = (found >= 0) & ~seen[own, found]
            new[:, 1:] &= found[:, 1:] != found[:, :-1]
            rows, cols = np.nonzero(new)
            places = found[rows, cols]
            seen[rows, places] = True
            more = np.full(found.shape, np.inf, d.dtype)
            more[rows, cols] = np.maximum(
                length[rows, 0] + self.squares[places] - 2 * np.einsum("ij,ij->i", y[rows], self.centroids[places]), 0.0)
            ids, d = np.hstack([ids, found]), np.hstack([d, more])
            opened = np.hstack([opened, np.zeros(found.shape, bool)])
            # what is neither within the ratio nor among the nearest is forgotten
            width = max(int((d <= (d.min(axis=1) * ratio**2)[:, None]).sum(1).max()), min(4 * beam, d.shape[1]))
            if width < d.shape[1]:
                keep = np.argpartition(d, width - 1, axis=1)[:, :width]
                ids, d, opened = ids[own, keep], d[own, keep], opened[own, keep]
        order = np.argsort(d, axis=1, kind="stable")
        ids, d = ids[own, order], d[own, order]
        ids[d > (d[:, :1] * ratio**2)] = -1
        return ids, d


def lifted(v: np.ndarray, scale: float, longest: float, query: bool) -> np.ndarray:
    """Vectors of one length: the largest inner product is then the least distance."""
    if query:  # only its direction matters
        y = v / np.abs(v).max(axis=1, keepdims=True)
        y = y * (longest / np.sqrt((y * y).sum(1)))[:, None]
        return np.hstack([y, np.zeros((len(y), 1))]).astype(np.float32)
    y = v / scale
    length = (y * y).sum(1)
    return np.hstack([y, np.sqrt(np.maximum(longest**2 - length, 0.0))[:, None]]).astype(np.float32)


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [np.asarray(c.flatten()) for c in chunks]
    return (np.concatenate(flat) if flat else np.zeros(0)).reshape(rows, -1) if rows else np.zeros((0, 0))


def _packed_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


class Index:
    """The index of a table: what the vectors were scaled by, the posting lists and the graph of their centroids."""

    def __init__(self, vectors: DataFrame, dim: int, aim: int = LIST) -> None:
        """``vectors``: (rep, v), different vectors of ``dim`` components, none of them zero."""
        self.spark, self.dim = vectors.sparkSession, dim
        n, self.scale = vectors.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
        self.scale = self.scale or 1.0
        scaled = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.lit(self.scale)) * (x / F.lit(self.scale)))
        self.longest = float((vectors.agg(F.max(scaled)).first()[0] or 1.0) ** 0.5)
        lists = max(1, min(-(-n // aim), CENTROID_BYTES // (4 * (dim + 1)), SAMPLE // 4))
        picked = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
        self._connect(self._fitted(picked.select(F.lit(0).cast("long").alias("list"), "rep", "v"), {0: lists}).collect())
        self.postings = self._posted(vectors)
        long_ = {r["list"]: r["n"] for r in self.postings.where("first").groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > 2 * aim).collect()}
        room = CENTROID_BYTES // (4 * (dim + 1)) - len(self.graph.centroids)
        shares = {i: min(-(-m // aim), LIST_SAMPLE // 4) for i, m in long_.items()}
        if shares and sum(shares.values()) <= room:
            order = Window.partitionBy("list").orderBy(F.xxhash64("rep"), "rep")
            parted = self.spark.createDataFrame([(i,) for i in shares], "list long")
            own = self.postings.where("first").join(parted, "list", "left_semi").withColumn("n", F.row_number().over(order))
            sample = own.where(F.col("n") <= LIST_SAMPLE).join(vectors, "rep").select("list", "rep", "v")
            found = self._fitted(sample, shares).collect()
            kept = [{"list": i, "place": 0, "centroid": c.tobytes()} for i, c in enumerate(self.graph.centroids) if i not in shares]
            self._connect([*kept, *(r.asDict() for r in found)])
            self.postings = self._posted(vectors)

    def _fitted(self, sample: DataFrame, shares: dict[int, int]) -> DataFrame:
        """(list, place, centroid): the sample of every list parted into its share; the samples are bounded."""
        scale, longest = self.scale, self.longest
        schema = pa.schema([("list", pa.int64()), ("place", pa.int64()), ("centroid", pa.binary())])

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("rep")
            found = halved(lifted(_matrix(rows.column("v"), rows.num_rows), scale, longest, False), shares[key[0].as_py()])
            return pa.table({"list": [key[0].as_py()] * len(found), "place": list(range(len(found))),
                             "centroid": [c.astype(np.float32).tobytes() for c in found]}, schema=schema)

        return sample.groupBy("list").applyInArrow(run, "list long, place long, centroid binary")

    def _connect(self, rows: list) -> None:
        """The graph of the centroids; its edges are found by Spark, a slice of centroids to a task."""
        rows = sorted(rows, key=lambda r: (r["list"], r["place"]))
        centroids = np.frombuffer(b"".join(r["centroid"] for r in rows), np.float32).reshape(len(rows), self.dim + 1)
        held = self.spark.sparkContext.broadcast(centroids)
        schema = pa.schema([("place", pa.int64()), ("near", pa.list_(pa.int32()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            k = min(NEIGHBOURS, len(c) - 1)
            squares = (c * c).sum(1)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    own = batch.column(0).to_numpy()[at:at + 256]
                    d = squares - 2 * (c[own] @ c.T)
                    d[np.arange(len(own)), own] = np.inf
                    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(own), 0), int)
                    yield pa.record_batch([pa.array(own), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], schema=schema)

        found = self.spark.range(len(rows)).mapInArrow(run, "place long, near array<int>").collect()
        near = np.array([r["near"] for r in sorted(found, key=lambda r: r["place"])], np.int32).reshape(len(rows), -1)
        # edges lead both ways at least along the order of the lists, so that every centroid can be reached
        line = np.stack([np.maximum(np.arange(len(rows)) - 1, 0), np.minimum(np.arange(len(rows)) + 1, len(rows) - 1)], axis=1)
        self.graph = Graph(centroids, np.hstack([near, line.astype(np.int32)]))
        self.shared = self.spark.sparkContext.broadcast((centroids, self.graph.near))

    def _mapped(self, rows: DataFrame, query: bool, ratio: float, most: int | None) -> DataFrame:
        """(rep, y, lists): the scaled vectors with the lists within the ratio, nearest first."""
        held, scale, longest = self.shared, self.scale, self.longest
        schema = pa.schema([("rep", pa.int64()), ("y", pa.binary()), ("lists", pa.list_(pa.int64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = Graph(*held.value)
            size = max(1, min(256, (1 << 24) // len(graph.centroids)))
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    y = lifted(_matrix(part.column("v"), part.num_rows), scale, longest, query)
                    ids, _ = graph.search(y, ratio)
                    lists = [[i for i in r if i >= 0][:most] for r in ids.tolist()]
                    yield pa.record_batch([part.column("rep"), pa.array([r.tobytes() for r in y], pa.binary()), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

        return rows.select("rep", "v").mapInArrow(run, "rep long, y binary, lists array<long>")

    def _posted(self, vectors: DataFrame) -> DataFrame:
        """(list, rep, y, first): every vector in its list and, near a boundary, in further ones."""
        mapped = self._mapped(vectors, False, BOUNDARY, REPLICAS)
        return stored(mapped.select("rep", "y", F.posexplode("lists").alias("n", "list")).select("list", "rep", "y", (F.col("n") == 0).alias("first")), "postings")

    def search(self, queries: DataFrame, k: int, prune: float = PRUNE) -> DataFrame:
        """(asked, rep): at least the k best found for each query (rep, v), a few more where lists overlap."""
        probes = stored(self._mapped(queries, True, prune, None), "probes")
        pieces = self.postings.groupBy("list").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
        lists = stored(pieces, "lists")

        def scan(asked: DataFrame) -> DataFrame:
            """``asked``: (rep, y, least, list). Queries and vectors of a list meet in groups of a bounded size."""
            parts = asked.groupBy("list").agg(F.ceil(F.count("*") / ASKED).alias("parts"))
            sizes = stored(lists.join(parts, "list"), "sizes")
            one = F.lit(1).cast("long")
            left = asked.join(sizes, "list").select(
                "list", F.pmod(F.xxhash64("rep"), "parts").alias("part"), F.explode(F.sequence(one * 0, F.col("pieces") - 1)).alias("piece"), "rep", "y", "least")
            right = self.postings.join(sizes, "list").select(
                "list", F.explode(F.sequence(one * 0, F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("rep"), "pieces").alias("piece"), "rep", "y")
            by = ["list", "part", "piece"]
            return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_scanned(k), "asked long, rep long, score float")

        def best(found: DataFrame) -> DataFrame:
            once = found.groupBy("asked", "rep").agg(F.max("score").alias("score"))
            order = Window.partitionBy("asked").orderBy(F.col("score").desc(), "rep")
            return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)

        near = probes.select("rep", "y", F.lit(None).cast("float").alias("least"), F.explode(F.slice("lists", 1, FIRST)).alias("list"))
        begun = stored(best(scan(near)), "begun")
        least = begun.where(F.col("n") == k).select(F.col("asked").alias("rep"), F.col("score").alias("least"))
        rest = probes.where(F.size("lists") > FIRST).join(least, "rep", "left").select(
            "rep", "y", "least", F.explode(F.slice("lists", FIRST + 1, F.size("lists"))).alias("list"))
        return best(begun.select("asked", "rep", "score").union(scan(rest))).select("asked", "rep")


def _scanned(k: int):
    schema = pa.schema([("asked", pa.int64()), ("rep", pa.int64()), ("score", pa.float32())])

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return schema.empty_table()
        ids, c = rows.column("rep").to_numpy(), _packed_rows(rows.column("y"))
        out = []
        for at in range(0, asked.num_rows, 256):
            part = asked.slice(at, 256)
            own, q = part.column("rep").to_numpy(), _packed_rows(part.column("y"))
            least = np.nan_to_num(np.array(part.column("least").to_pylist(), np.float32), nan=-np.inf)
            scores = q @ c.T
            good = scores >= least[:, None]
            if scores.shape[1] > k:
                good &= scores >= np.partition(scores, -k, axis=1)[:, -k:][:, :1]
            i, j = np.nonzero(good)
            out.append(pa.table({"asked": own[i], "rep": ids[j], "score": scores[i, j]}, schema=schema))
        return pa.concat_tables(out)

    return run


def nearest(rows: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, prune: float = PRUNE, aim: int = LIST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for the rows for which ``asked`` holds.

    Ties go to the smaller key; a query never meets rows of its own key. Scores are summed component by component in double
    precision. Rows with a null key, a null or zero vector or with a null or non-finite component take no part, nor do
    vectors of another length than most have (the longer in a tie). Equal vectors are searched once, and each of them brings
    its first k + 1 keys, which are all that k results can need. Rows that repeat key and vector are candidates each. An empty
    table gives no rows. Other columns are read by ``asked`` only.
    """
    usable = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).where(
        "id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    held = stored(usable, "vectors")
    sizes = held.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["dim"]
    held = held.where(F.size("v") == dim)
    order = Window.partitionBy("v").orderBy("id")
    members = stored(held.select("id", "v", F.row_number().over(order).alias("n")).where(F.col("n") <= k + 1).withColumn(
        "rep", F.min("id").over(Window.partitionBy("v"))), "members")
    # different vectors may share their least key
    named = stored(members.where("n = 1").select(F.monotonically_increasing_id().alias("rep"), "v"), "different")
    keyed = stored(members.join(named.select(F.col("rep").alias("r"), "v"), "v").select(F.col("r").alias("rep"), "id"), "keys")
    queries = stored(held.where("asked").join(named, "v").select("rep", "id").distinct(), "queries")
    index = Index(named, dim, aim)
    found = index.search(named.join(queries.select("rep").distinct(), "rep", "left_semi"), k + 1, prune)
    scored = stored(found.join(named, "rep").join(named.select(F.col("rep").alias("asked"), F.col("v").alias("q")), "asked").select(
        "asked", "rep", F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x).alias("score")), "scored")
    pairs = queries.withColumnsRenamed({"rep": "asked", "id": "query_id"}).join(scored, "asked").join(
        keyed.withColumnRenamed("id", "vec_id"), "rep").where("query_id <> vec_id")
    last = Window.partitionBy("query_id", "asked").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(last).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by 20."""
    return nearest(embeddings, F.col("vec_id") % EVERY == 0)
