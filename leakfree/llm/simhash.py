"""SimHash fingerprints linked by covering locality-sensitive hashing.

A covering family for radius r assigns every fingerprint bit a non-zero vector of r + 1 bits. For each
non-zero vector v of r + 1 bits the table v keeps the bits whose vector has an odd product with v. The
bits in which two fingerprints within the radius differ put at most r linear conditions on v, so that
some non-zero v meets all of them: in that table the two agree. No pair within the radius is missed.

Fingerprints are collapsed to distinct values first. Tables of a bucket of up to ``BUCKET`` distinct
fingerprints are compared inside a task, which emits a spanning forest of the links, never all pairs.
Larger buckets are split by a second covering family over the bits that their table leaves open, and so on;
a family roughly halves the open bits, so the third level has too few for a large bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import hex16, sorted_groups
from .components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
BUCKET = 4096
BITS = 64
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one UTF-8 text; zero for null or a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    total, half = np.zeros(BITS, np.int64), len(words) - shingle + 1
    spans = list(zip(starts, ends[shingle - 1:], strict=False))
    for i in range(0, len(spans), _BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans[i:i + _BLOCK]], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > half, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): one row per row of ``docs``; fp is the fingerprint as a signed 64-bit value."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py()) for t in batch.column(1)]
            fps = np.array(values, dtype="<u8").view("<i8")
            yield pa.record_batch([batch.column(0), pa.array(fps)], schema=schema)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary")).mapInArrow(run, "key long, fp long")


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """The masks of the covering family over the set bits of ``free``.

    Unit vectors come first, so that with more than ``radius`` bits no mask is empty.
    """
    bits = [i for i in range(BITS) if free >> i & 1]
    size = (1 << (radius + 1)) - 1
    order = sorted(range(1, size + 1), key=lambda x: (x.bit_count() > 1, x))
    vectors = [order[j % size] for j in range(len(bits))]
    return [sum(1 << b for b, x in zip(bits, vectors, strict=True) if (x & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    open_ = np.ones(len(fps), bool)
    edges = []
    for first in range(len(fps)):
        if not open_[first]:
            continue
        open_[first] = False
        queue = [first]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(open_)
            if not len(rest):
                break
            near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= radius]
            open_[near] = False
            queue += near.tolist()
            edges += [(i, int(j)) for j in near]
    return edges


def _bucket_edges(radius: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for _, group in sorted_groups(batches, ["t", "masked"]):
            fps = group.column("fp").to_numpy().view(np.uint64)
            for i, j in _forest(fps, radius):
                us.append(int(fps[i].view(np.int64)))
                vs.append(int(fps[j].view(np.int64)))
            if len(us) >= _BLOCK:
                yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)
                us, vs = [], []
        yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)

    return run


def _split(radius: int):
    """Rows of (t, masked, fp, kept) dealt to the covering tables over the bits outside ``kept``."""
    schema = pa.schema([("t", pa.int64()), ("masked", pa.int64()), ("fp", pa.int64()), ("kept", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column("t").to_numpy()
            fps, kept = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "kept"))
            for k in np.unique(kept):
                rows = kept == k
                if int(k) not in masks:
                    masks[int(k)] = np.array(covering_masks(~int(k) & ((1 << 64) - 1), radius), np.uint64)
                for n, m in enumerate(masks[int(k)]):
                    both = m | k
                    yield pa.record_batch([
                        pa.array(t[rows] * 32 + n), pa.array((fps[rows] & both).view(np.int64)),
                        pa.array(fps[rows].view(np.int64)), pa.array(np.full(rows.sum(), both).view(np.int64)),
                    ], schema=schema)

    return run


def _sized(keys: DataFrame) -> DataFrame:
    """The rows of buckets of two and more, with the bucket's size.

    Both sides are shuffled: the planner takes the tables of a fingerprint for as large as the fingerprint, and would send all of them
    to the driver.
    """
    counts = keys.groupBy("t", "masked").agg(F.count("*").alias("n")).where("n > 1")
    return stored(keys.hint("merge").join(counts, ["t", "masked"]), "buckets")


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links among the distinct fingerprints ``fp`` that connect all those within the radius.

    A bucket that leaves no more than ``radius`` bits open has at most 2^radius members; ``bucket`` must
    be as large, so that a bucket to be split always has bits to split by.
    """
    if bucket < 1 << radius:
        raise ValueError(f"bucket must be at least {1 << radius}")
    masks = covering_masks((1 << BITS) - 1, radius)
    tables = F.posexplode(F.array(*[
        F.struct(F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("masked"), F.lit(_signed(m)).alias("kept"))
        for m in masks
    ])).alias("t", "x")
    keys = distinct.select("fp", tables).select(F.col("t").cast("long").alias("t"), "x.masked", "fp", "x.kept")
    edges = []
    while True:
        sized = _sized(keys)
        small = sized.where(F.col("n") <= bucket).select("t", "masked", "fp").repartition("t", "masked")
        edges.append(small.sortWithinPartitions("t", "masked").mapInArrow(_bucket_edges(radius), "u long, v long"))
        large = sized.where(F.col("n") > bucket)
        if large.isEmpty():
            break
        keys = large.select("t", "masked", "fp", "kept").mapInArrow(_split(radius), "t long, masked long, fp long, kept long")
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def simhash_components(
    docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, bucket: int = BUCKET,
) -> DataFrame:
    """(key, fp, component): every row's fingerprint and the smallest key reachable over links.

    Fingerprints within ``radius`` bits link. Null texts and texts without words have fingerprint zero and
    link like any other. Rows with a null key get the component of their fingerprint and are never its name
    (null if no linked row has a key). Repeated rows are kept, each with the same result. An empty table
    gives no rows. Columns other than key and text are not read.
    """
    prints = stored(fingerprints(docs, text, key), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    parts = connected_components(links(distinct, radius, bucket))
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = stored(rooted.join(named, "root").select("fp", "component"), "classes")
    return prints.join(classes, "fp").select("key", "fp", "component")


def op8_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return simhash_components(docs).select(
        F.col("key").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
