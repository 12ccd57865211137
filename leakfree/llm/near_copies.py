"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, and what they connect.

Candidates come from several fingerprints: 64-bit SimHashes within the covering radius, and ``BANDS`` hashes of
``ROWS`` minima each of the shingles under random multipliers. Texts of similarity s share some band with
probability 1 - (1 - s^ROWS)^BANDS, which is 0.998 at 0.8. One byte of each minimum is kept as a sketch; a candidate whose
sketches agree in fewer than ``AGREEING`` of them is dropped before any text moves (at 0.8 the chance of that is below 1e-6).
The others are checked by the similarity of the entire shingle sets before they link, the most promising first; pairs that
are connected by then need no check. The texts of a band meet one leading text first; the texts of bands that hold several
components after that meet ``LEADERS`` others of different components. What is apart then is compared without leaders: of the bands that
still hold several components all texts meet by their sketches, in cells of ``CELL`` by ``CELL``, and all texts of the components that alike
sketches connect meet by their entire sets, in cells too. A cell returns what connects its components, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import Scratch, scratch, stored
from .common import sorted_groups
from .components import connected_components
from .simhash import fingerprint, links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
AGREEING = 72
LEADERS = 4
CELL, CELL_BYTES = 256, 1 << 22
"""Texts on either side that are compared at a time, and about so many bytes of them, compressed."""
_BLOCK = 2048
_MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The different 64-bit hashes of the shingles, sorted; a shorter text is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words))] if words else [], np.uint64)
    n = len(words) - SHINGLE + 1
    ids = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        mixed = (mixed ^ ids[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minima_of(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each multiplier."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, (hashes[i:i + _BLOCK, None] * _MULTIPLIERS).min(axis=0))
    return least


def bands_of(least: np.ndarray) -> list[int]:
    """One signed 64-bit value per band."""
    return [xxhash.xxh64_intdigest(row.tobytes(), n) - (1 << 63) for n, row in enumerate(least.reshape(BANDS, ROWS))]


def sketch_of(least: np.ndarray) -> bytes:
    """One byte of each minimum; its high ones say little, as minima are small."""
    return (least >> np.uint64(20)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; two empty sets are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


_SIGNED = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("packed", pa.binary())])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # few texts are Python strings at a time
            part = batch.slice(at, 256)
            rows = []
            for key, text in zip(part.column("key").to_pylist(), part.column("text"), strict=True):
                plain = b" ".join((text.as_py() or b"").split())
                found = shingles(plain)
                least = minima_of(found)
                rows.append({
                    "key": key, "d": xxhash.xxh64_intdigest(plain) - (1 << 63), "fp": int(np.uint64(fingerprint(plain, SHINGLE)).view(np.int64)),
                    "bands": bands_of(least) if len(found) else [], "sketch": sketch_of(least), "packed": pack(plain)})
            yield pa.RecordBatch.from_pylist(rows, schema=_SIGNED)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates whose sketches agree often enough, and how often they do."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("a", "b"))
        agree = (a == b).sum(axis=1)
        found = batch.drop_columns(["a", "b"]).append_column("agree", pa.array(agree, pa.int32()))
        yield found.filter(pa.array(agree >= AGREEING))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates that are similar enough."""
    unpack = zstandard.ZstdDecompressor().decompress
    lead, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        linked = []
        for v, a, b in zip(batch.column("v").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
            if v != lead:
                lead, own = v, shingles(unpack(b.as_buffer()))
            linked.append(similarity(shingles(unpack(a.as_buffer())), own) >= SIMILARITY)
        yield batch.drop_columns(["a", "b"]).filter(pa.array(linked, pa.bool_()))


class _Labels:
    """The components of a cell's texts; ``join`` says whether two were apart, and makes them one."""

    def __init__(self, components: list[int]) -> None:
        self.of = components
        self._root = {c: c for c in components}

    def root(self, at: int) -> int:
        c = self.of[at]
        while self._root[c] != c:
            self._root[c] = c = self._root[self._root[c]]
        return c

    def join(self, a: int, b: int) -> bool:
        x, y = self.root(a), self.root(b)
        self._root[x] = y
        return x != y


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _met(cell: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(a text, those it meets that are in another component and whose sketches are alike, how often they agree) of a cell.

    A cell of two blocks has the texts of one meet those of the other, a cell of one block has all of its texts meet.
    """
    side, own = cell.column("side").to_numpy(), cell.column("c").to_numpy()
    sketches = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(cell.num_rows, -1)
    right = np.flatnonzero(side)
    for n in np.flatnonzero(side == 0).tolist() if len(right) else range(cell.num_rows - 1):
        others = right if len(right) else np.arange(n + 1, cell.num_rows)
        others = others[own[others] != own[n]]
        agree = (sketches[others] == sketches[n]).sum(axis=1)
        yield n, others[agree >= AGREEING], agree[agree >= AGREEING]


def _alike_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): components that texts with alike sketches connect, of every cell as many as make it one."""
    rows = []
    for _, cell in sorted_groups(batches, ["b", "i", "j"]):
        labels = _Labels(cell.column("c").to_pylist())
        for n, others, _ in _met(cell):
            rows += [{"u": labels.of[n], "v": labels.of[m]} for m in others.tolist() if labels.join(n, m)]
        if len(rows) > 4096:
            yield pa.RecordBatch.from_pylist(rows, schema=_EDGES)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=_EDGES)


def _linked_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): components that near copies connect, of every cell as many as make it one; the most promising texts come first."""
    unpack = zstandard.ZstdDecompressor().decompress
    for _, cell in sorted_groups(batches, ["g", "i", "j"]):
        labels, packed, rows, sets = _Labels(cell.column("c").to_pylist()), cell.column("packed"), [], {}

        def of(n: int) -> np.ndarray:
            if n not in sets:  # noqa: B023
                sets[n] = shingles(unpack(packed[n].as_buffer()))  # noqa: B023
            return sets[n]  # noqa: B023

        met = [(np.full(len(others), n), others, agree) for n, others, agree in _met(cell)]
        if met:
            ones, others, agree = (np.concatenate(x) for x in zip(*met, strict=True))
            order = np.argsort(-agree, kind="stable")
            for n, m in zip(ones[order].tolist(), others[order].tolist(), strict=True):
                if labels.root(n) != labels.root(m) and similarity(of(n), of(m)) >= SIMILARITY:
                    labels.join(n, m)
                    rows.append({"u": labels.of[n], "v": labels.of[m]})
        yield pa.RecordBatch.from_pylist(rows, schema=_EDGES)


def _beside(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The pairs with what both ends hold in ``column``."""
    return pairs.join(values.select(F.col("row").alias("u"), F.col(column).alias("a")), "u").join(
        values.select(F.col("row").alias("v"), F.col(column).alias("b")), "v").select(*pairs.columns, "a", "b")


def _similar(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs, a stored table, whose entire texts are near copies; only texts of the pairs move."""
    ends = pairs.select(F.col("u").alias("row")).union(pairs.select("v"))
    texts = stored(signed.select("row", "packed").join(ends, "row", "left_semi"), "texts")
    return stored(_beside(pairs, texts, "packed").sortWithinPartitions("v").mapInArrow(_checked, pairs.schema), "links")


def _promising(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose sketches are alike, and how much (agree)."""
    schema = StructType([*pairs.schema.fields, StructField("agree", IntegerType())])
    return stored(_beside(pairs, signed, "sketch").mapInArrow(_alike, schema), "alike")


def _first_components(candidates: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) that the near copies among the candidates make, and the candidates as pairs.

    Every text is checked against its most promising partner first. What that connects needs no further check, the rest is checked.
    """
    pairs = stored(candidates.where("u <> v").distinct(), "candidates")
    alike = _promising(pairs, signed)
    best = stored(alike.groupBy("u").agg(F.max(F.struct("agree", "v")).alias("best")).select("u", "best.v"), "best")
    found = _similar(best, signed)
    parts = stored(connected_components(found), "parts")
    apart = _placed(_placed(alike.select("u", "v").join(best, ["u", "v"], "left_anti"), "u", parts, "c"), "v", parts, "vc").where("c <> vc")
    more = _similar(stored(apart.select("u", "v", "c", "vc"), "apart"), signed)
    return (parts if more.isEmpty() else _merged(parts, more.select(F.col("c").alias("u"), F.col("vc").alias("v")))), pairs


def _merged(parts: DataFrame, found: DataFrame) -> DataFrame:
    """``parts`` with the components that the edges (u, v) between components connect; only what changes is worked on."""
    joined = stored(connected_components(found), "joined")
    alone = joined.join(parts, "node", "left_anti")
    return _relabelled(parts, "component", joined).select("node", "component").union(alone)


def _joined(met: DataFrame, signed: DataFrame) -> DataFrame:
    """(u, v): the components that near copies among the pairs (u, v, x, y) connect; x and y are the pair's components.

    The most promising pair of two components is checked first, their other pairs only where it is none of near copies.
    """
    alike = _promising(met, signed)
    best = stored(alike.groupBy("x", "y").agg(F.max(F.struct("agree", "u", "v")).alias("best")).select("x", "y", "best.u", "best.v"), "best")
    found = _similar(best, signed)
    rest = stored(alike.join(found, ["x", "y"], "left_anti").join(best, ["x", "y", "u", "v"], "left_anti").select("u", "v", "x", "y"), "rest")
    if not rest.isEmpty():
        found = found.unionByName(_similar(rest, signed))
    return found.select(F.col("x").alias("u"), F.col("y").alias("v"))


def _by_fingerprint(texts: DataFrame) -> DataFrame:
    """Texts of one fingerprint with the first of them, and the first ones of near fingerprints."""
    distinct = stored(texts.groupBy("fp").agg(F.min("row").alias("first")), "distinct")
    same = texts.join(distinct, "fp").select(F.col("row").alias("u"), F.col("first").alias("v"))
    near = links(distinct).join(distinct.select(F.col("fp").alias("u"), F.col("first").alias("x")), "u").join(
        distinct.select(F.col("fp").alias("v"), F.col("first").alias("y")), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    return same.union(near)


def _first_leaders(bands: DataFrame) -> DataFrame:
    """(b, v): the leading text of every band; bands that share texts share a leader."""
    order = F.struct(F.xxhash64("d", F.lit(0)), "d")
    return bands.groupBy("b").agg(F.min(order).alias("l")).select("b", F.col("l.d").alias("v"))


def _leaders(placed: DataFrame, turn: int) -> DataFrame:
    """(b, v, vc): ``LEADERS`` texts of different components, and those, of every band that holds several components.

    A band leads with texts of its own, so that few rounds are left; one of up to ``LEADERS`` components has all of them meet.
    """
    order = F.struct(F.xxhash64("d", F.lit(turn), "b"), "d")
    own = placed.groupBy("b", "c").agg(F.min(order).alias("l"))
    several = own.groupBy("b").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("b")
    first = Window.partitionBy("b").orderBy("l")
    return own.join(several, "b", "left_semi").withColumn("place", F.row_number().over(first)).where(F.col("place") <= LEADERS).select(
        "b", F.col("l.d").alias("v"), F.col("c").alias("vc"))


def _placed(rows: DataFrame, column: str, parts: DataFrame, into: str) -> DataFrame:
    """``rows`` with the component of ``column`` in ``into``; a text without one is its own."""
    to = parts.select(F.col("node").alias(column), F.col("component").alias("to"))
    return rows.join(to, column, "left").withColumn(into, F.coalesce("to", column)).drop("to")


def _relabelled(rows: DataFrame, column: str, parts: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its component."""
    return _placed(rows, column, parts, column)


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))


def _cells(members: DataFrame, by: str) -> DataFrame:
    """``members`` dealt to cells (``by``, i, j), in order: any two of a group meet in one, as texts of one block or of two (side 0 and 1).

    A text is in as many cells as its group has blocks of CELL texts or CELL_BYTES of packed ones.
    """
    parts = [F.count("*") / CELL] + [F.sum(F.length("packed")) / CELL_BYTES] * ("packed" in members.columns)
    sizes = members.groupBy(by).agg(F.ceil(F.greatest(*parts) if len(parts) > 1 else parts[0]).alias("blocks"))
    dealt = members.join(sizes, by).withColumn("own", F.pmod(F.xxhash64("d", F.lit(0)), "blocks"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = met.select(*members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return cells.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j")


def _apart(placed: DataFrame, signed: DataFrame) -> DataFrame:
    """(u, v): the components that near copies connect, of the texts (b, d, c) of bands that hold several components.

    Any two of a band are compared, by sketches and then by the entire texts of all components that alike sketches connect.
    """
    sketched = placed.join(signed.select(F.col("row").alias("d"), "sketch"), "d")
    alike = stored(_cells(sketched, "b").mapInArrow(_alike_components, "u long, v long"), "alike")
    groups = connected_components(alike).select(F.col("node").alias("c"), F.col("component").alias("g"))
    members = stored(placed.select("d", "c").distinct().join(groups, "c"), "members")
    texts = stored(members.join(signed.select(F.col("row").alias("d"), "sketch", "packed"), "d"), "texts")
    return stored(_cells(texts, "g").mapInArrow(_linked_components, "u long, v long"), "links")


def _components(texts: DataFrame, signed: DataFrame, block: Scratch) -> DataFrame:
    """(node, component): of every text that is linked to another."""
    with scratch(block.spark) as first:
        bands = texts.select(F.explode("bands").alias("b"), F.col("row").alias("d"))
        shared = bands.groupBy("b").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x <> y").select("b")
        # both sides are shuffled: the planner takes the bands of a text for one value, and would send all of them to the driver
        several = first.keep(bands.hint("merge").join(shared, "b", "left_semi").withColumn("c", F.col("d")), "bands")
        by_band = several.join(stored(_first_leaders(several), "leaders"), "b").select(F.col("d").alias("u"), "v")
        parts, pairs = _first_components(_by_fingerprint(texts).union(by_band), signed)
        parts, tried = first.keep(parts, "parts"), first.keep(_unordered(pairs), "tried")
    with scratch(block.spark) as own:
        placed = stored(_relabelled(several, "c", parts), "bands")
        leaders = stored(_leaders(placed, 1), "leaders")
        several = own.keep(placed.join(leaders.select("b"), "b", "left_semi"), "bands")
        met = several.join(leaders, "b").where("c <> vc").select(F.col("d").alias("u"), "v", "c", "vc").distinct()
        # a pair that is still apart after its check is no link
        new = stored(met.withColumns({"x": F.least("u", "v"), "y": F.greatest("u", "v")}).join(tried, ["x", "y"], "left_anti").select(
            "u", "v", F.least("c", "vc").alias("x"), F.greatest("c", "vc").alias("y")), "new")
        parts = own.keep(_merged(parts, _joined(new, signed)), "parts")
    with scratch(block.spark) as own:
        placed = stored(_relabelled(several, "c", parts), "bands")
        open_ = placed.groupBy("b").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("b")
        found = _apart(stored(placed.join(open_, "b", "left_semi"), "apart"), signed)
        return parts if found.isEmpty() else own.keep(_merged(parts, found), "parts")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, component): every row's smallest key reachable over links between near copies.

    Null texts and texts without words are equal to each other. Rows with a null key get the component of their
    text and are never its name (null if no linked row has a key). Repeated rows are kept, each with the same
    result. An empty table gives no rows. Columns other than key and text are not read. Texts are told apart
    by 64-bit hashes of their words; letters outside ASCII keep their case. Any two texts that share a band are compared; a pair that
    shares none, and no link of fingerprints, stays unlinked unless others connect it. The result is a table; what was written on the way is gone.
    """
    spark = docs.sparkSession
    with scratch(spark) as block:
        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
        signed = stored(rows.mapInArrow(
            _signatures, "key long, d long, fp long, bands array<long>, sketch binary, packed binary").withColumn(
                "row", F.monotonically_increasing_id()), "signed")
        # rounds work on ever smaller tables: none needs more tasks to be written than the texts themselves
        files = max(signed.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)
        with scratch(spark, files):
            # a text is named by the first row that holds it
            texts = stored(signed.groupBy("d").agg(
                F.min("row").alias("row"), F.min("key").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "texts")
            parts = _components(texts, signed, block)
            rooted = texts.select("d", "least", "row").join(parts.withColumnRenamed("node", "row"), "row", "left").select(
                "d", "least", F.coalesce("component", "row").alias("root"))
            named = rooted.groupBy("root").agg(F.min("least").alias("component"))
            classes = stored(rooted.join(named, "root").select("d", "component"), "classes")
            return block.keep(signed.select("key", "d").join(classes, "d").select("key", "component"), "near")
