"""Merkle manifest of a dataset by butterfly exchange.

Rows become leaves; the leaves of a group, in order, are hashed in runs of ``FANOUT`` until one subroot remains, and the
subroots of the groups likewise until the root. Leaves are dealt to aligned blocks of FANOUT^DEPTH, each one subtree,
which a task hashes by itself. The levels above are a butterfly: in round r every block holds the root of the
subtree of FANOUT^r blocks around it. The blocks of one run that have the same place in their subtrees swap these
roots, and each of them hashes the parent for itself and keeps the others' roots as the next step of its
proof. After the last round every block holds the root and its whole upper proof; nothing is sent down again. In a
subtree that ends early the blocks there are swap for the places that are missing.

A proof is a list of steps (left, right): the parent of x is the hash of left, x and right in this order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordered_prefix
from ..session import stored

FANOUT = 3
DEPTH = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left: string, right: string>>"
_STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def field(value: Column) -> Column:
    """A value as the leaf's hash reads it: ``-`` for null, else its UTF-8 bytes behind their number and a colon."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _parent(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(leaves: list[str], depth: int | None, fanout: int) -> list[list[str]]:
    """The nodes of every level from the leaves up, for ``depth`` levels, or until one node is left."""
    out = [leaves]
    while len(out) <= depth if depth is not None else len(out[-1]) > 1:
        low = out[-1]
        out.append([_parent(low[i:i + fanout]) for i in range(0, len(low), fanout)])
    return out


def steps_of(levels: list[list[str]], place: int, fanout: int) -> list[dict[str, str]]:
    """The proof of the leaf at ``place`` within its block."""
    out = []
    for nodes in levels[:-1]:
        first = place - place % fanout
        out.append({"left": "".join(nodes[first:place]), "right": "".join(nodes[place + 1:first + fanout])})
        place //= fanout
    return out


def _depth(block: int, size: int, fanout: int, depth: int) -> int | None:
    """A block is hashed to its full depth, unless it is the only one of its group and not full."""
    return None if block == 0 and size < fanout**depth else depth


def place_leaves(leaves: DataFrame, order: Sequence[str], fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``leaves`` with ``place`` (from 0, in its group ``g``) and ``block``."""
    numbered = ordered_prefix(leaves, ["g"], [F.col(c) for c in order], {"place": F.lit(1).cast("long")})
    return numbered.withColumn("block", F.floor(F.col("place") / fanout**depth).cast("long"))


def block_roots(placed: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(g, block, node): the root of every block; a block has at most fanout^depth leaves."""
    schema = pa.schema([("g", pa.string()), ("block", pa.int64()), ("node", pa.string())])

    def root(key: tuple, rows: pa.Table) -> pa.Table:
        g, block = (k.as_py() for k in key)
        leaves = rows.sort_by("place").column("leaf").to_pylist()
        top = levels_of(leaves, _depth(block, len(leaves), fanout, depth), fanout)[-1][0]
        return pa.table({"g": [g], "block": [block], "node": [top]}, schema=schema)

    return placed.select("g", "block", "place", "leaf").groupBy("g", "block").applyInArrow(root, "g string, block long, node string")


def butterfly(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(g, block, node, steps): every block with its group's subroot and its proof from the block's root up to it."""
    counts = blocks.groupBy("g").agg(F.count("*").alias("n"))
    state = stored(blocks.join(counts, "g").withColumn("steps", F.array().cast(_STEPS)), "blocks")
    most = state.agg(F.max("n")).first()[0] or 0
    size = 1
    while size < most:
        state = _round(state, size, fanout)
        size *= fanout
    return stored(state.drop("n"), "butterfly")


def _round(state: DataFrame, size: int, fanout: int) -> DataFrame:
    """Subtrees of ``size`` blocks become those of size * fanout. A group is at most one block of each subtree of a run."""
    block, one = F.col("block"), F.lit(size).cast("long")
    tree, low = F.floor(block / size).cast("long"), F.pmod(block, one)
    there = F.least(one, F.col("n") - tree * size)
    alone = (F.pmod(tree, F.lit(fanout)) == 0) & ((tree + 1) * size >= F.col("n"))
    slots = F.when(alone, F.array(low)).otherwise(F.sequence(low, one - 1, there))
    sent = state.select(
        "g", "n", F.floor(tree / fanout).cast("long").alias("run"), F.pmod(tree, F.lit(fanout)).alias("digit"),
        "block", low.alias("low"), "node", "steps", F.explode(slots).alias("slot"))
    own = F.col("slot") == F.col("low")
    member = F.struct("digit", "node", F.when(own, F.col("block")).alias("block"), F.when(own, F.col("steps")).alias("steps"))
    swapped = sent.groupBy("g", "n", "run", "slot").agg(F.sort_array(F.collect_list(member)).alias("members"))

    def nodes(kept) -> Column:
        return F.array_join(F.transform(F.filter("members", kept), lambda m: m["node"]), "")

    met = swapped.select("g", "n", "members", F.explode("members").alias("m")).where("m.block is not null")
    digit, more = F.col("m.digit"), F.col("n") > size
    step = F.struct(nodes(lambda m: m["digit"] < digit).alias("left"), nodes(lambda m: m["digit"] > digit).alias("right"))
    return met.select(
        "g", F.col("m.block").alias("block"), F.when(more, F.sha2(nodes(lambda m: F.lit(True)), 256)).otherwise(F.col("m.node")).alias("node"), "n",
        F.when(more, F.concat("m.steps", F.array(step))).otherwise(F.col("m.steps")).alias("steps"))


def proofs(placed: DataFrame, upper: DataFrame, carried: str, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``carried`` columns of every leaf, ``top`` and ``proof``: the steps within its block, then those of ``upper`` (g, block, node, steps)."""
    names = [c.split()[0] for c in carried.split(", ")]

    def whole(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        leaves, places = rows.column("leaf").to_pylist(), rows.column("place").to_pylist()
        block = rows.column("block")[0].as_py()
        levels = levels_of(leaves, _depth(block, len(leaves), fanout, depth), fanout)
        rest = above.column("steps")[0].as_py()
        first = block * fanout**depth
        found = [steps_of(levels, p - first, fanout) + rest for p in places]
        top = pa.array(above.column("node").to_pylist() * len(found), pa.string())
        return rows.select(names).append_column("top", top).append_column("proof", pa.array(found, _STEP))

    return placed.groupBy("g", "block").cogroup(upper.select("g", "block", "node", "steps").groupBy("g", "block")).applyInArrow(
        whole, f"{carried}, top string, proof {_STEPS}")


def proof_hash(proof: Column) -> Column:
    """The hash of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "source", tampered: Column | None = None,
    fanout: int = FANOUT, depth: int = DEPTH,
) -> DataFrame:
    """(key, leaf, found, subroot, root, proof): every row's leaf over ``fields``, and its proof up to the root.

    Leaves of a group ascend by key, null first, then by leaf; groups ascend by name, null first, in UTF-8 bytes. ``found``
    is the hash of the row as it is found now, with ``tampered`` as the last of its fields (the leaf itself without it). Nulls
    in any field have a mark of their own and differ from empty texts. Repeated rows are leaves of their own. An
    empty table gives no rows. Other columns are not read. No task holds more than a block of fanout^depth leaves.
    """
    values = [F.col(f"`{f}`") for f in fields]
    group_key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = docs.select(
        group_key.alias("g"), F.col(key).cast("long").alias("key"), leaf_hash(values).alias("leaf"),
        leaf_hash([*values[:-1], values[-1] if tampered is None else tampered]).alias("found"))
    placed = stored(place_leaves(leaves, ["key", "leaf"], fanout, depth), "leaves")
    blocks = butterfly(block_roots(placed, fanout, depth), fanout)
    # the groups' subroots are the leaves of the upper tree
    subroots = blocks.groupBy("g").agg(F.min("node").alias("leaf"))
    tops = stored(place_leaves(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "leaf"), ["name"], fanout, depth), "subroots")
    top_blocks = butterfly(block_roots(tops, fanout, depth), fanout)
    above = stored(proofs(tops, top_blocks, "name string", fanout, depth), "tops")
    root = above.agg(F.min("top")).first()[0]
    upper = blocks.join(above.select(F.col("name").alias("g"), "proof"), "g").withColumn("steps", F.concat("steps", "proof"))
    rows = proofs(placed, upper, "key long, leaf string, found string", fanout, depth)
    return rows.withColumnRenamed("top", "subroot").withColumn("root", F.lit(root).cast("string"))


def op13_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A document whose unsigned crc32 of the doc_id in decimal is even is held with its line ends deleted; a null doc_id is not.
    """
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    cut = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_manifest(docs, tampered=cut)
    reached = found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"),
        folded(F.col("found"), F.col("proof")).alias("folded_root"))
    return reached.withColumn("verified", F.col("folded_root") == F.col("root"))
