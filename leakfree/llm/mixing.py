"""Mixing sources to target weights by entropy balancing.

Every source gets a target number of words. The rates of its documents are those nearest to one in
relative entropy that meet the target, with no rate above ``CAP``: min(CAP, exp(lambda * size / scale)),
where lambda solves the source's convex dual. All sources are solved at once by Newton steps, each one
aggregation over the (source, size) counts. Rates are then rounded into copies: every document
gets its rate's whole part, and one more copy in the order of (hash - fraction) as long as its words fit
into what the source's target leaves; a few passes let smaller documents fill what a large one left, and at
last the document that brings the words nearest to the target may go beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import null_safe_join, ordered_prefix, row_numbers
from ..session import scratch, stored
from .common import WORD, free_name

WEIGHTS = (1, 2, 3)
CAP = 3
TOLERANCE = 1e-7
STEPS = 100
PASSES = 4


def word_count(text: Column) -> Column:
    """Words of a text, zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target): the shares of all words by repeating weights, with the cap filled up.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. A target stops at ``CAP`` times its
    source's size; the excess is shared anew by weight among the others until none is above.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = row_numbers(sources, [], [F.col("source").isNull(), F.col("source")], "rank")
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighted = stored(ranked.select(
        "source", "source_size", weights.cast("double").alias("weight"), (F.col("source_size") * CAP).cast("double").alias("most")), "sources")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > F.col("most")
        count, kept, free = weighted.agg(
            F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if count == before or not free:
            break
        before, level = count, (total - (kept or 0.0)) / free
    return weighted.select(
        "source", "source_size", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def _rate(lam: Column) -> Column:
    """min(CAP, exp(lambda * size / scale)); a null lambda stands for the cap itself."""
    return F.coalesce(F.least(F.lit(float(CAP)), F.exp(lam * F.col("size") / F.col("scale"))), F.lit(float(CAP)))


def tilts(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, scale, lam): Newton steps on the dual of every source, held inside a bracket.

    ``counts`` has (source, size, n). A source whose target is the cap of all its words has a null ``lam``.
    """
    scaled = counts.groupBy("source").agg(F.greatest(F.sum(F.col("n") * F.col("size")) / F.sum("n"), F.lit(1.0)).alias("scale"))
    state = stored(null_safe_join(targets, scaled, ["source"]).select(
        "source", "target", "scale", F.lit(0.0).alias("lam"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        ((F.col("target") >= F.col("source_size") * CAP) & (F.col("source_size") > 0)).alias("full"),
        F.lit(False).alias("done")), "tilts")
    x = F.col("size") / F.col("scale")
    for _ in range(STEPS):
        words = (F.col("n") * F.col("size")).cast("double")
        rate = _rate(F.col("lam"))
        sums = null_safe_join(counts, state.where("not full and not done"), ["source"]).groupBy("source").agg(
            F.sum(words * rate).alias("taken"),
            F.sum(F.when(rate < CAP, words * x * rate).otherwise(0.0)).alias("slope"))
        error, lam = F.col("taken") - F.col("target"), F.col("lam")
        low = F.when(error < 0, lam).otherwise(F.col("low"))
        high = F.when(error >= 0, lam).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, lam - error / F.col("slope"))
        inside = newton.isNotNull() & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        middle = (F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1)
                  .otherwise((F.col("low") + F.col("high")) / 2))
        stepped = null_safe_join(state, sums, ["source"], "left").withColumns({"low": low, "high": high})
        settled = F.col("full") | F.col("done") | (F.abs(error) <= F.lit(TOLERANCE) * F.col("target"))
        state = stored(stepped.withColumn("done", F.coalesce(settled, F.lit(True))).withColumn(
            "lam", F.when(F.col("done"), lam).when(inside, newton).otherwise(middle)).drop("taken", "slope"), "tilts")
        if state.where("not done").isEmpty():
            break
    return state.select("source", "scale", F.when(~F.col("full"), F.col("lam")).alias("lam"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The rows (key, source, size) of all documents, and the copies of each (key, source, size).

    The second frame has source_size, target, rate and copies (0 to ``CAP``). Rows that agree in key,
    source and size are one unit and get the same copies. Nulls: a null text has size 0, a null source is
    a source of its own, null keys meet null keys. Sources without words have target 0; documents of size 0
    have the copies of their rate's whole part. An empty table gives no rows. The copies depend on the rows
    and ``seed`` alone, so reruns agree.
    """
    rows = stored(docs.select(
        F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    units = rows.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    targets = stored(source_targets(rows), "targets")
    counts = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    solved = null_safe_join(targets, tilts(counts, targets), ["source"])
    rated = null_safe_join(units, stored(solved, "solved"), ["source"]).withColumn("rate", _rate(F.col("lam")))
    order = F.pmod(F.xxhash64(F.lit(seed), "key", "size"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.floor("rate").cast("int")
    current = stored(rated.select(
        "key", "source", "size", "n", "source_size", "target", "rate", whole.alias("copies"),
        F.when(F.col("rate") > F.floor("rate"), order - (F.col("rate") - F.floor("rate"))).alias("turn")), "units")
    words = F.col("n") * F.col("size")
    for _ in range(PASSES):
        left = stored(current.groupBy("source").agg(
            (F.first("target") - F.sum(words * F.col("copies"))).alias("left")), "left")
        open_ = F.col("turn").isNotNull() & (words <= F.col("left")) & (F.col("size") > 0)
        joined = null_safe_join(current, left, ["source"]).withColumn("open", open_)
        prefix = ordered_prefix(
            joined, ["source"], [F.col("turn"), F.col("key"), F.col("size")],
            {"before": F.when(F.col("open"), words).otherwise(F.lit(0))})
        more = F.col("open") & (F.col("before") + words <= F.col("left"))
        current = stored(prefix.withColumn("more", more).select(
            "key", "source", "size", "n", "source_size", "target", "rate",
            (F.col("copies") + F.col("more").cast("int")).alias("copies"),
            F.when(~F.col("more"), F.col("turn")).alias("turn")), "units")
    left = F.col("target") - F.sum(words * F.col("copies"))
    short = stored(current.groupBy("source", "target").agg(left.alias("left")).drop("target"), "left")
    gap = F.abs(F.col("left") - words)
    closer = null_safe_join(current, short, ["source"]).where(F.col("turn").isNotNull() & (F.col("size") > 0) & (gap < F.col("left")))
    last = stored(closer.groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "turn", "key", "size")).alias("x")).select(
        "source", "x.key", "x.size", F.lit(1).alias("last")), "last")
    done = null_safe_join(current, last, ["key", "source", "size"], "left").withColumn(
        "copies", F.col("copies") + F.coalesce("last", F.lit(0)))
    return rows, done.select("key", "source", "size", "source_size", "target", "rate", "copies")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents of the mix: every row of ``docs`` as often as it has copies, with the columns of ``docs``.

    Nulls, repeated rows and sources without words are treated as by ``mix``: rows that agree in key, source and size have
    the same copies. A null text has size 0. Other columns are kept and may have any name. An empty table gives no rows.
    Only the table of copies is left in the shared folder.
    """
    names = ("key", "source", "size", "copies")
    own = {n: free_name(docs, f"mix_{n}") for n in names}
    with scratch(docs.sparkSession) as block:
        _, copies = mix(docs, text, source, key)
        chosen = block.keep(copies.where("copies > 0").select(*names), "copies").withColumnsRenamed(own)
    matched = docs.join(chosen, (
        F.col(key).cast("long").eqNullSafe(F.col(own["key"])) & F.col(source).cast("string").eqNullSafe(F.col(own["source"]))
        & (word_count(F.col(text)) == F.col(own["size"]))))
    again = matched.withColumn(free_name(docs, "mix_copy"), F.explode(F.sequence(F.lit(1), F.col(own["copies"]))))
    return again.select(*[docs[c] for c in docs.columns])


def op10_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows, copies = mix(docs)
    return null_safe_join(rows, copies, ["key", "source", "size"]).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
