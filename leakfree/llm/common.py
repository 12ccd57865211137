"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex16(c):
    """A 64-bit value as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of equal keys from batches that are sorted by the keys.

    Only one group and one batch are held at a time. The caller bounds the size of a group.
    """
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[start]:
                continue
            if key is not None and rows[start] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = rows[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield key, pa.Table.from_batches(held)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
