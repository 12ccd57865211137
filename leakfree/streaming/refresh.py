"""The lake kept fresh by file streams.

Both streams stop when the files present at the start are processed (``availableNow``), so a scheduler
can run them as incremental batches; the checkpoint remembers what was already read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.contracts import validate
from ..sources.provenance import publish
from ..sources.registry import Dataset
from ..sources.versions import VersionedParts

BUCKET, BUCKETS = "key_bucket", 64
FILE = "source_file"


def file_stream(spark: SparkSession, path: str, schema: StructType | str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the parquet files of a folder; the column ``source_file`` names the file of each row."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn(FILE, F.col("_metadata.file_name"))


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available now in micro-batches and stop."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def refresh_lake(landing: DataFrame, target: str, dataset: Dataset, checkpoint: str,
                 normalise: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Publish arriving files of a seasonal dataset.

    The lake is parted by season and source file: files of a season add up, in whatever batches and runs
    they arrive, and only a file of the same name replaces an earlier one. A batch that is repeated
    after a failure writes the same partitions again. ``normalise`` must keep the column ``source_file``. A
    batch that breaks the contract fails the stream before anything is replaced, and is read again
    on the next run. ``checkpoint`` must be the same folder in every run.
    """
    parts = [*([dataset.partition] if dataset.partition else []), FILE]

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        df = normalise(batch)
        if FILE not in df.columns:
            raise ValueError(f"normalise dropped {FILE}")
        validate(df, dataset)
        publish(df, target, parts)

    run_available(landing, handle, checkpoint)


def latest_by_key(stream: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key; on a stream a running aggregation with one row of state per key."""
    rest = [c for c in stream.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__v")
    return stream.groupBy(*key).agg(newest).select(*key, "__v.*")


class LatestTable:
    """The newest row per key, in hash buckets of the key.

    A batch rewrites only the buckets its keys fall into, so what is written grows with the batch and not with the table. All
    buckets of a batch become current at once. Merging a batch again, after a failure, changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], order: Sequence[str], buckets: int = BUCKETS):
        self.key, self.order, self.buckets = list(key), list(order), buckets
        self.columns = schema.names
        self.schema = StructType([*schema, StructField(BUCKET, IntegerType())])
        self.parts = VersionedParts(spark, path, [BUCKET])

    def merge(self, batch: DataFrame, batch_id: int = 0) -> None:
        if batch.isEmpty():
            return
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        new = batch.select(*self.columns).withColumn(BUCKET, bucket)
        touched = [f"{BUCKET}={r[0]}" for r in new.select(BUCKET).distinct().collect()]  # at most the buckets
        rows = self.parts.read(self.schema, touched).unionByName(new)
        self.parts.replace(latest_by_key(rows, [*self.key, BUCKET], self.order).select(*self.schema.names))

    def current(self) -> DataFrame:
        return self.parts.read(self.schema).select(*self.columns)


def upsert_latest(stream: DataFrame, path: str, key: Sequence[str], order: Sequence[str], checkpoint: str, buckets: int = BUCKETS) -> LatestTable:
    """Run the stream into a :class:`LatestTable`; ``checkpoint`` and ``buckets`` must be the same in every run."""
    table = LatestTable(stream.sparkSession, path, stream.schema, key, order, buckets)
    run_available(stream, table.merge, checkpoint)
    return table
