"""Publishing datasets and remembering where every file came from."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.ordered import null_safe_join
from ..session import scratch_path
from .contracts import NORMALIZERS, ContractError, validate
from .registry import CONTRACT_VERSION, Dataset
from .versions import PublishError

STREAMED = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
CHUNK = 8 << 20
MANIFEST_KEY = ["path", "bytes", "modified", "contract_version"]


def publish(df: DataFrame, path: str, partition: str | Sequence[str] | None = "season") -> int:
    """Write to a staging table, count it, replace the affected partitions, and count those again.

    The rows written are observed while writing, so the source is read once. The replacement is a
    dynamic partition overwrite: seasons that are not in the frame stay as they are. It is not one
    transaction: after a :class:`PublishError`, or a crash in between, publish again. Where readers must never see a mix,
    use :class:`~leakfree.sources.versions.VersionedParts`.
    """
    spark = df.sparkSession
    parts = [partition] if isinstance(partition, str) else list(partition or [])
    staging = scratch_path(spark, "publish")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(staging)
    staged = spark.read.schema(df.schema).parquet(staging)
    written = staged.count()
    if written != seen.get["rows"]:
        raise PublishError(f"wrote {seen.get['rows']} rows but read {written} back")
    writer = staged.write.mode("overwrite")
    if parts:
        writer = staged.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
    writer.parquet(path)
    live = spark.read.schema(df.schema).parquet(path)
    if parts:
        live = null_safe_join(live.select(*parts), staged.select(*parts).distinct(), parts, "left_semi")
    if (found := live.count()) != written:
        raise PublishError(f"published {written} rows but found {found} in {path}")
    return written


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with size and time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def digests(files: DataFrame) -> DataFrame:
    """``files`` (with ``path``) and the SHA-256 of each file's bytes.

    A file is read by one task, a chunk at a time, through the file systems that pyarrow knows (local, HDFS, S3, GCS, Azure).
    Files of another kind are read by Spark, whole, and are then limited to what a row holds.
    """
    kept = files.schema.names
    schema = StructType([*files.schema, StructField("sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(p) for p in batch.column("path").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], names=[*kept, "sha256"])

    known = F.split_part("path", F.lit(":"), F.lit(1)).isin(*STREAMED)
    streamed = files.where(known).repartition("path").mapInArrow(run, schema)
    whole = files.where(~known)
    if whole.isEmpty():
        return streamed
    paths = [r.path for r in whole.select("path").collect()]
    content = files.sparkSession.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))
    return streamed.unionByName(whole.join(content, "path", "left").select(*kept, "sha256"))


def _digest(path: str) -> str:
    system, where = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    found = hashlib.sha256()
    with system.open_input_stream(where) as stream:
        while chunk := stream.read(CHUNK):
            found.update(chunk)
    return found.hexdigest()


def provenance(spark: SparkSession, path: str, dataset: str, source: str, how: str = "download") -> DataFrame:
    """One manifest row per file: size, time, digest, rows, columns, season and contract version."""
    files = digests(list_files(spark, path))
    data = spark.read.parquet(path)
    season = F.min("season").cast("int") if "season" in data.columns else F.lit(None).cast("int")
    rows = data.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"), season.alias("season"))
    return files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")).join(
        rows.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")), "path", "left").select(
        "path", F.lit(dataset).alias("dataset"), "season", F.lit(source).alias("source"), F.coalesce("rows", F.lit(0)).alias("rows"),
        F.lit(",".join(data.columns)).alias("columns"), "bytes", "modified", "sha256",
        F.lit(how).alias("provenance"), F.lit(CONTRACT_VERSION).alias("contract_version"))


def pending_files(listing: DataFrame, manifest: DataFrame | None, season: str | None = None, refresh_season: int | None = None,
                  force: bool = False) -> DataFrame:
    """Files to ingest: unknown or changed ones, all files without a season, and the running season."""
    tagged = listing.withColumn("contract_version", F.lit(CONTRACT_VERSION))
    if manifest is None or force:
        return tagged
    fresh = tagged.join(manifest.select(*MANIFEST_KEY), MANIFEST_KEY, "left_anti")
    if season is None:
        return fresh
    always = tagged.where(F.col(season).isNull() | (F.col(season) == refresh_season))
    return fresh.unionByName(always).distinct()


def append_manifest(entries: DataFrame, path: str) -> None:
    """Add entries to the manifest; it is only ever appended to."""
    entries.write.mode("append").parquet(path)


def backfill(spark: SparkSession, path: str, dataset: str, source: str, manifest: DataFrame | None) -> DataFrame:
    """Manifest rows for cached files that have none under their current size, time and contract."""
    entries = provenance(spark, path, dataset, source, how="backfilled_from_file_mtime")
    if manifest is None:
        return entries
    return entries.join(manifest.select(*MANIFEST_KEY), MANIFEST_KEY, "left_anti").select(*entries.columns)


def ingest(jobs: Iterable[tuple[Dataset, int | None, Callable[[], DataFrame]]], root: str,
           log: Callable[[str], None] = lambda _: None) -> list[tuple[str, str]]:
    """Normalise, check and publish each (dataset, season, reader); failures are collected, not raised."""
    failures = []
    for dataset, season, read in jobs:
        target = f"{dataset.name}_{season}" if season is not None else dataset.name
        try:
            normalise = NORMALIZERS.get(dataset.name, lambda df, s: df)
            df = normalise(read(), season)
            validate(df, dataset, season)
            rows = publish(df, f"{root.rstrip('/')}/{dataset.name}", dataset.partition)
            log(f"{target}: {rows} rows")
        except (ContractError, PublishError, OSError) as exc:
            failures.append((target, str(exc)))
        except Exception as exc:  # noqa: BLE001 - an unreadable source must not stop the others
            failures.append((target, f"{type(exc).__name__}: {exc}"))
    return failures


def fingerprint(manifest: DataFrame, name: str = "path", digest: str = "sha256") -> DataFrame:
    """One digest over the sorted (file, digest) pairs of a manifest, as of its JSON object.

    ``manifest`` has one row per file of a dataset, as :func:`provenance` makes it; the text that is
    digested has one short entry per file. It is not meant for tables of data rows.
    """
    quoted = F.concat(F.lit('"'), F.col(name), F.lit('":"'), F.col(digest), F.lit('"'))
    entries = F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), quoted.alias("e")))), lambda x: x["e"])
    text = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    return manifest.agg(F.sha2(text, 256).alias("asset_set_sha256"), F.count("*").alias("asset_count"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Experiment records, one JSON document per file; unreadable documents are skipped."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path).withColumn(
        "file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def annotate_records(records: DataFrame, notes: DataFrame, name: str = "file", created: str = "created_at") -> DataFrame:
    """Records newest first, with the note of those that a later result supersedes."""
    out = records.join(notes, name, "left").withColumn(
        "status", F.when(F.col("reason").isNotNull(), "Superseded").otherwise("Recorded"))
    return out.orderBy(F.col(created).desc(), name)


def export_ranking(board: DataFrame, path: str, n: int = 40) -> DataFrame:
    """Write the best ``n`` rows with their place as one CSV with a header; returns what was written.

    The sorted limit runs before the numbering, so only ``n`` rows are numbered.
    """
    from pyspark.sql import Window

    top = board.orderBy(F.col("vor").desc(), F.col("player_id").asc()).limit(n)
    placed = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("vor").desc(), F.col("player_id").asc())))
    out = placed.select("rank", "player", "position", "proj", "vor", "auction")
    out.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return out


