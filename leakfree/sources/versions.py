"""Partitions replaced together: new ones are written beside the old ones and made current by one rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import delete_path

VERSION = "version"
POINTER = "_current"


class PublishError(RuntimeError):
    """The rows read back differ from the rows written."""


class VersionedParts:
    """A parquet folder parted by some columns, where every partition has one current version.

    A small file, ``_current``, names the version of each partition; Spark does not read it as data. :meth:`replace` writes the
    partitions it is given under a fresh version, counts them, and then puts a new pointer file in
    the place of the old one by one rename. Who reads through :meth:`read` sees all of a replacement or nothing of it, whatever
    fails in between. There is one writer at a time. Earlier versions stay for who still reads them until :meth:`clean`.
    """

    def __init__(self, spark: SparkSession, path: str, parts: Sequence[str]):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), list(parts)
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str = ""):
        return self._fs.Path(f"{self.path}/{name}" if name else self.path)

    def _system(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> dict[str, str]:
        """The version of each partition folder."""
        if not self._system().exists(self._at(POINTER)):
            return {}
        stream = self._system().open(self._at(POINTER))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, versions: dict[str, str]) -> None:
        fresh = f"{POINTER}-{uuid.uuid4().hex}"
        out = self._system().create(self._at(fresh), True)
        out.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
        out.close()
        self._rename(fresh)

    def _rename(self, fresh: str) -> None:
        rename = self._fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = self._fs.FileContext.getFileContext(self._at().toUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self._at(fresh), self._at(POINTER), how)

    def _folders(self, version: str) -> list[str]:
        found = self._system().globStatus(self._at("/".join(["*"] * len(self.parts) + [f"{VERSION}={version}"])))
        return ["/".join(s.getPath().toString().split("/")[-1 - len(self.parts):-1]) for s in found or []]

    def replace(self, df: DataFrame) -> int:
        """Make the rows of ``df`` the content of the partitions they fall into; others stay. Returns the number of rows."""
        version, seen = uuid.uuid4().hex, Observation()
        rows = df.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn(VERSION, F.lit(version))
        rows.hint("rebalance", *self.parts).write.mode("append").partitionBy(*self.parts, VERSION).parquet(self.path)
        fresh = dict.fromkeys(self._folders(version), version)
        if not fresh:
            if not df.isEmpty():
                raise PublishError(f"no partition was written to {self.path}")
            return 0
        found = self._read(df.schema, fresh).count()
        if found != seen.get["rows"]:
            raise PublishError(f"wrote {seen.get['rows']} rows but found {found} in {self.path}")
        self._point(self.current() | fresh)
        return found

    def _read(self, schema: StructType, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema, *StructType.fromDDL(f"{VERSION} string")])
        paths = [f"{self.path}/{part}/{VERSION}={v}" for part, v in sorted(folders.items())]
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*paths).select(*schema.names)

    def read(self, schema: StructType | str, folders: Sequence[str] | None = None) -> DataFrame:
        """The current rows, of some partition folders or all."""
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        now = self.current()
        return self._read(schema, now if folders is None else {f: now[f] for f in folders if f in now})

    def clean(self) -> int:
        """Delete versions that are not current; nobody may read them any more. Returns how many folders went."""
        now, gone = self.current(), 0
        for status in self._system().globStatus(self._at("/".join(["*"] * len(self.parts) + [f"{VERSION}=*"]))) or []:
            *part, version = status.getPath().toString().split("/")[-1 - len(self.parts):]
            if now.get("/".join(part)) != version.removeprefix(f"{VERSION}="):
                delete_path(self.spark, status.getPath().toString())
                gone += 1
        return gone
