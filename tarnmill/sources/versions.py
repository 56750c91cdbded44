"""Tables that are updated: Parquet folders by buckets of a key, and a small file a version that names the folder of each bucket.

An update rewrites the buckets that its keys fall into and no others, in a folder of its own, and counts once the file of
the next version names it. That file is written elsewhere and renamed, which fails if another writer was first; then the
update is tried again, without computing it anew where the other writer touched other buckets. So a crash at any point
leaves the last version as it was, two writers lose nothing, and readers go on with the version that they opened. A version
file holds one entry a bucket, whatever the table's size. The exclusive rename holds on HDFS and local disks; an object
store needs a committer that refuses to replace.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Other writers were first at every attempt."""


class Table:
    """The table at a path, by the key whose rows an update reads and writes together: a row's own key, or its parent's."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 256):
        self.spark, self.at, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version, 0 where there is none."""
        return max([int(x) for x in self._names("versions")], default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one by default; ValueError if it is not there."""
        return self._rows(self._held(self.version() if version is None else version))

    def replace(self, rows: DataFrame) -> int:
        """Makes rows, which may be read from this table, its next version; gives that version's number."""
        folder, names = self._write(rows, None)
        while True:
            n = self.version()
            if self._publish(n + 1, rows.schema, {b: folder for b in names}):
                return n + 1

    def update(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], attempts: int = 10) -> int:
        """Makes change(old, changes) the rows of the buckets that changes' keys fall into; gives the version's number.

        old has the rows of those buckets, so change must treat a key by itself: upsert() and its kin do. A row that it
        gives for a key of another bucket is an error. Null keys are a key. No changes make no version.
        """
        n = self.version()
        held = self._held(n)
        schema = StructType.fromJson(held["schema"])
        changes = changes.withColumn(self.key, F.col(self.key).cast(schema[self.key].dataType))
        touched = sorted(str(r[0]) for r in changes.select(self._bucket(held)).distinct().collect())  # at most one a bucket
        if not touched:
            return n
        for _ in range(attempts):
            old = self._rows(held, touched)
            folder, names = self._write(change(old, changes).select(*schema.names), touched, held)
            read = {b: held["folders"].get(b) for b in touched}
            while all(held["folders"].get(b) == f for b, f in read.items()):  # what was read still holds
                folders = {b: f for b, f in held["folders"].items() if b not in read} | {b: folder for b in names}
                if self._publish(n + 1, schema, folders, held["buckets"]):
                    return n + 1
                n = self.version()
                held = self._held(n)
            self._remove(folder)
        raise Conflict(f"{self.at}: {attempts} attempts")

    def clean(self, keep: int = 1) -> None:
        """Removes what the newest `keep` versions do not need; to be run when nothing else writes or reads older ones."""
        if keep < 1:
            raise ValueError("keep is 1 or more")
        versions = sorted(int(x) for x in self._names("versions"))
        needed = {f for n in versions[-keep:] for f in self._held(n)["folders"].values()}
        for n in versions[:-keep]:
            self._remove(f"versions/{n:012d}")
        for name in self._names("data"):
            if f"data/{name}" not in needed:
                self._remove(f"data/{name}")
        self._remove("drafts")

    def _bucket(self, held: dict | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(held["buckets"] if held else self.buckets)).cast("int").alias(BUCKET)

    def _rows(self, held: dict, buckets: list[str] | None = None) -> DataFrame:
        schema, folders = StructType.fromJson(held["schema"]), held["folders"]
        paths = [f"{self.at}/{f}/{BUCKET}={b}" for b, f in folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, touched: list[str] | None, held: dict | None = None) -> tuple[str, list[str]]:
        """The folder that was written, and the buckets in it. Large buckets are split over tasks."""
        bucket = self._bucket(held)
        if touched is not None:
            bucket = F.when(bucket.cast("string").isin(touched), bucket).otherwise(F.raise_error(F.lit("a row for a key that no change has")).cast("int"))
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.at}/{folder}")
        return folder, [x.split("=")[1] for x in self._names(folder) if x.startswith(f"{BUCKET}=")]

    def _held(self, version: int) -> dict:
        name = self._path(f"versions/{version:012d}")
        if not version or not self.fs.exists(name):
            raise ValueError(f"{self.at} has no version {version}")
        stream = self.fs.open(name)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, schema: StructType, folders: dict[str, str], buckets: int | None = None) -> bool:
        """Writes a version's file whole or not at all; False if that version is there."""
        draft, name = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"versions/{version:012d}")
        stream = self.fs.create(draft)
        stream.write(bytearray(json.dumps({"schema": schema.jsonValue(), "buckets": buckets or self.buckets, "folders": folders}).encode()))
        stream.close()
        self.fs.mkdirs(name.getParent())
        jvm = self.spark._jvm.org.apache.hadoop.fs
        context = jvm.FileContext.getFileContext(name.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, name, self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))
        except Py4JJavaError as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}" if name else self.at)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def _remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
