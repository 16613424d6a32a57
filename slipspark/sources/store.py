"""A small table of newest rows per key, kept in versions.

A commit writes its rows to a folder of their own and then one manifest, which names the folders of the table, in a single step.
What no manifest names doesn't exist, so a crash between any two steps leaves the last version as it was. A commit carries the
number of its micro-batch; one that is repeated changes nothing. Readers take the last version, or any that is still kept. After
``COMPACT`` folders a commit writes the whole table into one, so what is read doesn't grow with the number of commits. There is
one writer, as a stream has one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders a table may have before it is written into one; versions that ``vacuum`` keeps.
COMPACT, KEPT = 8, 5


@dataclass(frozen=True)
class Version:
    number: int
    batch: int
    folders: tuple[str, ...]
    schema: str


class Store:
    """Newest rows per ``keys``, by the ``newest`` columns, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], newest: list[str]):
        self.spark, self.path, self.keys, self.newest = spark, path.rstrip("/"), keys, newest
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(at)) if self._files.exists(at) else []

    def versions(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name in self._names("manifests") if name.endswith(".json")]

    def version(self, number: int | None = None) -> Version | None:
        """A version, the last one by default; None of a store without any. One that is gone is an error."""
        known = self.versions()
        if number is None and not known:
            return None
        number = known[-1] if number is None else number
        if number not in known:
            raise LookupError(f"{self.path} has no version {number}, only {known}")
        text = self.spark.read.text(f"{self.path}/manifests/{number:010d}.json", wholetext=True).first()["value"]
        manifest = json.loads(text)
        return Version(number, manifest["batch"], tuple(manifest["folders"]), manifest["schema"])

    def _publish(self, version: Version) -> None:
        staged = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = self._files.create(staged)
        stream.write(bytearray(json.dumps({"batch": version.batch, "folders": version.folders, "schema": version.schema}).encode()))
        stream.close()
        there = self._path(f"{self.path}/manifests/{version.number:010d}.json")
        if self._files.exists(there) or not self._files.rename(staged, there):
            raise RuntimeError(f"{there} has been written by another writer")

    def _rows(self, version: Version) -> DataFrame:
        schema = StructType.fromJson(json.loads(version.schema))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in version.folders])

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        # columns behind the deciding ones break ties, so that any order of commits gives the same
        rank = F.struct(*self.newest, *[c for c in rest if c not in self.newest])
        return rows.groupBy(*self.keys).agg(F.max(rank).alias("r")).select(*self.keys, *[F.col(f"r.{c}").alias(c) for c in rest])

    def read(self, number: int | None = None) -> DataFrame | None:
        """The table at a version, which stays what it is whatever is committed later."""
        version = self.version(number)
        return None if version is None else self._newest(self._rows(version))

    def commit(self, rows: DataFrame, batch: int) -> int:
        """Add rows of a micro-batch; the number of the version that has them."""
        last = self.version()
        if last is not None and batch <= last.batch:
            return last.number
        folders = () if last is None else last.folders
        if last is not None and len(folders) + 1 >= COMPACT:
            rows, folders = self._rows(last).unionByName(rows.select(*self._rows(last).columns)), ()
        folder = uuid.uuid4().hex
        newest = self._newest(rows)
        newest.write.parquet(f"{self.path}/data/{folder}")
        number = 1 if last is None else last.number + 1
        self._publish(Version(number, batch, (*folders, folder), newest.schema.json()))
        return number

    def vacuum(self, keep: int = KEPT) -> list[str]:
        """Forget all but the last versions, and delete the folders that none of these names; their names."""
        known = self.versions()
        for number in known[:-keep]:
            self._files.delete(self._path(f"{self.path}/manifests/{number:010d}.json"), False)
        named = {f for number in known[-keep:] for f in self.version(number).folders}
        gone = [name for name in self._names("data") if name not in named]
        for name in gone:
            self._files.delete(self._path(f"{self.path}/data/{name}"), True)
        return gone
