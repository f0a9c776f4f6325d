"""Several tables as one versioned snapshot: written beside the old ones, made current by claiming the next version number.

A version is one small file that names the folder of each table. Readers take the highest version once and then see one state
of all tables. Writers put their files under a folder of their own and claim version n + 1 by creating its file where none may
be: of two writers that start from one version one succeeds, the other gets a Conflict and has touched nothing of the first.
Large tables can be kept in buckets by key, so that a change rewrites only the buckets it touches. All access goes through the
cluster's file system; a store on one that cannot refuse to overwrite a file (plain object stores) needs another to hold versions.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another version became current since the one that a commit started from."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(int(n.removeprefix("VERSION.")) for n in names if n.startswith("VERSION.") and n[8:].isdigit())

    def _content(self, version: int) -> dict:
        if not version:
            return {"tables": {}, "marks": {}}
        stream = self._fs.open(self._at(f"VERSION.{version}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @property
    def version(self) -> int:
        """The current version; 0 before the first commit."""
        return max(self._versions(), default=0)

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Folder of each table, or of each bucket of one (`table/bucket`), in a version."""
        return self._content(self.version if version is None else version)["tables"]

    def read(self, table: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame | None:
        """A table, or the given buckets of one, in the current or another version that is still kept; None if it has none."""
        kept = self.tables(version)
        if table in kept:
            return self.spark.read.parquet(kept[table])
        paths = [p for name, p in kept.items() if name.startswith(f"{table}/") and (buckets is None or int(name.rsplit("/", 1)[1]) in buckets)]
        return self.spark.read.parquet(*sorted(paths)) if paths else None

    def _claim(self, version: int, content: dict) -> None:
        text = json.dumps(content, indent=1, sort_keys=True)
        name = f"VERSION.{version}"
        if self._fs.getUri().getScheme() == "file":
            target = self._at(name).toUri().getPath()
            temporary = f"{target}.{uuid.uuid4().hex}"
            with open(temporary, "w") as f:
                f.write(text)
            try:
                os.link(temporary, target)  # fails if it exists
            except FileExistsError:
                raise Conflict(f"version {version} became current during the commit") from None
            finally:
                os.unlink(temporary)
            return
        try:
            out = self._fs.create(self._at(name), False)
            out.write(bytearray(text.encode()))
            out.close()
        except Exception as e:
            if self._fs.exists(self._at(name)):
                raise Conflict(f"version {version} became current during the commit") from e
            raise

    def commit(self, changed: dict[str, DataFrame], base: int | None = None, mark: tuple[str, str] | None = None, bucketed: dict[str, tuple[DataFrame, int]] | None = None) -> int:
        """Writes the changed tables and makes them current together with all others. Returns the new version.

        mark: (writer, step); a commit with the step its writer marked last is a repeat and does nothing. bucketed: tables of
        which only some buckets change, each with the column `_bucket` and the number of buckets; those that do not occur stay.
        """
        now = self.version
        if base is not None and base != now:
            raise Conflict(f"version {now} is current, not {base}")
        content = self._content(now)
        tables, marks = dict(content["tables"]), dict(content["marks"])
        if mark and marks.get(mark[0]) == mark[1]:
            return now
        own = f"{self.path}/data/{uuid.uuid4().hex}"
        for name, df in changed.items():
            df.write.parquet(f"{own}/{name}")
            tables[name] = f"{own}/{name}"
        for name, (df, count) in (bucketed or {}).items():
            df.write.partitionBy("_bucket").parquet(f"{own}/{name}")
            for b in range(count):
                if self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(f"{own}/{name}/_bucket={b}")):
                    tables[f"{name}/{b}"] = f"{own}/{name}/_bucket={b}"
        if mark:
            marks[mark[0]] = mark[1]
        try:
            self._fs.mkdirs(self._at(""))
            self._claim(now + 1, {"tables": tables, "marks": marks})
        except Conflict:
            self.remove(own)
            raise
        return now + 1

    def remove(self, folder: str) -> None:
        """Deletes a folder with all that is in it."""
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(folder), True)

    def tidy(self, keep: int = 2) -> int:
        """Removes all but the last `keep` versions and the folders only they name; returns how many versions went.

        Folders of commits still under way are named by no version: run it while no one writes.
        """
        versions = self._versions()
        gone, left = versions[:-keep], versions[-keep:]
        used = {p for v in left for p in self._content(v)["tables"].values()}
        old = {p for v in gone for p in self._content(v)["tables"].values()} - used
        for p in old:
            self.remove(p)
        for v in gone:
            self._fs.delete(self._at(f"VERSION.{v}"), False)
        return len(gone)


def bucket_of(key: str, count: int):
    """The bucket of a row by its key."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(count)).cast("int")
