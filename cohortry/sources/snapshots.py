"""A table whose rows are replaced key by key, whole for its readers at any time.

Every write goes to a folder of its own; a manifest says which folder holds each
key now. Replacing keys means writing their new rows and then one new manifest.
Readers take the latest complete manifest, so they see all of a write or nothing
of it, and whoever started with an older one can finish. Nothing is listed per
key: a key without rows is one the manifest names and no file holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import small_table

# Manifests that stay after a newer one: a reader may still be at work.
KEPT = 2

_MANIFEST = "key long, folder string"


class Snapshots:
    """A table under ``path``, partitioned by a number (``key``); ``ddl`` gives all its columns."""

    def __init__(self, spark: SparkSession, path: str, key: str, ddl: str):
        self.spark, self.path, self.key, self.ddl = spark, path.rstrip("/"), key, ddl
        self._names = [column.split()[0] for column in ddl.split(",")]

    def _storage(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _folder(self, name: str) -> str:
        return f"{self.path}/data/_write={name}"

    def versions(self) -> list[int]:
        """Numbers of the complete manifests, from one listing."""
        files, place = self._storage(f"{self.path}/manifest/*/_SUCCESS")
        found = files.globStatus(place)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def manifest(self, version: int | None = None) -> DataFrame:
        """``key, folder`` of the latest (or another) version; settings-sized, as many rows as keys."""
        known = self.versions() if version is None else [version]
        if not known:
            return small_table(self.spark, [], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{known[-1]}")

    def replace(self, df: DataFrame, keys: Iterable[int]) -> None:
        """The rows of ``df`` take the place of all rows of ``keys``; other keys stay, other rows are left out."""
        self._commit(df, list(dict.fromkeys(keys)), keep=True)

    def overwrite(self, df: DataFrame) -> None:
        """The rows of ``df`` take the place of the whole table."""
        self._commit(df, None, keep=False)

    def _commit(self, df: DataFrame, keys: list[int] | None, keep: bool) -> None:
        known = self.versions()
        folder, spread = uuid.uuid4().hex, f"_{self.key}"
        rows = df.select(*self._names)
        if keys is not None:
            listed = small_table(self.spark, [(k,) for k in keys], f"{self.key} long")
            rows = rows.join(listed, self.key, "left_semi").select(*self._names)
        # One partition per key in files of even size: small keys share a task, large ones are split.
        rows.withColumn(spread, F.col(self.key)).hint("rebalance", spread).write.partitionBy(spread).parquet(self._folder(folder))
        if keys is None:
            keys = [r[0] for r in self._stored([folder]).select(self.key).distinct().collect()]
        old = [(r["key"], r["folder"]) for r in self.manifest(known[-1]).collect()] if known and keep else []
        replaced = set(keys)
        held = [(k, f) for k, f in old if k not in replaced] + [(k, folder) for k in keys]
        version = known[-1] + 1 if known else 1
        # Fails if another writer has committed this number meanwhile.
        small_table(self.spark, held, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{version}")
        self._clean([*known, version])

    def _stored(self, folders: list[str]) -> DataFrame:
        """All rows of some folders; both folder and key prune what is read."""
        reader = self.spark.read.schema(f"{self.ddl}, _write string, _{self.key} long").option("basePath", f"{self.path}/data")
        return reader.parquet(*map(self._folder, folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the latest (or another) version; none before the first write."""
        held = self.manifest(version)
        folders = [r["folder"] for r in held.select("folder").distinct().collect()]
        if not folders:
            return small_table(self.spark, [], self.ddl)
        now = F.broadcast(held.select(F.col("key").alias(f"_{self.key}"), F.col("folder").alias("_write")))
        return self._stored(folders).join(now, [f"_{self.key}", "_write"], "left_semi").select(*self._names)

    def _clean(self, known: list[int]) -> None:
        """Drop the oldest manifests, and the folders that no manifest left names."""
        gone, left = known[:-1 - KEPT], known[-1 - KEPT:]
        if not gone:
            return
        named = {r["folder"] for v in left for r in self.manifest(v).select("folder").distinct().collect()}
        old = {r["folder"] for v in gone for r in self.manifest(v).select("folder").distinct().collect()}
        for path in [*[self._folder(f) for f in old - named], *[f"{self.path}/manifest/{v}" for v in gone]]:
            files, place = self._storage(path)
            files.delete(place, True)
