"""Snapshots of several tables that change together.

A store is a folder with ``data`` and ``commits``. Tables are written to new
folders under ``data``; then one commit file, named by its version, lists the
folder of every table. The file is staged and renamed, and a rename to a name
that exists fails, so a version is there whole or not at all and two writers
cannot both make it. Readers take the highest version. A writer that dies at any
step leaves folders that no commit names; :func:`vacuum` removes them.

Paths may be in any store whose rename of one file is atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import deleted


class Conflict(RuntimeError):
    """Another writer has made the version."""


@dataclass(frozen=True)
class Snapshot:
    """One version: the folder and format of every table."""

    version: int
    tables: Mapping[str, Mapping[str, str]]


class Store:
    """The snapshots in one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The given version, or the highest; version 0 has no tables."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return Snapshot(0, {})
        text = self.spark.read.option("wholetext", True).text(self._commit_path(version)).first()["value"]
        return Snapshot(version, json.loads(text)["tables"])

    def read(self, table: str, version: int | None = None, schema=None) -> DataFrame:
        found = self.snapshot(version).tables[table]
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.format(found["format"]).load(f"{self.root}/{found['folder']}")

    def commit(self, changed: Mapping[str, DataFrame], dropped: tuple[str, ...] = (), base: Snapshot | None = None, kind: str = "parquet", by: Mapping[str, list[str]] | None = None, options: Mapping[str, str] | None = None) -> Snapshot:
        """The next version after ``base`` (the highest, if none is given): the
        changed tables anew, the rest as they were. ``by``: partition columns;
        ``options``: of the writer."""
        base = self.snapshot() if base is None else base
        tables = {name: dict(found) for name, found in base.tables.items() if name not in dropped}
        for name, df in changed.items():
            folder = f"data/{name.replace('/', '-')}-{uuid.uuid4().hex}"
            writer = df.write.format(kind).options(**options or {})
            if by and name in by:
                writer = writer.partitionBy(*by[name])
            writer.save(f"{self.root}/{folder}")
            tables[name] = {"folder": folder, "format": kind}
        return self._publish(Snapshot(base.version + 1, tables))

    def _commit_path(self, version: int) -> str:
        return f"{self.root}/commits/{version:012d}.json"

    def _publish(self, snapshot: Snapshot) -> Snapshot:
        staged = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(json.dumps({"version": snapshot.version, "tables": snapshot.tables}, sort_keys=True).encode())
        out.close()
        target = self._path(self._commit_path(snapshot.version))
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise Conflict(f"version {snapshot.version} of {self.root} exists")
        return snapshot

    def compact(self, table: str, files: int, base: Snapshot | None = None) -> Snapshot:
        """The same rows of ``table`` in at most ``files`` files, as a new version."""
        base = self.snapshot() if base is None else base
        return self.commit({table: self.read(table, base.version).coalesce(files)}, base=base, kind=base.tables[table]["format"])

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last ``keep`` versions, and what no version left
        names, also what dead writers have left. Not for a folder that others are
        writing to. Returns the folders removed."""
        known = self.versions()
        for version in known[: -keep or None]:
            self._fs.delete(self._path(self._commit_path(version)), False)
        commits = self._path(f"{self.root}/commits")
        for file in self._fs.listStatus(commits) if self._fs.exists(commits) else []:
            if file.getPath().getName().startswith("."):
                self._fs.delete(file.getPath(), False)
        named = {found["folder"] for version in known[-keep:] for found in self.snapshot(version).tables.values()} if keep else set()
        data = self._path(f"{self.root}/data")
        gone = [f.getPath().getName() for f in self._fs.listStatus(data)] if self._fs.exists(data) else []
        gone = [name for name in gone if f"data/{name}" not in named]
        for name in gone:
            deleted(self.spark, f"{self.root}/data/{name}")
        return len(gone)


def publish(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """``df`` as the next version of the one table at ``path``; earlier ones go."""
    store = Store(df.sparkSession, path)
    store.commit({"table": df}, kind=kind)
    store.vacuum(keep=2)


def published(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table that :func:`publish` has put at ``path``."""
    return Store(spark, path).read("table", schema=schema)
