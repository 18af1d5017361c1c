"""Versioned tables on plain Parquet: every commit writes new folders, then a manifest that names them.

Readers see the newest manifest only, so a commit is visible whole or not at all, and a lost executor or driver leaves nothing but
unreferenced folders for :meth:`Versions.vacuum`.  A manifest is created, never overwritten: of two writers one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    pass


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def current(self) -> dict:
        """{"version": n, "tables": {name: [folders]}, "meta": {...}}; version 0 before any commit."""
        found = self.versions()
        if not found:
            return {"version": 0, "tables": {}, "meta": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{found[-1]:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, schema: str, manifest: dict | None = None) -> DataFrame:
        folders = (manifest or self.current())["tables"].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{x}" for x in folders])

    def write(self, name: str, df: DataFrame) -> str:
        """Write a folder that no reader sees yet; its name goes to :meth:`commit`."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, before: dict, replace: dict[str, str] | None = None, append: dict[str, str] | None = None, meta: dict | None = None) -> dict:
        tables = dict(before["tables"])
        for name, folder in (replace or {}).items():
            tables[name] = [folder]
        for name, folder in (append or {}).items():
            tables[name] = [*tables.get(name, []), folder]
        after = {"version": before["version"] + 1, "tables": tables, "meta": before["meta"] | (meta or {})}
        final = self._path(f"{self.root}/manifest/v{after['version']:012d}.json")
        try:
            out = self._fs.create(final, False)
        except Exception as e:
            raise Conflict(f"version {after['version']} was committed by another writer") from e
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        return after

    def vacuum(self, keep: int = 1) -> int:
        """Drop manifests but the last ``keep``, and folders that those do not name; returns how many folders went."""
        for n in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/v{n:012d}.json"), False)
        used = set()
        for n in self.versions():
            stream = self._fs.open(self._path(f"{self.root}/manifest/v{n:012d}.json"))
            used |= {x for xs in json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"].values() for x in xs}
            stream.close()
        data, gone = self._path(f"{self.root}/data"), 0
        if self._fs.exists(data):
            for x in self._fs.listStatus(data):
                if f"data/{x.getPath().getName()}" not in used:
                    self._fs.delete(x.getPath(), True)
                    gone += 1
        return gone
