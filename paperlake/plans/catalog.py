"""A versioned catalog of Parquet tables: new versions are written beside the old, then a pointer flips.

Readers open the versions that the pointer names and never see half a write. One writer at
a time holds a lock file; a reader never creates anything. The root may be on any file
system that Spark can reach; the pointer is read and written through Spark's own client.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

VERSION = 2


class CatalogError(Exception):
    pass


class _Files:
    """Small files beside the tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str = "") -> bool:
        """Write a new file; False if it is there already."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception:
            if self.exists(name):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        fresh = f"{name}.{uuid.uuid4().hex}"
        self.create(fresh, text)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.context.rename(self.path(fresh), self.path(name), how)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pointer, self.lock = f"{self.root}/_catalog.json", f"{self.root}/_lock"
        self.files = _Files(spark, self.root)

    def _state(self) -> dict:
        if not self.files.exists(self.pointer):
            return {"version": VERSION, "tables": {}}
        state = json.loads(self.files.read(self.pointer))
        if state["version"] > VERSION:
            raise CatalogError(f"the catalog is of version {state['version']}, newer than {VERSION}")
        state["tables"] = {n: [p] if isinstance(p, str) else p for n, p in state["tables"].items()}
        return state

    @contextlib.contextmanager
    def writing(self) -> Iterator[None]:
        """The single writer's lock; a second writer is refused."""
        if not self.files.create(self.lock):
            raise CatalogError("another writer holds the catalog")
        try:
            yield
        finally:
            self.files.delete(self.lock)

    def _put(self, tables: dict[str, DataFrame], keep: bool) -> None:
        with self.writing():
            state = self._state()
            for name, df in tables.items():
                path = f"{self.root}/{name}-{uuid.uuid4().hex}"
                df.write.parquet(path)
                state["tables"][name] = [*(state["tables"].get(name, []) if keep else []), path]
            self.files.replace(self.pointer, json.dumps({**state, "version": VERSION}))

    def write(self, **tables: DataFrame) -> None:
        """Write the tables and flip the pointer to all of them at once."""
        self._put(tables, keep=False)

    def append(self, **tables: DataFrame) -> None:
        """Write the rows beside those that the tables have."""
        self._put(tables, keep=True)

    def read(self, name: str) -> DataFrame:
        """The current version; columns that older files lack are null."""
        paths = self._state()["tables"].get(name)
        if not paths:
            raise CatalogError(f"no table {name}")
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def has(self, name: str) -> bool:
        return name in self._state()["tables"]

    def tables(self) -> list[str]:
        return sorted(self._state()["tables"])
