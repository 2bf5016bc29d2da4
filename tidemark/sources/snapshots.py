"""Stored tables in buckets and versions: a delta rewrites only the buckets that it touches, and a new version shows all at once.

A table is a folder with ``data/<version>-<id>/__bucket=<n>`` and ``versions/<version>.json``. A version lists for each bucket the
folder that holds it, so untouched buckets stay where they are, and the changes (tags) that it contains, so a change that
comes twice does nothing. Writing a version file is one rename, which is the only moment at which readers see a change. One
writer at a time: of two, the second finds the version taken and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import merge

BUCKET = "__bucket"
#: Changes of a table whose tags a version keeps.
TAGS = 1000


class SnapshotTable:
    """A table under ``root`` with unique ``keys``; ``buckets`` is fixed when it is made."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda p: path(f"{self.root}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = 64) -> SnapshotTable:
        out = cls(spark, root)
        columns = spark.createDataFrame([], schema).schema
        out._commit({"version": 0, "schema": columns.jsonValue(), "keys": keys, "buckets": buckets, "folders": {}, "tags": []})
        return out

    # ------------------------------------------------------------ versions

    def exists(self) -> bool:
        return self._fs.exists(self._path("versions"))

    def _state(self) -> dict:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("versions"))]
        last = max(int(n.split(".")[0]) for n in names if n.endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.root}/versions/{last}.json", wholetext=True).first()[0])

    def _commit(self, state: dict) -> None:
        """Write the version beside the others and rename it; a name that is taken is an error."""
        target, draft = self._path(f"versions/{state['version']}.json"), self._path(f"drafts/{state['version']}.json")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        self._fs.mkdirs(self._path("versions"))
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"version {state['version']} of {self.root} is already written")

    @property
    def version(self) -> int:
        return self._state()["version"]

    def folders(self) -> dict[int, str]:
        """The folder of each bucket that holds rows."""
        return {int(b): f for b, f in self._state()["folders"].items()}

    # ------------------------------------------------------------ rows

    def read(self) -> DataFrame:
        """All rows of the latest version."""
        state = self._state()
        return self._rows(state, list(state["folders"].values()))

    def _rows(self, state: dict, folders: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(state["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int")

    def change(self, delta: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], tag: str | None = None) -> int:
        """Apply ``how(old, delta)`` to the buckets that ``delta`` (which has the keys) touches; returns how many were rewritten.

        ``how`` sees the rows of those buckets only and must not move a row to another key. A ``tag`` that the table already
        holds changes nothing; a delta without rows neither.
        """
        state = self._state()
        if tag is not None and tag in state["tags"]:
            return 0
        bucket = self._bucket(state)
        touched = sorted(r[0] for r in delta.select(bucket.alias("b")).distinct().collect())
        if not touched:
            return 0
        old = self._rows(state, [state["folders"][str(b)] for b in touched if str(b) in state["folders"]])
        version = state["version"] + 1
        place = f"data/{version}-{uuid.uuid4().hex[:12]}"  # of two writers of a version, each has its own folder
        new = how(old, delta).select(*old.columns).withColumn(BUCKET, bucket)
        # a large bucket is written by several tasks
        new.repartition(BUCKET, F.xxhash64(*old.columns)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{place}")
        written = {f.getPath().getName() for f in self._fs.listStatus(self._path(place))}
        folders = {b: f for b, f in state["folders"].items() if int(b) not in touched}
        folders |= {str(b): f"{place}/{BUCKET}={b}" for b in touched if f"{BUCKET}={b}" in written}
        self._commit(state | {"version": version, "folders": folders, "tags": [*state["tags"], *([tag] if tag else [])][-TAGS:]})
        return len(touched)

    def upsert(self, rows: DataFrame, tag: str | None = None) -> int:
        """Rows replace those with equal keys; others are added. Keys of ``rows`` must be unique."""
        keys = self._state()["keys"]
        return self.change(rows, lambda old, new: merge.upsert(old, new, keys), tag)

    def insert_ignore(self, rows: DataFrame, tag: str | None = None) -> int:
        keys = self._state()["keys"]
        return self.change(rows, lambda old, new: merge.insert_ignore(old, new, keys), tag)

    def update(self, values: DataFrame, allowed: frozenset[str], tag: str | None = None) -> int:
        """Set columns of known keys from a table of values; unknown keys change nothing."""
        keys = self._state()["keys"]
        return self.change(values, lambda old, new: merge.update_columns(old, new, keys, allowed), tag)

    def append_keep_last(self, rows: DataFrame, owner: list[str], order: list[Column], n: int, tag: str | None = None) -> int:
        """Add rows and keep the last ``n`` of each owner. The keys of the table must be the owner's."""
        if set(self._state()["keys"]) != set(owner):
            raise ValueError("a table that keeps rows by owner is bucketed by the owner")
        return self.change(rows, lambda old, new: merge.keep_last(old.unionByName(new), owner, order, n), tag)

    def vacuum(self) -> int:
        """Remove data that the latest version does not use, once no reader holds an older one; returns the removed folders."""
        state, removed = self._state(), 0
        used = set(state["folders"].values())
        for v in self._fs.listStatus(self._path("data")):
            for b in self._fs.listStatus(v.getPath()):
                name = f"data/{v.getPath().getName()}/{b.getPath().getName()}"
                if b.isDirectory() and name not in used:
                    self._fs.delete(b.getPath(), True)
                    removed += 1
        return removed
