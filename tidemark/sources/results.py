"""Stored results that are used again while their inputs stay as they are."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import version_of


class Results:
    """Results under ``root``, one folder for each name and version of the inputs. A result shows when it is written whole."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _done(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def path(self, name: str, version: tuple) -> str:
        digest = hashlib.sha256(json.dumps([str(v) for v in version]).encode()).hexdigest()[:20]
        return f"{self.root}/{name}/{digest}"

    def get(self, name: str, version: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        """The result stored for a version, or that of ``make``, which is then stored."""
        path = self.path(name, version)
        if not self._done(path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def of(self, name: str, inputs: dict[DataFrame, str] | list[tuple[DataFrame, str]], make: Callable[[], DataFrame], *more: object) -> DataFrame:
        """``get`` by (rows, latest change) of every input (a table and its column of changes) and by ``more`` parameters."""
        pairs = inputs.items() if isinstance(inputs, dict) else inputs
        return self.get(name, tuple(x for df, updated in pairs for x in version_of(df, updated)) + more, make)
