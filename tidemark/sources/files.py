"""File sources with explicit schemas, and sinks. Paths may be of any file system that Spark reads."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the small market inputs.
SERIES = "date date, value double, source string"
ORIGINS = "origin string, point_diff int, tariff double, note string"
FLAVOURS = "origin_key string, flavors string"


#: Scratch folders of this driver that nothing has removed yet.
_folders: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for files of a job: under ``spark.checkpoint.dir``, which driver and executors share; without it, where
    everything runs in one JVM, in a temporary folder. It is removed by ``drop_scratch`` or at the end of the driver."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(shared)  # one temporary folder for the session
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_drop_at_exit)
    _folders.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a scratch folder and read back: later jobs see one and the same table, also after a lost executor."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove one scratch folder that nothing reads any more."""
    _folders.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the scratch folders of this driver; results that still read them must have been written before."""
    while _folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_at_exit() -> None:
    spark = SparkSession._instantiatedSession
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            drop_scratch(spark)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header, under a declared schema; columns are taken by position, malformed values become null."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, enforceSchema=True, mode="PERMISSIVE")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_csv(spark, path, schema, "\t")


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON document, or an array of them."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: Coordinates stay JSON text while a file is read, as their depth depends on the type of the geometry.
GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
RINGS = "array<array<array<double>>>"


def polygon_edges(spark: SparkSession, path: str, name: str, *more: str) -> DataFrame:
    """(polygon, part, more..., y1, x1, y2, x2) of the polygons of a GeoJSON file; ``name`` is the property that names them, ``more`` are others to keep.

    All rings of a Polygon or MultiPolygon count, so that the parity of crossed sides leaves holes out. Features without
    geometry have no row; a geometry of another type is an error.
    """
    doc = read_json_document(spark, path, GEOJSON).select(F.explode("features").alias("f")).where("f.geometry IS NOT NULL")
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, RINGS))).when(kind == "MultiPolygon", F.from_json(text, f"array<{RINGS}>"))
    parts = parts.otherwise(F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(kind, F.lit("no type")))).cast(f"array<{RINGS}>"))
    names = [F.col("f.properties")[name].alias("polygon"), *[F.col("f.properties")[m].alias(m) for m in more]]
    rings = doc.select(*names, F.posexplode(parts).alias("part", "p")).select("polygon", "part", *more, F.explode("p").alias("r"))
    sides = F.transform(F.sequence(F.lit(0), F.size("r") - 2), lambda i: F.struct(F.get("r", i)[1].alias("y1"), F.get("r", i)[0].alias("x1"), F.get("r", i + 1)[1].alias("y2"), F.get("r", i + 1)[0].alias("x2")))
    return rings.where("size(r) > 1").select("polygon", "part", *more, F.explode(sides).alias("s")).select("polygon", "part", *more, "s.*")


def write_sorted_csv(df: DataFrame, path: str, order: str) -> None:
    """One file with a header, in order: for small results such as a daily series."""
    df.coalesce(1).sortWithinPartitions(order).write.mode("overwrite").csv(path, header=True)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text with a header in each of its files; quotes inside values are doubled, empty text and null stay apart."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"', emptyValue='""', nullValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parts(df: DataFrame, path: str, key: Column, parts: int = 4) -> None:
    """Parquet in folders ``part=0..parts-1`` by the key's remainder; each row is shuffled once, by a hash of the whole row as
    well, so a folder is written by as many tasks as its rows need."""
    keyed = df.withColumn("part", F.pmod(key, F.lit(parts)).cast("int"))
    keyed.repartition("part", F.xxhash64(*df.columns)).write.mode("overwrite").partitionBy("part").parquet(path)


def version_of(df: DataFrame, updated: str) -> tuple:
    """(rows, latest update) of a table: a result made from it is fresh while this stays the same."""
    got = df.agg(F.count("*").alias("n"), F.max(updated).alias("at")).first()
    return got["n"], got["at"]
