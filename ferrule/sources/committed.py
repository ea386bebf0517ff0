"""Folders that readers see whole or not at all: data first, a manifest last, put in place by one rename."""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one data file, so that a task which sums it holds a bounded part.
FILE_ROWS = 20_000

MANIFEST = "file string, bytes long, sha256 string"


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system and the path in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_committed(df: DataFrame, path: str) -> DataFrame:
    """Writes df as JSON lines, nulls kept, into path and returns the manifest (file, bytes, sha256) of what it wrote.

    The rows go to a new data folder; only when all of them are there is the manifest written, under another name, and renamed. A writer that fails
    leaves no manifest and removes its data, so readers see what was there before. A later write to the same path replaces the earlier one for readers that start after it.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    data = f"{path}/data-{version}"
    try:
        df.write.option("ignoreNullFields", False).option("maxRecordsPerFile", FILE_ROWS).json(data)
        found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(data)
        listed = found.select(F.concat(F.lit(f"data-{version}/"), F.element_at(F.split("path", "/"), -1)).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        # Each task reads and sums its own files; only their names and sums meet in the one file of the manifest.
        listed.repartition(1).write.json(f"{path}/_manifest-{version}")
    except Exception:
        for left in (data, f"{path}/_manifest-{version}"):
            fs, at = _at(spark, left)
            fs.delete(at, True)
        raise
    fs, made = _at(spark, f"{path}/_manifest-{version}")
    # Names grow with time, so the latest manifest is the last one; a rename is the commit.
    number = 1 + max((int(f.getPath().getName().split("-")[1]) for f in fs.globStatus(_at(spark, f"{path}/manifest-*")[1])), default=0)
    if not fs.rename(made, _at(spark, f"{path}/manifest-{number:09d}")[1]):
        raise RuntimeError(f"could not commit to {path}")
    return latest_manifest(spark, path)


def latest_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the last committed write, an error where there is none."""
    fs, pattern = _at(spark, f"{path}/manifest-*")
    found = sorted(f.getPath().getName() for f in fs.globStatus(pattern))
    if not found:
        raise FileNotFoundError(f"nothing is committed in {path}")
    return spark.read.schema(MANIFEST).json(f"{path}/{found[-1]}")


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the last committed write. A write has one data folder, and a listed file that is gone or changed is an error."""
    listed = latest_manifest(spark, path)
    folder = listed.select(F.split("file", "/")[0].alias("f")).distinct().first()
    if folder is None:
        return spark.createDataFrame([], schema)
    now = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{folder.f}").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("now"))
    bad = listed.withColumn("name", F.element_at(F.split("file", "/"), -1)).join(now, "name", "full").where("not (now <=> sha256)").count()
    if bad:
        raise ValueError(f"{bad} files of {path} are not those of its manifest")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{folder.f}")
