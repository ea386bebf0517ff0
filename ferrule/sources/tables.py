"""Tables of a data directory, and staged tables that cut lineage."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task takes at a time where their number decides on the tasks.
TASK_ROWS = 250_000


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by columns, or evenly without any, to tasks whose number grows with the rows, so that a task's part stays bounded and a small file is no one task. rows are counted first."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks, *by)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: spark.checkpoint.dir. Unset, a local folder serves on one machine; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return f"file://{tempfile.gettempdir()}/ferrule-{spark.sparkContext.applicationId}"


#: Shuffle files go when the query that made them ends, not when the driver collects its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession, on: bool = True) -> Iterator[None]:
    """Queries that are run inside leave no shuffle files."""
    before = spark.conf.get(_FREED, None)
    if on:
        spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if on and before is None:
            spark.conf.unset(_FREED)
        elif on:
            spark.conf.set(_FREED, before)


def staged(df: DataFrame, label: str, freed: bool = False, **options: str) -> DataFrame:
    """Write df as Parquet, with these options, into the shared folder and read it back; a lost executor costs a reread, not a replay. freed: the shuffle files of the write go at its end."""
    path = f"{shared_dir(df.sparkSession)}/staged/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession, freed):
        df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def staged_and_seen(df: DataFrame, label: str, freed: bool = False, **measures: Column) -> tuple[DataFrame, dict]:
    """A staged table, and aggregates over its rows that the write itself has gathered."""
    seen = Observation()
    out = staged(df.observe(seen, *[m.alias(k) for k, m in measures.items()]), label, freed)
    return out, seen.get


def unstage(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path is None:
            continue
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def digest_rows(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that does not depend on row order: what two runs of one query must agree on."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]
    h = F.xxhash64(*texts) if texts else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).alias("digest"))
