"""Computations along an order: runs, markers, overlaps, numbering, sessions and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.sources.tables import staged


def shown_once_per_run(rows: DataFrame, part: list[str], order: list[str], value: str, name: str = "shown") -> DataFrame:
    """value where it differs from the row before, '' inside a run; run numbers the runs of a part from 1."""
    w = Window.partitionBy(*part).orderBy(*order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("__new", new).withColumn(name, F.when(F.col("__new"), F.col(value)).otherwise("")).withColumn("run", F.sum(F.col("__new").cast("long")).over(w)).drop("__new")


def without_adjacent_repeats(rows: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return rows.withColumn("__new", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).where("__new").drop("__new")


def carried_forward(rows: DataFrame, part: list[str], order: list[str], marker: Column, name: str) -> DataFrame:
    """The last marker that was not null at or before each row."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(w))


def overlaps_next(rows: DataFrame, part: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Rows of a part that reach past the start of the next one by (start, end, tie)."""
    w = Window.partitionBy(*part).orderBy(start, end, tie)
    return rows.withColumn("next_start", F.lead(start).over(w)).where(F.col("next_start") < F.col(end))


def variants(rows: DataFrame, part: list[str], variant: list[str], place: list[str]) -> DataFrame:
    """(part, variant, number): the distinct variants of a part, numbered from 1 in the order in which they are first seen. Rows that lie by part are not shuffled."""
    first = rows.groupBy(*part, *variant).agg(F.min(F.struct(*place)).alias("__first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(*part).orderBy("__first"))).drop("__first")


def variant_numbers(rows: DataFrame, part: list[str], variant: list[str], place: list[str]) -> DataFrame:
    """rows with the number of their variant (see variants)."""
    return rows.join(variants(rows, part, variant, place), [*part, *variant])


def sessions(rows: DataFrame, key: str, at: str, gap_seconds: int, tie: str) -> DataFrame:
    """(key, session, started, ended, n): rows of a key that follow each other within the gap."""
    w = Window.partitionBy(key).orderBy(at, tie)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    cut = F.coalesce(micros - F.lag(micros).over(w) > gap_seconds * 1_000_000, F.lit(True))
    marked = rows.withColumn("__cut", cut).withColumn("session", F.sum(F.col("__cut").cast("long")).over(w))
    return marked.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))


def within_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width_seconds: int) -> DataFrame:
    """Pairs of a point and an interval of one key with start <= at < end.

    Time is cut into cells of width_seconds; an interval goes to every cell it touches and a point to its own, so the join is on (key, cell),
    and a busy key is spread over its cells. Choose the width near the usual length of an interval.
    """
    cell = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width_seconds)
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("__cell", F.explode(F.sequence(cell(start), cell(end))))
    return points.withColumn("__cell", cell(at)).join(spread, [key, "__cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__cell")


def parallel_offsets(rows: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """Offset of each of n lines between one pair of ends, whichever way they point: k - (n - 1) / 2 for k from 0."""
    pair = Window.partitionBy(F.least(a, b), F.greatest(a, b))
    return rows.withColumn("offset", F.row_number().over(pair.orderBy(*order)) - 1 - (F.count("*").over(pair) - 1) / 2)


def numbered(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """rows numbered from 1 along key. Ranges of the key are numbered apart, then offset by the sizes of the ranges before, so no task sorts everything."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.withColumn("__k", key).repartitionByRange(partitions, "__k").withColumn("__range", F.spark_partition_id()), "numbered")
    # One row for each range, of which there are as many as shuffle partitions.
    before = dealt.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__k"))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + own).drop("__k", "__range", "__before")
