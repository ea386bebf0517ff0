"""Collecting solutions: ordered lists, sorted sets, first-seen groups and merged statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_list(value: Column, *order: Column) -> Column:
    """Aggregate: the values of a group in an explicit order, duplicates kept."""
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda x: x["v"])


def sorted_set(value: Column) -> Column:
    return F.array_sort(F.collect_set(value))


def find_all(subject: DataFrame, goal: DataFrame, value: str, order: list[str], name: str = "found") -> DataFrame:
    """For every subject the list of its solutions in order, empty where it has none."""
    on = [c for c in subject.columns if c in goal.columns]
    lists = goal.groupBy(*on).agg(ordered_list(F.col(value), *map(F.col, order)).alias(name))
    return subject.join(lists, on, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def bag_of(goal: DataFrame, free: list[str], value: str, order: list[str], name: str = "bag") -> DataFrame:
    """A list for each binding of the free variables; no group, no row."""
    return goal.groupBy(*free).agg(ordered_list(F.col(value), *map(F.col, order)).alias(name))


def set_of(goal: DataFrame, free: list[str], value: str, name: str = "set") -> DataFrame:
    return goal.groupBy(*free).agg(sorted_set(F.col(value)).alias(name))


def count_with_zero(subject: DataFrame, goal: DataFrame, name: str = "n") -> DataFrame:
    """Number of solutions for each subject, 0 where there is none."""
    on = [c for c in subject.columns if c in goal.columns]
    return subject.join(goal.groupBy(*on).agg(F.count("*").alias(name)), on, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def grouped_in_order(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Groups with the place they were first seen and their values in order: (keys, first, values, n, distinct)."""
    place = F.struct(*[F.col(o) for o in order])
    return rows.groupBy(*keys).agg(F.min(place).alias("first"), ordered_list(F.col(value), *map(F.col, order)).alias("values"), F.count("*").alias("n"), F.count_distinct(value).alias("n_distinct"))


def merged_statements(rows: DataFrame, text: str = "text", source: str = "source", place: str = "place") -> DataFrame:
    """(text, source, first): every statement's distinct sources, a row each, with the place the statement was first seen.

    Sources stay rows, so that a statement that most sources share gathers in no task; the first places are a partial aggregate.
    """
    first = rows.groupBy(text).agg(F.min(place).alias("first"))
    return rows.select(text, source).distinct().join(first, text)


def representatives(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by order, and how many there were. One partial aggregate, no sort of groups."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.min_by(F.struct(*order, *rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("__r"), F.count("*").alias("n")).select(*keys, "__r.*", "n")


def disclosed(all_rows: DataFrame, order: list, cap: int, kind: str) -> DataFrame:
    """What a cap hides: per kind the rows in all, those among the first cap, and those removed."""
    shown = all_rows.orderBy(*order).limit(cap).groupBy(kind).agg(F.count("*").alias("shown"))
    every = all_rows.groupBy(kind).agg(F.count("*").alias("total"))
    return every.join(shown, kind, "left").select(kind, "total", F.coalesce("shown", F.lit(0)).cast("long").alias("shown"), (F.col("total") - F.coalesce("shown", F.lit(0))).alias("removed"))
