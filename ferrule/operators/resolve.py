"""Joins that resolve what a row refers to: nearest scope first, unique matches, lookups by priority, orphans on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_scope(references: DataFrame, local: DataFrame, document: DataFrame, fallback: str) -> DataFrame:
    """references with node and found: the declaration in the same sentence, else in the same document, else a node minted from the name.

    references: (document, sentence, name, ...). local: (document, sentence, name, node). document: (document, name, node). Names are declared once in
    their scope. found is sentence, document or minted.
    """
    near = local.select("document", "sentence", "name", F.col("node").alias("__near"))
    wide = document.select("document", "name", F.col("node").alias("__wide"))
    both = references.join(near, ["document", "sentence", "name"], "left").join(wide, ["document", "name"], "left")
    node = F.coalesce("__near", "__wide", F.concat(F.lit(fallback), F.col("document").cast("string"), F.lit(":"), F.col("name")))
    found = F.when(F.col("__near").isNotNull(), "sentence").when(F.col("__wide").isNotNull(), "document").otherwise("minted")
    return both.withColumn("node", node).withColumn("found", found).drop("__near", "__wide")


def by_priority(rows: DataFrame, key: str, *lookups: tuple[DataFrame, str]) -> DataFrame:
    """rows with value and source: the first of the lookups, (key, value) tables with a name each, that knows the key; null where none does."""
    out, values, names = rows, [], []
    for k, (lookup, name) in enumerate(lookups):
        column = f"__v{k}"
        out = out.join(lookup.select(F.col("key").alias(key), F.col("value").alias(column)), key, "left")
        values.append(F.col(column))
        names.append(F.when(F.col(column).isNotNull(), F.lit(name)))
    return out.withColumn("value", F.coalesce(*values)).withColumn("source", F.coalesce(*names)).drop(*[f"__v{k}" for k in range(len(lookups))])


def unique_match(rows: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    """rows joined to the candidates that share their key, where the key has one candidate only; keys with several match nothing.

    Candidates are counted before the join, so a key with many of them costs a partial aggregate.
    """
    rest = [c for c in candidates.columns if c not in on]
    single = candidates.groupBy(*on).agg(F.count("*").alias("__n"), *[F.any_value(c).alias(c) for c in rest]).where("__n = 1").drop("__n")
    return rows.join(single, on)


def witnessed(rows: DataFrame, witnesses: DataFrame, on: list[str], value: str) -> DataFrame:
    """rows with value from their witness; status is unique, missing or several."""
    counted = witnesses.groupBy(*on).agg(F.count_distinct(value).alias("__n"), F.min(value).alias("__v"))
    both = rows.join(counted, on, "left")
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "several").otherwise("unique")
    return both.withColumn("status", status).withColumn(value, F.when(F.col("__n") == 1, F.col("__v"))).drop("__n", "__v")


def both_orphans(left: DataFrame, right: DataFrame, on: list[str], names: tuple[str, str]) -> DataFrame:
    """(on, side): keys that one side has and the other has not."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b, on, "left_anti").withColumn("side", F.lit(names[0])).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit(names[1])))


def groups_on_both_sides(spans: DataFrame, keys: list[str], group: str, side: str) -> DataFrame:
    """(keys, group, on_both): for each group whether it has spans on all sides that its keys have."""
    per = spans.groupBy(*keys, group).agg(F.count_distinct(side).alias("__g"))
    return per.join(spans.groupBy(*keys).agg(F.count_distinct(side).alias("__k")), keys).select(*keys, group, (F.col("__g") == F.col("__k")).alias("on_both"))


def by_rank(rows: DataFrame, kinds: tuple[str, ...], kind: str, weight: str, tie: str, part: list[str]) -> DataFrame:
    """rows with place from 1 in each part: by the kind's place in kinds, others last, then heavier first, then tie."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), F.col(kind)), F.lit(0)), F.lit(len(kinds) + 1))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(rank, F.desc(weight), tie)))
