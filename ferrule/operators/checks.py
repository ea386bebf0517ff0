"""Integrity: differences of sets, keyed differentials, orphans and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named_differences(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Rows that only one side has, counted, with the name of that side. Empty where the sides are equal as sets."""
    a, b = left.distinct().withColumn("__a", F.lit(1)), right.distinct().withColumn("__b", F.lit(1))
    joined = a.join(b, left.columns, "full")
    return joined.where("__a is null or __b is null").select(*left.columns, F.when(F.col("__b").isNull(), names[0]).otherwise(names[1]).alias("only_in"))


def keyed_differential(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks: (keys, left_value, right_value)."""
    a, b = left.select(*keys, F.col(value).alias("left_value"), F.lit(1).alias("__a")), right.select(*keys, F.col(value).alias("right_value"), F.lit(1).alias("__b"))
    return a.join(b, keys, "full").where(F.col("__a").isNull() | F.col("__b").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).drop("__a", "__b")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(parents, on, "left_anti")


def separation(boxes: DataFrame, near: float) -> DataFrame:
    """(a, b, gap) of boxes (id, x, y, w, h) that overlap once each is widened by near on every side.

    Boxes are put into square cells no smaller than the largest widened box, so those that overlap are in the same or neighbouring cells; a pair is
    taken in the one cell that holds its later corner.
    """
    widest = boxes.agg(F.greatest(F.max("w"), F.max("h")).alias("m"))
    wide = boxes.crossJoin(F.broadcast(widest))  # one row
    side = F.greatest(F.col("m") + 2 * near, F.lit(1e-9))
    lo_x, lo_y, hi_x, hi_y = F.col("x") - near, F.col("y") - near, F.col("x") + F.col("w") + near, F.col("y") + F.col("h") + near
    cells = (
        wide.withColumn("side", side).select("id", lo_x.alias("x0"), lo_y.alias("y0"), hi_x.alias("x1"), hi_y.alias("y1"), "side")
        .withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / F.col("side")), F.floor(F.col("x1") / F.col("side")))))
        .withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / F.col("side")), F.floor(F.col("y1") / F.col("side")))))
    )
    a, b = (cells.select("cx", "cy", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "x0", "y0", "x1", "y1", "side")]) for s in ("a", "b"))
    left, low = F.greatest("x0_a", "x0_b"), F.greatest("y0_a", "y0_b")
    right, high = F.least("x1_a", "x1_b"), F.least("y1_a", "y1_b")
    met = a.join(b, ["cx", "cy"]).where((F.col("id_a") < F.col("id_b")) & (left < right) & (low < high))
    once = met.where((F.floor(left / F.col("side_a")) == F.col("cx")) & (F.floor(low / F.col("side_a")) == F.col("cy")))
    return once.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.least(right - left, high - low).alias("gap"))
