"""Goals as joins: conjunction, disjunction, negation, quantifiers and committed choice.

A goal is a DataFrame whose columns are its variables; shared names are shared variables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.sources.tables import staged_and_seen

#: Most rows of a table that is looked up by broadcast.
BROADCAST_ROWS = 500_000


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def conjunction(*goals: DataFrame) -> DataFrame:
    """Natural join of goals in turn. Goals without a shared variable are refused: that would be a product."""

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        on = _shared(a, b)
        if not on:
            raise ValueError(f"goals share no variable: {a.columns} and {b.columns}")
        return a.join(b, on)

    return reduce(both, goals)


def disjunction(*goals: DataFrame, branch: str = "branch") -> DataFrame:
    """All solutions of each goal, with the branch's number so that the left one can come first."""
    return reduce(DataFrame.unionByName, [g.withColumn(branch, F.lit(i)) for i, g in enumerate(goals)])


def without(goal: DataFrame, refuted: DataFrame) -> DataFrame:
    """Negation as failure: solutions of goal for which refuted has none."""
    return goal.join(refuted, _shared(goal, refuted), "left_anti")


def exists(goal: DataFrame, witness: DataFrame) -> DataFrame:
    return goal.join(witness, _shared(goal, witness), "left_semi")


def for_all(goal: DataFrame, condition: DataFrame, action: Column) -> DataFrame:
    """Solutions of goal for which no row of condition fails the action (a null action fails)."""
    return without(goal, condition.where(~F.coalesce(action, F.lit(False))).select(*_shared(goal, condition)))


def divide(rows: DataFrame, key: str, value: str, required: DataFrame) -> DataFrame:
    """Keys that occur with every required value (relational division). required has the column value and is counted, not collected."""
    need, seen = staged_and_seen(required.select(value).distinct(), "required", n=F.count("*"))
    # A join by few values would bring each one's rows into one task: those are looked up where the rows stand.
    have = rows.select(key, value).join(F.broadcast(need) if seen["n"] <= BROADCAST_ROWS else need, value, "left_semi").distinct().groupBy(key).agg(F.count(value).alias("have"))
    return have.where(F.col("have") == seen["n"]).select(key)


def first(goal: DataFrame, per: list[str], order: list) -> DataFrame:
    """The first solution of each group by a total order."""
    return goal.withColumn("__n", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where("__n = 1").drop("__n")


def if_then_else(subject: DataFrame, condition: DataFrame, order: list, then: list[Column], otherwise: list[Column]) -> DataFrame:
    """For each subject the first solution of condition through `then`, or, where it has none, the subject through `otherwise`."""
    on = _shared(subject, condition)
    yes = subject.join(first(condition, on, order), on)
    return yes.select(*then, F.lit("then").alias("branch")).unionByName(without(subject, condition).select(*otherwise, F.lit("else").alias("branch")))


def soft_cut(subject: DataFrame, condition: DataFrame, then: list[Column], otherwise: list[Column]) -> DataFrame:
    """All solutions of condition, and `otherwise` only for subjects without one."""
    on = _shared(subject, condition)
    return subject.join(condition, on).select(*then, F.lit("then").alias("branch")).unionByName(without(subject, condition).select(*otherwise, F.lit("else").alias("branch")))


def ignore(subject: DataFrame, goal: DataFrame, order: list) -> DataFrame:
    """Subjects with the first solution of goal, or with nulls where there is none."""
    on = _shared(subject, goal)
    return subject.join(first(goal, on, order), on, "left")


def capped(goal: DataFrame, order: list, cap: int) -> DataFrame:
    """The first cap rows by a total order, each with more = whether another one existed. cap is the caller's answer limit."""
    top = goal.orderBy(*order).limit(cap + 1)
    n = F.row_number().over(Window.orderBy(*order))  # over cap + 1 rows
    return top.withColumn("n", n).withColumn("more", F.max("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > cap).where(F.col("n") <= cap)
