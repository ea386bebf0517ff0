"""Answers as text: rules and actions, canonical serialisation, marks of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.strings import coordinated, finite, upper_initial


def action_text(polarity: Column, verb: Column, obj: Column, modifiers: Column, qualifiers: Column) -> Column:
    """Qualifiers, the verb with its negation, the object, then 'preposition value' modifiers."""
    said = F.when(polarity == "negative", F.when(verb == "be", F.lit("is not")).otherwise(F.concat(F.lit("not "), verb))).otherwise(verb)
    return F.concat_ws(" ", F.nullif(F.array_join(qualifiers, " "), F.lit("")), said, obj, F.nullif(F.array_join(F.transform(modifiers, lambda m: F.concat_ws(" ", m["preposition"], m["value"])), " "), F.lit("")))


def rule_text(conditions: Column, subject: Column, mode: Column, actions: Column) -> Column:
    """'Subject should a and b.', 'If c, ...' or 'When any applies: c; d, ...'."""
    said = F.concat_ws(" ", subject, F.when(mode == "fact", F.lit(None)).otherwise(mode), coordinated(actions))
    return (
        F.when(F.size(conditions) == 0, F.concat(upper_initial(said), F.lit(".")))
        .when(F.size(conditions) == 1, F.concat(F.lit("If "), F.get(conditions, F.lit(0)), F.lit(", "), said, F.lit(".")))
        .otherwise(F.concat(F.lit("When any applies: "), F.array_join(conditions, "; "), F.lit(", "), said, F.lit(".")))
    )


def fact_verb(verb: Column) -> Column:
    return finite(verb)


def serialised(answers: DataFrame, per: list[str], order: list[str], cells: list[str]) -> DataFrame:
    """(per, answer): 'no' without rows, 'yes' without cells, else 'solutions([sol([a,b]),...])' with distinct rows in order."""
    distinct = answers.dropDuplicates([*per, *cells])
    sol = F.concat(F.lit("sol(["), F.concat_ws(",", *[F.col(c).cast("string") for c in cells]), F.lit("])"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"k{i}") for i, o in enumerate(order)], sol.alias("sol")))), lambda x: x["sol"])
    body = F.concat(F.lit("solutions(["), F.array_join(rows, ","), F.lit("])")) if cells else F.lit("yes")
    return distinct.groupBy(*per).agg(body.alias("answer"))


def marks(statements: DataFrame, contributions: DataFrame, key: str) -> DataFrame:
    """Statements with what contributes to them: the distinct qualifiers, grades and times in order of their place, and how many have none.

    contributions: (key, place, kind, value) with kind qualifier, grade or time.
    """
    firsts = contributions.groupBy(key, "kind", "value").agg(F.min("place").alias("place"))
    listed = firsts.groupBy(key).pivot("kind", ["qualifier", "grade", "time"]).agg(F.array_sort(F.collect_list(F.struct("place", "value"))))
    kinds = ("qualifier", "grade", "time")
    listed = listed.select(key, *[F.nullif(F.array_join(F.transform(k, lambda x: x["value"]), ", "), F.lit("")).alias(k) for k in kinds])
    return statements.join(listed, key, "left").withColumn("missing", F.col("qualifier").isNull() & F.col("grade").isNull() & F.col("time").isNull())


def text_budget(rows: DataFrame, part: list[str], order: list[str], text: str, most: int) -> DataFrame:
    """Rows of a part while their running length, a separator each, stays within most characters; hidden counts the others."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*part)
    run = F.sum(F.length(text) + 1).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("__run", run).withColumn("hidden", F.sum(F.when(F.col("__run") > most, 1).otherwise(0)).over(w))
    return marked.where(F.col("__run") <= most).drop("__run")
