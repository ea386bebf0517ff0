"""Patterns over rows in order: neighbours that belong together, taken from the left, and the guards of clause bodies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators.termtree import texts_of


def paired(rows: DataFrame, by: list[str], order: str, match: Callable[[Column], Column]) -> DataFrame:
    """rows with half: 1 for the first row of a pair, 2 for its second, null for the rest.

    match gets the next row of the group as a struct and says whether a row and that one are a pair, shared values included. Where matches overlap the
    left one counts, so of a run of matches every other one does.
    """
    w = Window.partitionBy(*by).orderBy(order)
    names = [c for c in rows.columns if c not in by]
    seen = rows.withColumn("__next", F.lead(F.struct(*names)).over(w))
    hit = F.coalesce(F.col("__next").isNotNull() & match(F.col("__next")), F.lit(False))
    seen = seen.withColumn("__hit", hit).withColumn("__run", F.sum((~F.col("__hit")).cast("int")).over(w))
    nth = F.row_number().over(Window.partitionBy(*by, "__run").orderBy(order))
    # A run's number is that of the miss before it: that row comes first in its group, unless the run begins the rows.
    lead_in = F.max((~F.col("__hit")).cast("int")).over(Window.partitionBy(*by, "__run"))
    taken = seen.withColumn("__first", F.col("__hit") & ((nth - lead_in) % 2 == 1))
    return taken.withColumn("half", F.when(F.col("__first"), 1).when(F.coalesce(F.lag("__first").over(w), F.lit(False)), 2)).drop("__next", "__hit", "__run", "__first")


def guard_split(table: DataFrame, exclusion: str, date: str, compared: str) -> DataFrame:
    """(term, place, part, text) of bodies given as nodes (termtree.nodes): the guards set aside, scope with what it excludes and supersession with its date, and the rest as it stands.

    A scope guard is the negation of one exclusion(K), bare or in brackets; a supersession guard is date(V) right before compared(exactly, V, less, D), of one variable.
    place is that of the guard's first literal.
    """
    compound, lone = F.col("kind") == "compound", (F.col("kind") == "group") & (F.size("arguments") == 1)
    items = table.where("parent is null").select(
        "term", "place", "negated", "text", lone.alias("lone"), F.when(compound, F.col("functor")).alias("functor"), F.when(compound, texts_of()).alias("arguments"), F.when(lone, F.get("arguments", F.lit(0))["node"]).alias("child")
    )
    # What a bracket with a single literal in it says.
    deeper = table.where("level = 1 and kind = 'compound' and not negated").select("term", F.col("node").alias("child"), F.col("functor").alias("__functor"), texts_of().alias("__arguments"))
    items, lone = items.join(deeper, ["term", "child"], "left"), F.col("lone")
    items = items.select("term", "place", "negated", "text", F.when(lone, F.col("__functor")).otherwise(F.col("functor")).alias("name"), F.when(lone, F.col("__arguments")).otherwise(F.col("arguments")).alias("given"), "functor", "arguments")
    arg = lambda row, n: F.get(row, F.lit(n))
    dated = lambda nxt: (
        ~F.col("negated") & (F.col("functor") == date) & ~nxt["negated"] & (nxt["functor"] == compared) & (F.size(nxt["arguments"]) == 4) & (arg(nxt["arguments"], 0) == "exactly")
        & (arg(nxt["arguments"], 1) == arg(F.col("arguments"), 0)) & (arg(nxt["arguments"], 2) == "less")
    )
    found = paired(items, ["term"], "place", dated)
    found = found.withColumn("day", F.lead(arg(F.col("arguments"), 3)).over(Window.partitionBy("term").orderBy("place")))
    scope = F.col("negated") & (F.col("name") == exclusion)
    part = F.when(F.col("half") == 1, "supersession").when(F.coalesce(scope, F.lit(False)), "scope").otherwise("rest")
    said = F.when(part == "supersession", F.col("day")).when(part == "scope", arg(F.col("given"), 0)).otherwise(F.concat(F.when(F.col("negated"), "\\+ ").otherwise(""), "text"))
    return found.where("half is null or half = 1").select("term", "place", part.alias("part"), said.alias("text"))
