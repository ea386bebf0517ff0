"""Kinds of documents by where their passages stand, and classes of concepts by a codebook that must fit them exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def document_kinds(coverage: DataFrame) -> DataFrame:
    """(document, kind) of coverage rows (sources.text.coverage) that name a document: recommendation where a part of its section is a numbered one, implementation where
    one holds implementation considerations, else supporting. A document that several rows name takes the last by region."""
    numbered = F.exists("section", lambda p: p.rlike("^Recommendation [0-9]+$"))
    kind = F.when(numbered, "recommendation").when(F.array_contains("section", "Implementation considerations"), "implementation").otherwise("supporting")
    named = coverage.where("state = 'ace' and detail is not null").select(F.col("detail").alias("document"), kind.alias("kind"), "region")
    return named.groupBy("document").agg(F.max_by("kind", "region").alias("kind"))


def _refuse(rows: DataFrame, id_: str, what: str) -> None:
    """An error that counts the ids and names the first five."""
    found = rows.select(F.col(id_).cast("string").alias("id")).distinct()
    n = found.count()
    if n:
        first = [r.id for r in found.orderBy("id").limit(5).collect()]
        raise ValueError(f"codebook: {what}: {n} ({', '.join(first)})")


def classified(concepts: DataFrame, codebook: DataFrame, classes: list[str]) -> DataFrame:
    """concepts (id, ...) with their class from codebook (id, class): every concept is coded, every entry names a concept, every class is declared or null. Anything else is an error that counts and names it."""
    _refuse(concepts.join(codebook, "id", "left_anti"), "id", "concepts without a class entry")
    _refuse(codebook.join(concepts, "id", "left_anti"), "id", "entries naming no concept")
    _refuse(codebook.where(F.col("class").isNotNull() & ~F.col("class").isin(*classes)), "id", "classes that are not declared")
    _refuse(codebook.groupBy("id").count().where("count > 1"), "id", "concepts with several entries")
    return concepts.join(codebook, "id")


def covering(items: DataFrame, by: list[str], start: str, length: str, low: str, high: str) -> DataFrame:
    """items that own a place of their group's range [low, high): rows (by, ..., start, length) whose own range meets it, in order."""
    met = items.where((F.col(start) < F.col(high)) & (F.col(start) + F.col(length) > F.col(low)) & (F.col(length) > 0))
    return met.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(start)))
