"""Counting what a graph or a corpus holds: roles, histograms, nested censuses, grouping by full identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed weights of a relation's part in a concept: the second argument of an event most, annotations between.
ARGUMENT_ROLES = {"argument 2": 4, "argument 1": 1}
KIND_ROLES = {"preposition": 3, "preference": 3, "time": 3, "property": 2, "qualifier": 2, "grade": 2, "threshold": 2}
#: Kinds of nodes that are concepts, and nouns that never form one.
CONCEPTS = ("entity", "event", "value")
NON_CONCEPTS = ("clinician", "patient", "benefit", "risk")


def role(kind: Column, relation: Column) -> Column:
    """A relation's weight: 1 unless the tables above say otherwise; other arguments of an event weigh 3."""
    argument = F.lit(3)
    for name, weight in ARGUMENT_ROLES.items():
        argument = F.when(relation == name, weight).otherwise(argument)
    out = F.when(kind == "argument", argument)
    for name, weight in KIND_ROLES.items():
        out = out.when(kind == name, weight)
    return out.otherwise(1)


def best_roles(edges: DataFrame) -> DataFrame:
    """(node, role): for each node the best of its edges, a hundred times the role and 25 more where the edge points at it."""
    weight = role(F.col("kind"), F.col("label")) * 100
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), weight.alias("w")), F.struct(F.col("target").alias("node"), (weight + 25).alias("w"))))
    return edges.select(ends.alias("e")).groupBy("e.node").agg(F.max("e.w").alias("role"))


def is_concept(kind: Column) -> Column:
    return kind.isin(*CONCEPTS)


def concept_relations(edges: DataFrame, nodes: DataFrame, concepts: tuple[str, ...] = CONCEPTS) -> DataFrame:
    """Edges between two concepts, without plain cardinalities, operators, and implications other than a condition's support."""
    kept = edges.where("not (kind = 'cardinality' and label = 'na eq 1') and kind <> 'operator' and (kind <> 'implies' or label = 'condition supports')")
    ids = nodes.where(F.col("kind").isin(*concepts)).select("id")
    return kept.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def negated_support(kind: Column, relation: Column, scope: Column, far: Column) -> Column:
    """Whether an edge is a condition's support under a negation at either end."""
    holds = lambda chain: F.coalesce(F.array_contains(chain, "-"), F.lit(False))
    return (kind == "implies") & (relation == "condition supports") & (holds(scope) | holds(far))


def edge_key(edges: DataFrame, name: str = "key") -> DataFrame:
    """edges with a text that is equal for edges a reader cannot tell apart: kind, ends, relation and scopes."""
    joined = [F.coalesce(F.array_join(c, "\x1e"), F.lit("")) for c in ("scope", "far")]
    return edges.withColumn(name, F.concat_ws("\x1f", "kind", "source", "target", "label", *joined))


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n), most frequent first."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def nested(rows: DataFrame, levels: list[tuple[str, str]], site: str) -> DataFrame:
    """(census, key, sub, sites, first): for each (key, sub) pair of columns how many distinct sites it has, and the least."""
    each = [rows.select(F.lit(f"{key}/{sub}").alias("census"), F.col(key).cast("string").alias("key"), F.col(sub).cast("string").alias("sub"), F.col(site).alias("site")) for key, sub in levels]
    return reduce(DataFrame.unionByName, each).groupBy("census", "key", "sub").agg(F.count_distinct("site").alias("sites"), F.min("site").alias("first"))


def identical(rows: DataFrame, identity: list[str], key: str) -> DataFrame:
    """(identity, keys, n): rows that agree in every identity column, nulls equal, with their keys in order."""
    return rows.groupBy(*identity).agg(F.array_sort(F.collect_list(key)).alias("keys"), F.count("*").alias("n"))


def shapes(calls: DataFrame, name: str, arguments: str) -> DataFrame:
    """(shape, n): how often each name/arity occurs."""
    return histogram(calls.select(F.concat(F.col(name), F.lit("/"), F.size(arguments).cast("string")).alias("shape")), "shape")
