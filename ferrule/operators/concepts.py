"""Concepts of a graph: their search, paths, counts and incidence; scopes read from either end; views of edges; focus sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators import census, graph


def concept_nodes(nodes: DataFrame, relations: DataFrame, kinds: tuple[str, ...] = census.CONCEPTS) -> DataFrame:
    """Nodes of those kinds that a concept relation touches."""
    ends = relations.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.where(F.col("kind").isin(*kinds)).join(ends, "id", "left_semi")


def search_concepts(nodes: DataFrame, relations: DataFrame, query: str, limit: int = 24, kinds: tuple[str, ...] = census.CONCEPTS) -> DataFrame:
    """The ranked search over concepts alone."""
    return graph.search(concept_nodes(nodes, relations, kinds), query, limit)


def shortest_concept_path(edges: DataFrame, nodes: DataFrame, start: str, goal: str, most: int = 8, kinds: tuple[str, ...] = census.CONCEPTS) -> DataFrame:
    """A shortest path whose every step is a concept relation."""
    return graph.shortest_path(census.concept_relations(edges, nodes, kinds), start, goal, most)


def concept_counts(nodes: DataFrame, relations: DataFrame, kinds: tuple[str, ...] = census.CONCEPTS) -> DataFrame:
    """One row (nodes, relations): concepts that are related, and relations that a reader can tell apart."""
    n = concept_nodes(nodes, relations, kinds).agg(F.count("*").alias("nodes"))
    return n.join(census.edge_key(relations).agg(F.count_distinct("key").alias("relations")))


def incidence(relations: DataFrame) -> DataFrame:
    """(node, relations, out, into): how many relations each concept has, and how many leave and reach it; a loop counts once."""
    ends = F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.when(F.col("source") == F.col("target"), 1).otherwise(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    kept = F.when(F.col("source") == F.col("target"), F.slice(ends, 1, 1)).otherwise(ends)
    return relations.select(F.explode(kept).alias("e")).groupBy("e.node").agg(F.count("*").alias("relations"), F.sum("e.o").alias("out"), F.sum("e.i").alias("into"))


def with_scopes(edges: DataFrame, chains: DataFrame, near: str = "scope_id", far: str = "far_id") -> DataFrame:
    """edges with scope and far, the operator chains of the scopes they name at either end; no scope is an empty chain, no far scope null.

    chains: (id, chain). A scope that is named and not there is an error.
    """
    a = chains.select(F.col("id").alias(near), F.col("chain").alias("scope"))
    b = chains.select(F.col("id").alias(far), F.col("chain").alias("far"))
    both = edges.join(a, near, "left").join(b, far, "left")

    def found(ref: str, chain: str) -> Column:
        return F.when(F.col(ref).isNotNull() & F.col(chain).isNull(), F.raise_error(F.concat(F.lit("no scope "), F.col(ref).cast("string"))).cast("array<string>")).otherwise(F.col(chain))

    return both.withColumn("scope", F.coalesce(found(near, "scope"), F.array().cast("array<string>"))).withColumn("far", found(far, "far"))


def scope_reading(scope: Column, far: Column, at_target: Column) -> Column:
    """struct(near, far): the chains as seen from an end, so swapped at the target; no far chain is an empty one."""
    other = F.coalesce(far, F.array().cast("array<string>"))
    return F.when(at_target, F.struct(other.alias("near"), scope.alias("far"))).otherwise(F.struct(scope.alias("near"), other.alias("far")))


def edge_views(edges: DataFrame, path: DataFrame) -> DataFrame:
    """(id, state, dashed, label): edges of path (id) stand out, those under a negation at either end are dashed; the far chain shows only where it adds something."""
    lit = path.select("id").distinct().withColumn("__on", F.lit(True))
    text = lambda c: F.array_join(c, " ")
    dashed = F.array_contains("scope", "-") | F.coalesce(F.array_contains("far", "-"), F.lit(False))
    far = F.when(F.col("far").isNotNull() & (F.col("far") != F.col("scope")), text(F.col("far")))
    return edges.join(lit, "id", "left").select("id", F.when(F.col("__on"), "highlight").otherwise("context").alias("state"), dashed.alias("dashed"), graph.edge_label(F.col("label"), text(F.col("scope")), far).alias("label"))


def focus_sets(lines: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(key, subject, member): for each concept itself and its neighbours under concept:<id>, for each rule its concepts under rule:<document>:<sentence>.

    lines: (line, source, target); occurrences: (line, document, sentence). Members are rows, so a concept that most lines touch gathers nowhere.
    """
    # What is named twice is left out before it is named: of a pair of concepts one direction travels, of a rule its numbers.
    swap = F.col("source").isNull() | (F.col("source") > F.col("target"))
    pairs = lines.select(F.when(swap, F.col("target")).otherwise(F.col("source")).alias("a"), F.when(swap, F.col("source")).otherwise(F.col("target")).alias("b")).where("not a <=> b").distinct()
    ends = F.explode(F.array(F.struct(F.col("a").alias("subject"), F.col("b").alias("member")), F.struct(F.col("b").alias("subject"), F.col("a").alias("member"))))
    own = lines.select(F.explode(F.array("source", "target")).alias("subject")).distinct().select("subject", F.col("subject").alias("member"))
    concepts = pairs.select(ends.alias("e")).select("e.subject", "e.member").unionByName(own).select(F.concat(F.lit("concept:"), "subject").alias("key"), "subject", "member")
    met = lines.join(occurrences, "line").select("document", "sentence", F.explode(F.array("source", "target")).alias("member")).distinct()
    rules = met.select(F.concat_ws(":", F.lit("rule"), F.col("document").cast("string"), F.col("sentence").cast("string")).alias("key"), F.lit(None).cast("string").alias("subject"), "member")
    return concepts.unionByName(rules)
