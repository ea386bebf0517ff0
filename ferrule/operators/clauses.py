"""A graph from clauses: declarations, arguments, annotations, conditions, orphan scopes and what nothing reaches.

clauses: (document, sentence, line, predicate, args array<string>, in_body boolean), a row per literal; where conditions are asked for also ordinal and world. Names are scoped to
their document; a head literal states, a body literal conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import graph

#: Predicates that declare a node, with its kind: (name, label).
DECLARING = {"entity": "entity", "event": "event", "value": "value"}
#: Predicates that annotate a node, with the kind of their edge: (name, word).
ANNOTATING = {"grade": "grade", "qualifier": "qualifier", "time": "time", "preference": "preference", "property": "property"}
#: Those that are said of events where a name is declared as one.
EVENT_WORDS = ("qualifier", "time")


def _arg(n: int) -> Column:
    return F.get("args", F.lit(n))


def _mapped(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("predicate")]


def node_name(kind: Column, document: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), document.cast("string"), F.lit(":"), name)


def declarations(clauses: DataFrame) -> DataFrame:
    """(document, sentence, kind, name, label): a row for each literal that declares."""
    return clauses.where(F.col("predicate").isin(*DECLARING)).select("document", "sentence", _mapped(DECLARING).alias("kind"), _arg(0).alias("name"), _arg(1).alias("label"))


def declared(clauses: DataFrame) -> DataFrame:
    """(id, kind, label, document, sentence, name): a node for each declaration, in its first sentence."""
    first = declarations(clauses).groupBy("document", "kind", "name").agg(F.min(F.struct("sentence", "label")).alias("f"))
    return first.select(node_name(F.col("kind"), F.col("document"), F.col("name")).alias("id"), "kind", F.col("f.label").alias("label"), "document", F.col("f.sentence").alias("sentence"), "name")


def _by_name(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """(document, name) and for each kind of node open_<kind>, null where the name is not declared as one, and first_<kind>, the first sentence that declares it (null if one of them has no number).

    One row a name, in numbers and booleans only, so it takes one shuffle without a sort; which node it is follows from kind, document and name.
    """
    of = lambda k, value: F.when(F.col("kind") == k, value)
    rows = nodes.where(F.col("kind").isin(*kinds)).groupBy("document", "name").agg(*[x for k in kinds for x in (F.max(of(k, F.col("sentence").isNull())).alias(f"open_{k}"), F.min(of(k, F.col("sentence"))).alias(f"least_{k}"))])
    return rows.select("document", "name", *[f"open_{k}" for k in kinds], *[F.when(~F.col(f"open_{k}"), F.col(f"least_{k}")).alias(f"first_{k}") for k in kinds])


def argument_edges(clauses: DataFrame, nodes: DataFrame, *keep: str) -> DataFrame:
    """(kind, source, target, label, document, sentence, line, found) of argument(event, place, name) literals, and columns to keep.

    A name is looked up in the sentence that declares it first, then in its document, else a node is minted for it. nodes: (document, sentence, kind, name) as declarations or declared give them.
    """
    kinds = sorted(k for k in DECLARING.values() if k != "event")
    calls = clauses.where("predicate = 'argument'").select("document", "sentence", "line", _arg(0).alias("event"), _arg(1).alias("place"), _arg(2).alias("name"), *keep)
    both = calls.join(_by_name(nodes, kinds), ["document", "name"], "left")
    # A name that its sentence declares as several kinds is all of them there; else it is the first kind of its document.
    here = [F.coalesce(F.col(f"first_{k}") == F.col("sentence"), F.lit(False)) for k in kinds]
    several = F.when(sum((h.cast("int") for h in here), F.lit(0)) > 1, F.array_compact(F.array(*[F.when(h, F.lit(k)) for h, k in zip(here, kinds)])))
    near = F.coalesce(*[F.when(h, F.lit(k)) for h, k in zip(here, kinds)])
    wide = F.coalesce(*[F.when(F.col(f"open_{k}").isNotNull(), F.lit(k)) for k in kinds])
    met = both.select("document", "sentence", "line", "event", "place", "name", *keep, near.alias("near"), wide.alias("wide"), F.explode_outer(several).alias("each"))
    node = node_name(F.coalesce("each", "near", "wide", F.lit("minted")), F.col("document"), F.col("name"))
    found = F.when(F.col("near").isNotNull(), "sentence").when(F.col("wide").isNotNull(), "document").otherwise("minted")
    return met.select(
        F.lit("argument").alias("kind"), node_name(F.lit("event"), F.col("document"), F.col("event")).alias("source"), node.alias("target"), F.concat(F.lit("argument "), "place").alias("label"), "document", "sentence", "line", found.alias("found"), *keep
    )


def annotation_edges(clauses: DataFrame, nodes: DataFrame, *keep: str) -> DataFrame:
    """(kind, source, target, label, document, sentence, line, found): from an annotated node to its word, a node that all documents share. keep names further columns of clauses to carry along.

    A name that is declared as several kinds is annotated once: as the kind that the predicate is about (events for qualifiers and times, else entities), else as the
    first other one by kind. A name that its document does not declare gets a node minted for it, so no annotation is lost; found tells which. nodes are as for argument_edges.
    """
    kinds = sorted(DECLARING.values())
    about = F.when(F.col("predicate").isin(*EVENT_WORDS), "event").otherwise("entity")
    rows = clauses.where(F.col("predicate").isin(*ANNOTATING)).select("document", "sentence", "line", _mapped(ANNOTATING).alias("kind"), _arg(0).alias("name"), _arg(1).alias("word"), about.alias("about"), *keep)
    both = rows.join(_by_name(nodes, kinds), ["document", "name"], "left")
    known = {k: F.col(f"open_{k}").isNotNull() for k in kinds}
    kind = F.coalesce(*[F.when(known[k] & (F.col("about") == k), F.lit(k)) for k in kinds], *[F.when(known[k], F.lit(k)) for k in kinds])
    found = F.when(kind.isNull(), "minted").otherwise("declared")
    return both.select(
        "kind", node_name(F.coalesce(kind, F.lit("minted")), F.col("document"), F.col("name")).alias("source"), F.concat(F.lit("word:"), "word").alias("target"), F.col("word").alias("label"), "document", "sentence", "line", found.alias("found"), *keep
    )


def body_edges(clauses: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, source, target, label, document, sentence, world, line, times): one edge for what the bodies of a sentence say in one world, in its first line; times counts the literals that say it.

    clauses has a column world: what is said under a negation and plainly are two claims.
    """
    bodies = clauses.where("in_body")
    # No annotation is of the kind argument, so both are counted apart: arguments that lie by document and sentence are counted where they lie.
    counted = lambda said: said.groupBy("kind", "source", "target", "label", "document", "sentence", "world").agg(F.min("line").alias("line"), F.count("*").alias("times"))
    return counted(argument_edges(bodies, nodes, "world")).unionByName(counted(annotation_edges(bodies, nodes, "world")))


def _conditions(clauses: DataFrame) -> DataFrame:
    """(document, sentence, source, target, line, ordinal, world, nth): each event of a clause's body with the event its head states, nth from 1 among those that say the same in a sentence."""
    events = clauses.where("predicate = 'event'").select("document", "sentence", "line", "in_body", "ordinal", "world", node_name(F.lit("event"), F.col("document"), _arg(0)).alias("id"))
    # Windows, not joins: clauses that lie by document and sentence, or by document, are not shuffled again.
    met = events.distinct()
    heads = F.collect_set(F.when(~F.col("in_body"), F.col("id"))).over(Window.partitionBy("document", "sentence", "line"))
    both = met.withColumn("target", heads).where("in_body").select("document", "sentence", "line", "ordinal", "world", F.col("id").alias("source"), F.explode("target").alias("target"))
    w = Window.partitionBy("document", "sentence", "source", "target").orderBy("line", "ordinal", "world")
    return both.where("source <> target").withColumn("nth", F.row_number().over(w))


def condition_edges(clauses: DataFrame) -> DataFrame:
    """(kind, source, target, label, document, sentence, line, world): from each event of a clause's body to the event that its head states, once a sentence, as said first.

    clauses: a row per literal with ordinal, its place in the clause, and world. A line is a clause; only clauses whose head is an event state conditions here. Bodies meet the
    head of their own clause, so the result grows with the literals and not with the events of a sentence. See condition_merges for what was said again.
    """
    first = _conditions(clauses).where("nth = 1")
    return first.select(F.lit("implies").alias("kind"), "source", "target", F.lit("condition supports").alias("label"), "document", "sentence", "line", "world")


def condition_merges(clauses: DataFrame) -> DataFrame:
    """(document, sentence, source, target, kept_line, kept_world, line, world): conditions left out of condition_edges because the sentence said them before, and where."""
    w = Window.partitionBy("document", "sentence", "source", "target").orderBy("nth")
    rows = _conditions(clauses).withColumn("kept_line", F.first("line").over(w)).withColumn("kept_world", F.first("world").over(w))
    return rows.where("nth > 1").select("document", "sentence", "source", "target", "kept_line", "kept_world", "line", "world")


def context_edges(clauses: DataFrame) -> DataFrame:
    """(kind, source, target, label, document, sentence, line): from the context of a clause that has a body to the node its head states: the declared one, or the event of an argument."""
    kind = F.coalesce(_mapped(DECLARING), F.when(F.col("predicate") == "argument", "event"))
    has_body = F.max("in_body").over(Window.partitionBy("document", "sentence", "line"))
    rows = clauses.select("document", "sentence", "line", "predicate", "in_body", "world", "args", kind.alias("__kind")).where("in_body or __kind is not null").withColumn("__body", has_body)
    heads = rows.where("__body and not in_body")
    context = F.concat(F.lit("context:"), F.col("document").cast("string"), F.lit(":"), F.col("world"))
    return heads.select(F.lit("implies").alias("kind"), context.alias("source"), node_name(F.col("__kind"), F.col("document"), _arg(0)).alias("target"), F.concat(F.lit("condition implies "), "predicate").alias("label"), "document", "sentence", "line").distinct()


def refuse_unreached(referents: DataFrame, edges: DataFrame) -> None:
    """An error that counts the property referents (id) that no edge leads to, and names the first: leaving a property's own edge out is sound only while another reaches it."""
    lost = referents.select("id").distinct().join(edges.select(F.col("target").alias("id")).distinct(), "id", "left_anti")
    row = lost.agg(F.count("*").alias("n"), F.min("id").alias("first")).first()
    if row.n:
        raise ValueError(f"{row.n} property referents that no edge reaches, first {row.first}")


def orphan_scopes(scopes: DataFrame, clauses: DataFrame) -> DataFrame:
    """Scopes (document, sentence, id) whose sentence states nothing."""
    return scopes.join(clauses.select("document", "sentence").distinct(), ["document", "sentence"], "left_anti")


def unreached(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (id) that share no component with a root (id): what a reader who starts there never sees."""
    parts = graph.components(edges.select("source", "target"))
    seen = parts.join(roots.select(F.col("id").alias("node")), "node", "left_semi").select("component").distinct()
    good = parts.join(seen, "component", "left_semi").select(F.col("node").alias("id")).unionByName(roots.select("id"))
    return nodes.select("id").join(good, "id", "left_anti")
