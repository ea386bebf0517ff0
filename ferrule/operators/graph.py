"""A typed property graph as DataFrames: building, search, bounded neighbourhoods, paths, components, answer maps.

nodes: (id, kind, label). edges: (id, kind, source, target, label, document, sentence, scope). Rounds of a traversal
are joins; what a round adds is staged, so plans stay short and a lost executor costs a reread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.functions.strings import padded_digits
from ferrule.operators import forest
from ferrule.sources.tables import staged, staged_and_seen, table, unstage

#: Rows of a counted table that may be broadcast.
HUBS = 500_000


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def star_nodes(spark, sf_dir: str) -> DataFrame:
    def some(name: str, kind: str, key: str, label: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(node_id(kind, F.col(key)).alias("id"), F.lit(kind).alias("kind"), label.alias("label"))

    parts = [
        some("region", "region", "r_regionkey", F.col("r_name")),
        some("nation", "nation", "n_nationkey", F.col("n_name")),
        some("supplier", "supplier", "s_suppkey", F.col("s_name")),
        some("customer", "customer", "c_custkey", F.col("c_name")),
        some("part", "part", "p_partkey", F.col("p_name")),
        some("orders", "order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def star_edges(spark, sf_dir: str) -> DataFrame:
    """Edges of the star schema: each line item ties its order and its supplier to its part; places nest."""
    none = F.lit(None)

    def some(df: DataFrame, kind: str, a: tuple[str, str], b: tuple[str, str], label: str, document: Column = none, sentence: Column = none, scope: Column = none) -> DataFrame:
        source, target = node_id(a[0], F.col(a[1])), node_id(b[0], F.col(b[1]))
        return df.select(
            F.concat_ws("|", F.lit(kind), source, target, document.cast("string"), sentence.cast("string")).alias("id"), F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"),
            F.lit(label).alias("label"), document.cast("long").alias("document"), sentence.cast("int").alias("sentence"), scope.cast("string").alias("scope"),
        )

    items = table(spark, sf_dir, "lineitem")
    line = (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag"))
    return reduce(
        DataFrame.unionByName,
        [
            some(items, "contains", ("order", "l_orderkey"), ("part", "l_partkey"), "contains", *line),
            some(items, "supplies", ("supplier", "l_suppkey"), ("part", "l_partkey"), "supplies", *line),
            some(table(spark, sf_dir, "supplier"), "located", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "is in"),
            some(table(spark, sf_dir, "customer"), "located", ("customer", "c_custkey"), ("nation", "c_nationkey"), "is in"),
            some(table(spark, sf_dir, "nation"), "within", ("nation", "n_nationkey"), ("region", "n_regionkey"), "lies within"),
        ],
    )


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, peer) in both directions, each pair once."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("peer")).union(edges.select(F.col("target").alias("node"), F.col("source").alias("peer"))).distinct()


def incident(edges: DataFrame, node: str) -> DataFrame:
    """All edges at a node with the direction and the other end."""
    here = edges.where((F.col("source") == node) | (F.col("target") == node))
    return here.withColumn("direction", F.when(F.col("source") == node, "out").otherwise("in")).withColumn("peer", F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("node")).unionAll(edges.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def within_steps(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, depth) of the nodes at most depth steps from start, whichever way edges point."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "node string, depth int")
    frontier, ties = seen, staged(neighbours(edges), "graph-neighbours") if depth > 1 else neighbours(edges)
    for k in range(1, depth + 1):
        new = frontier.select("node").join(ties, "node").select(F.col("peer").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = staged(new.select("node", F.lit(k).alias("depth")), "graph-frontier")
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(nodes: DataFrame, edges: DataFrame, start: str, depth: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """The first cap nodes near start by (depth, label with numbers in order, kind, id), and the edges among them."""
    near = within_steps(edges, start, depth).join(nodes.withColumnRenamed("id", "node"), "node")
    kept = staged(near.orderBy("depth", padded_digits(F.col("label")), "kind", "node").limit(cap), "graph-kept")
    ids = kept.select("node")
    among = edges.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").join(ids.withColumnRenamed("node", "target"), "target", "left_semi")
    return kept, among


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = 8) -> DataFrame:
    """(step, node) along a shortest path, of equal ones that with the smallest predecessor at every step.

    No row means that there is no path of at most `most` steps; a longer one is not looked for.
    """
    spark = edges.sparkSession
    ties = staged(neighbours(edges), "graph-neighbours")
    seen = staged(spark.createDataFrame([(start, None, 0)], "node string, parent string, depth int"), "graph-path")
    frontier, met = seen, {"n": 1, "hits": int(start == goal)}
    for k in range(1, most + 1):
        if met["hits"] or not met["n"]:
            break
        reached = frontier.select("node").join(ties, "node").groupBy(F.col("peer").alias("node")).agg(F.min("node").alias("parent"))
        new = reached.join(seen, "node", "left_anti").select("node", "parent", F.lit(k).alias("depth"))
        frontier, met = staged_and_seen(new, "graph-path", n=F.count("*"), hits=F.count_if(F.col("node") == goal))
        seen = seen.unionByName(frontier)
    # The way back is a handful of single rows, so the driver walks it.
    steps, at = [], goal
    while at is not None:
        row = seen.where(F.col("node") == at).first()
        if row is None:
            break
        steps.append((row.depth, row.node))
        at = row.parent
    return spark.createDataFrame(steps, "step int, node string")


def components(edges: DataFrame, a: str = "source", b: str = "target", label: str = "graph-components", rounds: int = 60, heavy: int = 1000) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge; nodes of any type that has an order.

    Alternates large-star and small-star steps. Null ends and self loops are ignored, repeated edges count once. A step looks up
    the minimum of each edge's smaller end; the minima of ends with more than `heavy` edges are broadcast, so that a hub's edges stay where they
    are, as long as there are no more than HUBS of them; beyond that all are joined by a shuffle, which adaptive execution may split.
    Edges are staged between rounds, and rounds end when nothing changes.
    """
    ends = edges.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).where("x is not null and y is not null and x <> y")
    current = staged(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), label)
    before = None
    for _ in range(rounds):
        both = current.select("u", "v").unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        minima = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"), "n")
        minima, seen = staged_and_seen(minima, label, hubs=F.count(F.when(F.col("n") > heavy, 1)))
        if 0 < seen["hubs"] <= HUBS:
            hubs = minima.where(F.col("n") > heavy).select(F.col("at").alias("hub"), F.col("m").alias("hub_m"))
            tagged = current.join(F.broadcast(hubs), F.col("v") == F.col("hub"), "left")
            large = tagged.where("hub is not null").select("u", F.col("hub_m").alias("v"))
            large = large.unionAll(tagged.where("hub is null").join(minima.where(F.col("n") <= heavy), F.col("v") == F.col("at")).select("u", F.col("m").alias("v")))
        else:
            large = current.join(minima, F.col("v") == F.col("at")).select("u", F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(low, F.col("u") == F.col("at")).select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after, state = staged_and_seen(small, label, rows=F.count("*"), digest=F.bit_xor(F.xxhash64("u", "v")))
        unstage(current, minima)
        current = after
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def search(nodes: DataFrame, query: str, limit: int = 24) -> DataFrame:
    """The best nodes for a query, every word of which must stand in the label, id or kind: (id, kind, label, score), low scores first.

    0 the label itself, 1 the id, 2 label begins with the query, 3 a word of the label does, 4 label holds it, 5 id holds it, 6 the rest.
    """
    q = " ".join(query.lower().split())
    label, ident = F.lower("label"), F.lower("id")
    hay = F.concat_ws(" ", label, ident, "kind")
    score = (
        F.when(label == q, 0).when(ident == q, 1).when(label.startswith(q), 2).when(F.contains(F.concat(F.lit(" "), label), F.lit(f" {q}")), 3)
        .when(label.contains(q), 4).when(ident.contains(q), 5).otherwise(6)
    )
    match = reduce(lambda a, b: a & b, [hay.contains(w) for w in q.split()], F.lit(True))
    return nodes.where(match).select("id", "kind", "label", score.alias("score")).orderBy("score", padded_digits(F.col("label")), "kind", "id").limit(limit)


def evidence(rows: DataFrame, cited: DataFrame) -> DataFrame:
    """Distinct rows, such as edges, of the cited (document, sentence) rows; a null sentence cites its whole document.

    rows are read once: those of documents that are not cited go first, and only the others are looked up by sentence. What comes out lies by document and sentence.
    """
    near = rows.join(cited.groupBy("document").agg(F.bool_or(F.col("sentence").isNull()).alias("__whole")), "document")
    exact = cited.where("sentence is not null").select("document", "sentence").distinct().withColumn("__exact", F.lit(True))
    return near.join(exact, ["document", "sentence"], "left").where("__whole or __exact").select(*rows.columns).distinct()


def line_edges(lines: DataFrame) -> DataFrame:
    """(kind, source, target, document, sentence, scope): the two edges of each line item (document, sentence, part, supplier, scope), as star_edges has them. Rows stay where they lie."""
    ends = [F.struct(F.lit(kind).alias("kind"), source.alias("source")) for kind, source in (("contains", node_id("order", F.col("document"))), ("supplies", node_id("supplier", F.col("supplier"))))]
    both = lines.select("document", "sentence", node_id("part", F.col("part")).alias("target"), "scope", F.explode(F.array(*ends)).alias("e"))
    return both.select("e.kind", "e.source", "target", "document", "sentence", "scope")


def answer_map(nodes: DataFrame, edges: DataFrame, query: str, first: int = 24, rounds: int = 4) -> DataFrame:
    """A map around the best hit: (round, branch, node, weight).

    Round 0 is the hit itself. Its peers, heaviest first by the number of parallel edges, are the branches of round 1, at most `first`. Each branch
    then brings its own heaviest peers that are not on the map yet, one a round for `rounds` rounds. A peer of two branches stays with the first.
    """
    hit = staged(search(nodes, query, 1).select(F.col("id").alias("node")), "graph-hit")
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("peer")).unionAll(edges.select(F.col("target").alias("node"), F.col("source").alias("peer")))
    hop1 = ends.join(F.broadcast(hit), "node").groupBy("peer").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "peer").limit(first)  # hit is one row
    branches = staged(hop1.withColumn("branch", F.row_number().over(Window.orderBy(F.desc("weight"), "peer"))), "graph-branches")  # at most `first` rows
    on_map = hit.unionByName(branches.select(F.col("peer").alias("node")))
    hop2 = (
        ends.join(F.broadcast(branches.select(F.col("peer").alias("node"), "branch")), "node").groupBy("branch", "peer").agg(F.count("*").alias("weight"))
        .join(F.broadcast(on_map.withColumnRenamed("node", "peer")), "peer", "left_anti")
    )
    own = hop2.groupBy("peer").agg(F.min("branch").alias("branch"), F.min_by("weight", "branch").alias("weight"))
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("weight"), "peer"))).where(F.col("k") <= rounds)
    return (
        hit.select(F.lit(0).alias("round"), F.lit(0).alias("branch"), "node", F.lit(0).cast("long").alias("weight"))
        .unionByName(branches.select(F.lit(1).alias("round"), "branch", F.col("peer").alias("node"), "weight"))
        .unionByName(ranked.select((F.col("k") + 1).alias("round"), "branch", F.col("peer").alias("node"), "weight"))
    )


def scope_chains(parents: DataFrame) -> DataFrame:
    """(id, parent, operator) to (id, chain array<string>, depth): operators from the innermost outwards, order kept, chains of any length. A cycle is an error; a parent that is no row ends a chain."""
    rows = parents.withColumn("__all", F.lit(0))
    return forest.chains(rows, ["__all"], "operator").select("id", "chain", "depth")


def edge_label(label: Column, near: Column, far: Column) -> Column:
    """'relation · near → far', the far part left out where it is empty or equal to near."""
    return F.concat(label, F.when(F.coalesce(near, F.lit("")) != "", F.concat(F.lit(" · "), near)).otherwise(""), F.when((F.coalesce(far, F.lit("")) != "") & ~far.eqNullSafe(near), F.concat(F.lit(" → "), far)).otherwise(""))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id) of what breaks the graph: repeated ids, ends without a node, self loops."""
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("end"))
    return (
        nodes.groupBy("id").count().where("count > 1").select(F.lit("repeated node").alias("rule"), "id")
        .unionByName(edges.groupBy("id").count().where("count > 1").select(F.lit("repeated edge").alias("rule"), "id"))
        .unionByName(ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti").select(F.lit("missing end").alias("rule"), "id"))
        .unionByName(edges.where("source = target").select(F.lit("self loop").alias("rule"), "id"))
    )
