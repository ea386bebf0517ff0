"""Parents, ancestors and closures of many small graphs at once: pointer doubling and semi-naive rounds over keys of (group, node).

A group is what one graph belongs to, such as a sentence of a document; all groups are settled by the same rounds, and a group takes part only as long as it has something new.
Groups of at most SMALL rows, the usual ones, are settled each in one step after a single shuffle instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as to_arrow
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ferrule.sources.tables import staged, staged_and_seen, unstage


#: Most rows of a group that one step settles.
SMALL = 10_000


def _parted(rows: DataFrame, by: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of small groups and those of large ones, None where there are none. rows are read twice."""
    sizes, seen = staged_and_seen(rows.groupBy(*by).agg(F.count("*").alias("n")), "forest-sizes", most=F.max("n"))
    if (seen["most"] or 0) <= SMALL:
        unstage(sizes)
        return rows, None
    # One row for each SMALL rows of the input, at most.
    large = sizes.where(F.col("n") > SMALL).select(*[F.col(k).alias(f"__{k}") for k in by])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def _settled(rows: DataFrame, by: list[str], settle: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """(by, schema): what settle makes of the rows of each group, small ones."""
    rest = [k for k in rows.columns if k not in by]
    grouped = rows.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("__rows"))
    out = StructType([*[grouped.schema[k] for k in by], *StructType.fromDDL(schema)])
    made = [to_arrow(f.dataType) for f in out[len(by) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(by))
            flat, ends = list(zip(*[lists.values.field(k).to_pylist() for k in range(len(rest))])), lists.offsets.to_pylist()
            of, found = [], []
            for k in range(batch.num_rows):
                more = settle(flat[ends[k] : ends[k + 1]])
                of += [k] * len(more)
                found += more
            at, columns = pa.array(of, pa.int64()), list(zip(*found)) or [()] * len(made)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(by))], *[pa.array(c, t) for c, t in zip(columns, made)]], out.names)

    return grouped.mapInArrow(run, out)


def _walked(rows: list[tuple]) -> list[tuple]:
    """(node, up, root, depth) of one group's (node, up)."""
    up, known = dict(rows), {}
    for node in up:
        way, at = [], node
        while at not in known and up.get(at) is not None:
            known[at] = (None, None)
            way.append(at)
            at = up[at]
        root, depth = known.get(at, (at, 0))
        for step in reversed(way):
            depth = None if root is None else depth + 1
            known[step] = (root, depth)
    return [(node, above, *known.get(node, (node, 0))) for node, above in rows]


def _rooted(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, up, root, depth) of (by, node, up), see roots."""
    small, large = _parted(rows, by)
    kind = rows.schema["node"].dataType.simpleString()
    found = _settled(small, by, _walked, f"node {kind}, up {kind}, root {kind}, depth long")
    return found if large is None else found.unionByName(_doubled(large, by))


def roots(parents: DataFrame, by: list[str], node: str = "id", parent: str = "parent") -> DataFrame:
    """(by, node, root, depth): the last node above each one, itself where it has no parent, and how many steps away it is; both null where the way up runs into a cycle.

    Each round doubles the reach of all nodes, so a chain of n takes about log2(n) rounds. Nodes still on their way when the reach exceeds their group's
    size are on a cycle or below one. A parent that is no node of the group is a root. Nodes are distinct in their group.
    """
    rows = parents.select(*by, F.col(node).alias("node"), F.col(parent).cast(parents.schema[node].dataType).alias("up"))
    return _rooted(rows, by).select(*by, F.col("node").alias(node), "root", "depth")


def _doubled(rows: DataFrame, by: list[str]) -> DataFrame:
    """As _rooted, by rounds."""
    sizes, seen = staged_and_seen(rows.groupBy(*by).agg(F.count("*").alias("n")), "forest-sizes", most=F.max("n"))
    # at: the node the reach ends at; open: whether it may have a parent itself.
    state = staged(rows.select(*by, "node", "up", F.coalesce("up", "node").alias("at"), F.col("up").isNotNull().cast("long").alias("steps"), F.col("up").isNotNull().alias("open")), "forest-roots")
    reach = 1
    while reach <= 2 * (seen["most"] or 0):
        ahead = state.select(*by, F.col("node").alias("at"), F.col("at").alias("__at"), F.col("steps").alias("__steps"), F.col("open").alias("__open"))
        moved = state.where("open").join(ahead, [*by, "at"], "left")
        moved = moved.select(*by, "node", "up", F.coalesce("__at", "at").alias("at"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.coalesce("__open", F.lit(False)).alias("open"))
        after, going = staged_and_seen(state.where("not open").unionByName(moved), "forest-roots", n=F.count_if("open"))
        unstage(state)
        state, reach = after, reach * 2
        if not going["n"]:
            break
    unstage(sizes)
    return state.select(*by, "node", "up", F.when(~F.col("open"), F.col("at")).alias("root"), F.when(~F.col("open"), F.col("steps")).alias("depth"))


def ancestors(parents: DataFrame, by: list[str], node: str = "id", parent: str = "parent") -> DataFrame:
    """(by, node, ancestor, distance): all that lies above each node, from 1. Rounds double the distance. Nodes on or below a cycle are an error that counts them."""
    seen = roots(parents, by, node, parent).agg(F.count_if(F.col("root").isNull()).alias("lost"), F.max("depth").alias("deepest")).first()
    if seen["lost"]:
        raise ValueError(f"{seen['lost']} nodes are on or below a cycle")
    jump = parents.where(F.col(parent).isNotNull()).select(*by, F.col(node).alias("node"), F.col(parent).alias("ancestor"))
    out, width = jump.withColumn("distance", F.lit(1).cast("long")), 1
    if (seen["deepest"] or 0) > 1:
        jump = staged(jump, "forest-jump")
        out = jump.withColumn("distance", F.lit(1).cast("long"))
    while width < (seen["deepest"] or 0):
        # jump leads `width` steps up; out has all distances up to width.
        above = out.select(*by, F.col("node").alias("via"), F.col("ancestor").alias("__a"), F.col("distance").alias("__d"))
        farther = jump.withColumnRenamed("ancestor", "via").join(above, [*by, "via"]).select(*by, "node", F.col("__a").alias("ancestor"), (F.col("__d") + width).alias("distance"))
        farther = staged(farther, "forest-ancestors")
        out = out.unionByName(farther)
        jump = farther.where(F.col("distance") == 2 * width).select(*by, "node", "ancestor")
        width *= 2
    return out.withColumnRenamed("node", node)


def chains(parents: DataFrame, by: list[str], value: str, node: str = "id", parent: str = "parent") -> DataFrame:
    """(by, node, chain, depth): a value of each node and of all above it, from the innermost outwards."""
    own = parents.select(*by, F.col(node).alias("ancestor"), F.col(value).alias("v"))
    up = ancestors(parents, by, node, parent).select(*by, node, "ancestor", "distance").unionByName(parents.select(*by, node, F.col(node).alias("ancestor"), F.lit(0).cast("long").alias("distance")))
    items = F.sort_array(F.collect_list(F.struct("distance", "v")))  # one node's chain
    return up.join(own, [*by, "ancestor"]).groupBy(*by, node).agg(F.transform(items, lambda x: x["v"]).alias("chain")).withColumn("depth", F.size("chain"))


def embedded(events: DataFrame, contexts: DataFrame, by: list[str]) -> DataFrame:
    """(by, event, parent): the event that each event of a group sits in, null where there is none or where the group's parents run in a circle; circular tells which.

    events: (by, event, ordinal, context, subject, objects array, others array), others being what an event names beside its objects and subject. contexts: (by, context, outer). An event sits in the
    first other one, by ordinal, of another subject that either has its subject as an object in the same context, or that stands in a context around its own and has
    anything it names as an object. Events without a subject sit in none.
    """
    around = ancestors(contexts, by, "context", "outer").groupBy(*by, "context").agg(F.collect_set("ancestor").alias("around"))  # one context's
    holds = events.select(*by, F.col("event").alias("parent"), F.col("ordinal").alias("nth"), F.col("context").alias("p_context"), F.col("subject").alias("p_subject"), F.explode(F.array_distinct("objects")).alias("ref"))
    askers = events.where("subject is not null").join(around, [*by, "context"], "left")
    # Without a context around its own, only its subject can lead to a parent.
    asked = F.when(F.col("around").isNull(), F.array("subject")).otherwise(F.array_distinct(F.concat(F.array("subject"), "objects", "others")))
    named = askers.select(*by, "event", "context", "subject", "around", F.explode(asked).alias("ref"))
    apart = (F.col("parent") != F.col("event")) & ~F.col("p_subject").eqNullSafe(F.col("subject"))
    same = (F.col("ref") == F.col("subject")) & (F.col("context") == F.col("p_context"))
    found = named.join(holds, [*by, "ref"]).where(apart & (same | F.array_contains("around", F.col("p_context"))))
    first = found.groupBy(*by, "event").agg(F.min_by("parent", "nth").alias("parent"))
    rows = staged(events.select(*by, "event").join(first, [*by, "event"], "left"), "embedded-parents")
    walked = _rooted(rows.select(*by, F.col("event").alias("node"), F.col("parent").alias("up")), by)
    circular = F.max(F.col("root").isNull()).over(Window.partitionBy(*by))
    out = walked.select(*by, F.col("node").alias("event"), F.col("up").alias("parent"), circular.alias("circular"))
    return out.withColumn("parent", F.when(~F.col("circular"), F.col("parent")))


def owned(heads: DataFrame, events: DataFrame, by: list[str], follows: Column | None = None) -> DataFrame:
    """(by, event, ordinal): the heads that each main event owns, its own and those of what they name.

    heads: (by, ordinal, name, low, refs array), low being what a head is about and refs the referents it names; events: (by, event, parent), main where parent is null. A main event owns itself and the
    events embedded in it, all heads that are about something it owns, and the referents these name, but for other main events. follows, an expression over a head, gives
    a referent that such a head brings with it only for heads whose `ranged` column is true (a range goes with the interval over its quantity).

    Where groups are large, keys are (by, main event, referent); a round looks only at referents that are new, so settled groups cost nothing further.
    """
    ranged = F.col("ranged") if "ranged" in heads.columns else F.lit(False)
    heads = heads.select(*by, "ordinal", "low", "refs", ranged.alias("ranged"), (follows if follows is not None else F.lit(None).cast("string")).alias("brings"))
    events = events.select(*by, "event", "parent")
    # An event is a row without an ordinal of its own.
    of = heads.select(*by, F.lit(True).alias("head"), "ordinal", "low", "refs", "ranged", "brings", F.lit(None).cast(events.schema["event"].dataType).alias("event"), F.lit(None).cast(events.schema["parent"].dataType).alias("parent"))
    given = [F.lit(None).cast(heads.schema[k].dataType).alias(k) for k in ("ordinal", "low", "refs", "ranged", "brings")]
    rows = staged(of.unionByName(events.select(*by, F.lit(False).alias("head"), *given, "event", "parent")), "owned-rows")
    small, large = _parted(rows, by)
    kinds = [rows.schema[k].dataType.simpleString() for k in ("event", "ordinal")]
    found = _settled(small, by, _owned, f"event {kinds[0]}, ordinal {kinds[1]}")
    if large is None:
        return found
    return found.unionByName(_owned_by_rounds(large.where("head").select(*heads.columns), large.where("not head").select(*events.columns), by))


def _owned(rows: list[tuple]) -> list[tuple]:
    """(event, ordinal) of one group's rows, see owned."""
    about, tree, out = {}, [], []
    for head, ordinal, low, refs, ranged, brings, event, parent in rows:
        if head:
            about.setdefault(low, []).append((ordinal, refs, ranged, brings))
        else:
            tree.append((event, parent))
    main, owns = {e for e, up in tree if up is None}, {}
    for event, _, root, _ in _walked(tree):
        if root is not None:
            owns.setdefault(root, []).append((event, False))
    for event, todo in owns.items():
        known, met = set(todo), set()
        while todo:
            ref, only = todo.pop()
            for ordinal, refs, ranged, brings in about.get(ref, ()) if ref is not None else ():
                if only and not ranged or ordinal in met:
                    continue
                met.add(ordinal)
                new = [(r, False) for r in refs or () if r is not None and (r == event or r not in main)] + [(brings, True)] * (brings is not None)
                for key in new:
                    if key not in known:
                        known.add(key)
                        todo.append(key)
        out += [(event, ordinal) for ordinal in met]
    return out


def _owned_by_rounds(heads: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """As owned, by rounds; heads have ranged and brings."""
    main = events.where("parent is null").select(*by, F.col("event").alias("ref"))
    tree = roots(events, by, "event", "parent").select(*by, F.col("root").alias("event"), F.col("event").alias("ref")).where("event is not null")
    heads = staged(heads, "owned-heads")
    fresh = staged(tree.withColumn("only_ranged", F.lit(False)), "owned-new")
    known, out = fresh, None
    while True:
        met = fresh.withColumnRenamed("ref", "low").join(heads, [*by, "low"]).where("not only_ranged or ranged").select(*by, "event", "ordinal", "refs", "brings")
        met = met.dropDuplicates([*by, "event", "ordinal"])
        if out is not None:
            met = met.join(out.select(*by, "event", "ordinal"), [*by, "event", "ordinal"], "left_anti")
        met, seen = staged_and_seen(met, "owned-heads-new", n=F.count("*"))
        if not seen["n"]:
            return (out if out is not None else met).select(*by, "event", "ordinal")
        out = met if out is None else out.unionByName(met)
        refs = met.select(*by, "event", F.explode("refs").alias("ref")).join(main.withColumn("main", F.lit(True)), [*by, "ref"], "left").where("main is null or ref = event").select(*by, "event", "ref", F.lit(False).alias("only_ranged"))
        brought = met.where("brings is not null").select(*by, "event", F.col("brings").alias("ref"), F.lit(True).alias("only_ranged"))
        new = refs.unionByName(brought).distinct().join(known, [*by, "event", "ref", "only_ranged"], "left_anti")
        fresh = staged(new, "owned-new")
        known = known.unionByName(fresh)
