"""Bounded derivation where the heads of a context rest on clauses of its own: facts and rules are shared and valued once by goal, and a context's clauses and premises meet once, in one row.

clauses: (context, head, body), each once, body an array of (goal, negated) in order; a head is one context's. premises, facts and rules are those of contexts, whose results these are
with the clauses among the rules. A context's clauses are few, and a body's literals too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import contexts
from ferrule.operators.contexts import COUNT, predicate
from ferrule.sources.tables import staged_and_seen

#: Rows of a counted table that may be broadcast.
BROADCAST_ROWS = 500_000
#: Literals of a body, each of which takes a join; where one is longer the clauses are rules among others.
LITERALS = 12


def as_rules(clauses: DataFrame, rules: DataFrame) -> DataFrame:
    """rules with the clauses among them."""
    rule = F.to_json(F.struct("context", "head", "body"))
    flat = clauses.select(rule.alias("rule"), "head", F.posexplode("body").alias("ordinal", "b")).select("rule", "head", "ordinal", "b.goal", "b.negated")
    return rules.select(*flat.columns).unionByName(flat)


def _places(clauses: DataFrame) -> tuple[set[str], list[set[str]]] | None:
    """The predicates of the heads, and of the literals by their place in a body; None where they are too many to tell."""
    at = F.concat(F.array(F.struct(F.lit(-1).alias("place"), predicate(F.col("head")).alias("name"))), F.transform("body", lambda x, i: F.struct(i.alias("place"), predicate(x["goal"]).alias("name"))))
    found = clauses.select(F.explode(at).alias("p")).select("p.*").distinct().limit(contexts.NAMES + 1).collect()
    deepest = max((r.place for r in found), default=-1)
    if len(found) > contexts.NAMES or deepest >= LITERALS:
        return None
    return {r.name for r in found if r.place < 0}, [{r.name for r in found if r.place == k} for k in range(deepest + 1)]


def _apart(clauses: DataFrame, premises: DataFrame, facts: DataFrame, rules: DataFrame, goals: DataFrame | None) -> tuple[list[set[str]], set[str], set[str]] | None:
    """(predicates of literals by place, those with rules, those assumed) where a context's clauses can be valued by themselves: nothing else cites or concludes their heads, and no rule leads from an assumed goal to a literal."""
    places, bearing = _places(clauses), contexts._bearing(rules, premises)
    ruled, cited, given, assumed = contexts._names(rules, "head"), contexts._names(rules), contexts._names(facts), contexts._names(premises)
    asked = contexts._names(goals) if goals is not None else []
    if None in (places, bearing, ruled, cited, given, assumed, asked):
        return None
    own, at = places
    literals = set().union(*at)
    if own & {*literals, *ruled, *cited, *given, *assumed} or literals & {*bearing} & {*ruled} or not {*asked} <= own:
        return None
    return at, set(ruled), set(assumed)


def _shared(clauses: DataFrame, facts: DataFrame, rules: DataFrame, depth: int, literals: set[str], ruled: set[str], leaves: bool) -> tuple[DataFrame, DataFrame | None]:
    """(name, goal, n, lim, facts) of the literals' goals that have a value, by themselves, and the leaves (root, kind, goal) of those with rules."""
    of = lambda rows, names: rows.where(predicate(F.col("goal")).isin(sorted(names)))
    bare = of(facts, literals - ruled).groupBy("goal").agg(F.count("*").cast(COUNT).alias("n")).select("goal", "n", F.lit(False).alias("lim")) if depth else None
    below = None
    if literals & ruled:
        asked = of(clauses.select(F.explode("body.goal").alias("goal")), literals & ruled).distinct().select(F.lit(0).alias("context"), "goal")
        found = contexts.derived(asked, asked.limit(0), facts, rules, depth)
        derived = contexts._valued(found.heads, found.values[depth]).select("goal", "n", "lim")
        bare = derived if bare is None else bare.unionByName(derived)
        below = found.leaves().select("root", "kind", "goal") if leaves else None
    if bare is None:
        bare = facts.limit(0).select("goal", F.lit(0).cast(COUNT).alias("n"), F.lit(False).alias("lim"))
    return bare.select(predicate(F.col("goal")).alias("name"), "goal", "n", "lim"), below


def _situated(clauses: DataFrame, premises: DataFrame, facts: DataFrame, rules: DataFrame, depth: int, apart: tuple, leaves: bool, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(context, clauses, premises, more): a row per context, its clauses with the values of their literals; and the leaves of goals with rules. more: (context, more), rows that meet there too."""
    at, ruled, assumed = apart
    values, below = _shared(clauses, facts, rules, depth - 1, set().union(*at), ruled, leaves)
    values, seen = staged_and_seen(values, "situations-values", freed=True, n=F.count("*"))
    rows = clauses.select("context", "head", F.size("body").alias("size"), F.transform("body", lambda x: x["negated"]).alias("negated"), *[F.get("body", F.lit(k))["goal"].alias(f"g{k}") for k in range(len(at))])
    sizes = {r.name: r["count"] for r in values.groupBy("name").count().collect()} if seen["n"] else {}
    many = lambda k: sum(sizes.get(name, 0) for name in at[k])
    # Small tables are met first, where the rows lie; each other one takes a shuffle of the clauses.
    for k in sorted(range(len(at)), key=many):
        known = values.where(F.col("name").isin(sorted(at[k]))).select(F.col("goal").alias("__goal"), F.struct("n", "lim").alias(f"v{k}"))
        rows = rows.join(F.broadcast(known) if many(k) <= BROADCAST_ROWS else known, F.col(f"g{k}") == F.col("__goal"), "left").drop("__goal")
        if not leaves and not at[k] & assumed:
            rows = rows.withColumn(f"g{k}", F.lit(None).cast("string"))  # only goals that may be assumed are still asked for
    missing = F.struct(F.lit(0).cast(COUNT).alias("n"), F.lit(depth == 1).alias("lim"))

    def literal(k: int) -> Column:
        value = F.coalesce(F.col(f"v{k}"), missing)
        return F.struct(F.col(f"g{k}").alias("goal"), F.get("negated", F.lit(k)).alias("negated"), value["n"].alias("n"), value["lim"].alias("lim"))

    body = F.slice(F.array(*[literal(k) for k in range(len(at))]), F.lit(1), F.col("size")) if at else F.array().cast("array<struct<goal:string,negated:boolean,n:decimal(38,0),lim:boolean>>")
    met = rows.select("context", F.struct("head", body.alias("body")).alias("clause"), F.lit(None).cast("string").alias("premise"))
    met = met.unionByName(premises.select("context", F.lit(None).cast(met.schema["clause"].dataType).alias("clause"), F.col("goal").alias("premise")))
    gathered = [F.collect_list("clause").alias("clauses"), F.collect_set("premise").alias("premises")]
    if more is not None:
        met = met.unionByName(more, allowMissingColumns=True)
        gathered.append(F.collect_list("more").alias("more"))
    return met.repartition("context").groupBy("context").agg(*gathered), below


def _judged(situated: DataFrame) -> DataFrame:
    """situated with each clause as (head, n, lim, body), each literal with its context's n and lim and whether it is assumed."""

    def literal(x: Column, premises: Column) -> Column:
        assumed = F.coalesce(F.array_contains(premises, x["goal"]), F.lit(False))
        n, lim = F.when(assumed, F.lit(1).cast(COUNT)).otherwise(x["n"]), ~assumed & x["lim"]
        return F.struct(
            x["goal"].alias("goal"), x["negated"].alias("negated"), assumed.alias("assumed"),
            F.when(x["negated"], ((n == 0) & ~lim).cast("int").cast(COUNT)).otherwise(n).alias("n"), F.when(x["negated"], (n == 0) & lim).otherwise(lim).alias("lim"),
        )

    def clause(x: Column) -> Column:
        start = F.struct(F.lit(1).cast(COUNT).alias("n"), F.lit(False).alias("lim"))
        # A body meets the limit at a literal before which all are proved.
        value = F.aggregate(x["body"], start, lambda a, y: F.struct((a["n"] * y["n"]).cast(COUNT).alias("n"), (a["lim"] | ((a["n"] > 0) & y["lim"])).alias("lim")))
        return F.struct(x["head"].alias("head"), value.alias("value"), x["body"].alias("body"))

    once = situated.withColumn("clauses", F.transform("clauses", lambda x: F.struct(x["head"].alias("head"), F.transform(x["body"], lambda y: literal(y, F.col("premises"))).alias("body"))))
    return once.withColumn("clauses", F.transform("clauses", clause))


def _status(n: Column, lim: Column) -> Column:
    return F.when(n > 0, "proved").when(lim, "limit").otherwise("failed")


def outcomes(clauses: DataFrame, premises: DataFrame, facts: DataFrame, rules: DataFrame, depth: int, relations: set[str] | None = None) -> DataFrame:
    """(context, goal, proofs, status) of the clauses' heads, as contexts.Derivation.outcomes."""
    apart = _checked(clauses, premises, facts, rules, depth, relations)
    if apart is None:
        return contexts.derived(clauses.select("context", F.col("head").alias("goal")), premises, facts, as_rules(clauses, rules), depth, relations=relations).outcomes()
    found = _judged(_situated(clauses, premises, facts, rules, depth, apart, False)[0])
    of = found.select("context", F.explode("clauses").alias("c")).groupBy("context", F.col("c.head").alias("goal"))
    of = of.agg(F.sum("c.value.n").cast(COUNT).alias("proofs"), F.bool_or("c.value.lim").alias("lim"))
    return of.select("context", "goal", "proofs", _status(F.col("proofs"), F.col("lim")).alias("status"))


def leaves(clauses: DataFrame, premises: DataFrame, facts: DataFrame, rules: DataFrame, depth: int, relations: set[str] | None = None) -> DataFrame:
    """(context, root, kind, goal) of the clauses' heads, as contexts.Derivation.leaves."""
    apart = _checked(clauses, premises, facts, rules, depth, relations)
    if apart is None:
        return contexts.derived(clauses.select("context", F.col("head").alias("goal")), premises, facts, as_rules(clauses, rules), depth, relations=relations).leaves()
    situated, below = _situated(clauses, premises, facts, rules, depth, apart, True)
    proved = _judged(situated).select("context", F.explode("clauses").alias("c")).where("c.value.n > 0").select("context", F.col("c.head").alias("root"), F.explode("c.body").alias("b"))
    kind = F.when(F.col("b.negated"), "negation").when(F.col("b.assumed"), "assumption").when(~predicate(F.col("b.goal")).isin(sorted(apart[1])), "fact")
    rows = proved.select("context", "root", kind.alias("kind"), F.col("b.goal").alias("goal"))
    if below is None:
        return rows.distinct()
    # A literal with rules stands for the leaves of its own proofs.
    below, seen = staged_and_seen(below.select(F.col("root").alias("__of"), F.col("kind").alias("__kind"), F.col("goal").alias("__goal")), "situations-leaves", freed=True, n=F.count("*"))
    if seen["n"] <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(below), F.col("kind").isNull() & (F.col("goal") == F.col("__of")), "left")
        return met.select("context", "root", F.coalesce("kind", "__kind").alias("kind"), F.coalesce("__goal", "goal").alias("goal")).distinct()
    met = rows.where("kind is null").join(below, F.col("goal") == F.col("__of")).select("context", "root", F.col("__kind").alias("kind"), F.col("__goal").alias("goal"))
    return rows.where("kind is not null").unionByName(met).distinct()


def sentences(gates: DataFrame, clauses: DataFrame, premises: DataFrame, facts: DataFrame, rules: DataFrame, depth: int, relations: set[str] | None = None) -> DataFrame:
    """(document, sentence, gate, status, proofs), as contexts.derived_sentences; clauses and premises have document and sentence for a context."""
    context = F.struct("document", "sentence").alias("context")
    own, held = clauses.select(context, "head", "body"), premises.select(context, "goal")
    goals = gates.where("use and goal is not null").select("goal")
    apart = _checked(own, held, facts, rules, depth, relations, goals)
    if apart is None:
        return contexts.derived_sentences(gates, premises, facts, as_rules(own, rules), depth, relations=relations)
    more = gates.select(context, F.struct("gate", "place", "use", "goal").alias("more"))
    found = _judged(_situated(own, held, facts, rules, depth, apart, False, more)[0])
    value = lambda x: F.filter("clauses", lambda y: y["head"] == x["goal"])
    total = lambda of: F.aggregate(of, F.lit(0).cast(COUNT), lambda a, y: (a + y["value"]["n"]).cast(COUNT))
    rows = found.select("context", F.explode(F.transform("more", lambda x: F.struct(x.alias("g"), total(value(x)).alias("n"), F.exists(value(x), lambda y: y["value"]["lim"]).alias("lim")))).alias("m")).select("context", "m.g.*", "m.n", "m.lim")
    # Rows of a gate's body up to the first that is no use.
    ended = F.max(~F.col("use")).over(Window.partitionBy("context", "gate").orderBy("place"))
    rows = rows.withColumn("status", F.when(~ended & F.col("goal").isNotNull(), _status(F.col("n"), F.col("lim"))))
    one = rows.groupBy("context", "gate").agg(
        F.aggregate(F.collect_list(F.when(F.col("status").isNotNull(), F.col("n"))), F.lit(1).cast(COUNT), lambda a, x: (a * x).cast(COUNT)).alias("proofs"), F.bool_or(F.col("status") == "failed").alias("f"), F.bool_or(F.col("status") == "limit").alias("l")
    )
    judged = one.select("context", "gate", F.when(F.col("f"), "failed").when(F.col("l"), "limit").otherwise("proved").alias("status"), "proofs")
    w = Window.partitionBy("context").orderBy(F.when(F.col("status") == "proved", 0).otherwise(1), "gate")
    return judged.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("context.document", "context.sentence", "gate", "status", "proofs")


def _checked(clauses: DataFrame, premises: DataFrame, facts: DataFrame, rules: DataFrame, depth: int, relations: set[str] | None, goals: DataFrame | None = None) -> tuple | None:
    if relations is not None:
        cited = clauses.select(F.explode(F.concat(F.array("head"), F.col("body.goal"))).alias("goal"))
        contexts.refuse_unknown(relations, cited, premises, facts, rules, rules.select(F.col("head").alias("goal")), *([goals] if goals is not None else []))
    return _apart(clauses, premises, facts, rules, goals) if depth > 0 else None
