"""Bounded derivation with provenance: proved, limit or failed, assumptions, negation, and a table of proof steps.

facts: (goal). rules: (rule, head, goal, negated), a row per literal of a rule's body; a goal is the text of a ground literal. The bound
is the number of rounds; each round is one join, one aggregate by rule, and a staged table.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.sources.tables import staged, staged_and_seen

STATUS = ("failed", "limit", "proved")


def derive(facts: DataFrame, rules: DataFrame, depth: int | None, assumptions: DataFrame | None = None) -> DataFrame:
    """(goal, round, via): each goal that can be proved in at most depth rounds (None: in any number), with the first round and the smallest rule that does.

    via is 'fact', 'assumption' or the rule. An assumed goal is not looked for in facts or rules. Negated literals must be decided: they
    range over goals that no rule concludes, so a negation holds where the goal is neither a fact nor assumed. A rule that negates
    a concluded goal is refused, since within a bound its failure could only be a limit.
    """
    heads = rules.select(F.col("head").alias("goal")).distinct()
    if not rules.where("negated").join(heads, "goal", "left_semi").isEmpty():
        raise ValueError("a rule negates a goal that rules conclude; decide it first and pass the result as facts")
    given = facts.select("goal").distinct()
    if assumptions is not None:
        assumed = assumptions.select("goal").distinct()
        base = assumed.withColumn("via", F.lit("assumption")).unionByName(given.join(assumed, "goal", "left_anti").withColumn("via", F.lit("fact")))
        rules = rules.join(assumed.withColumnRenamed("goal", "head"), "head", "left_anti")
    else:
        base = given.withColumn("via", F.lit("fact"))
    known = staged(base.select("goal", F.lit(0).alias("round"), "via"), "proof-known")
    # A negated literal is decided once; what is left of a rule is its positive body.
    refuted = rules.where("negated").join(known, "goal", "left_semi").select("rule").distinct()
    live = rules.join(refuted, "rule", "left_anti")
    need = live.groupBy("rule", "head").agg(F.sum(F.when(F.col("negated"), 0).otherwise(1)).alias("need"))
    body = staged(live.where("not negated").select("rule", "goal").distinct(), "proof-body")
    need = staged(need.join(body.groupBy("rule").agg(F.count("*").alias("distinct_need")), "rule", "left").select("rule", "head", F.coalesce("distinct_need", F.lit(0)).alias("need")), "proof-need")
    for k in count(1) if depth is None else range(1, depth + 1):
        met = body.join(known, "goal", "left_semi").groupBy("rule").agg(F.count("*").alias("met"))
        fired = need.join(met, "rule", "left").where(F.coalesce("met", F.lit(0)) == F.col("need"))
        new = fired.groupBy(F.col("head").alias("goal")).agg(F.min("rule").alias("via")).join(known, "goal", "left_anti")
        new, seen = staged_and_seen(new.select("goal", F.lit(k).alias("round"), "via"), "proof-round", n=F.count("*"))
        if not seen["n"]:
            break
        known = known.unionByName(new)
    return known


def status(goals: DataFrame, facts: DataFrame, rules: DataFrame, depth: int) -> DataFrame:
    """(goal, status): proved within depth, limit where more rounds could still prove it, failed where they could not.

    Whether more rounds could prove a goal is found by deriving until a round brings nothing; the round a goal is first proved in tells the two apart.
    """
    first = derive(facts, rules, None).select("goal", "round")
    joined = goals.select("goal").distinct().join(first, "goal", "left")
    return joined.select("goal", F.when(F.col("round") <= depth, "proved").when(F.col("round").isNotNull(), "limit").otherwise("failed").alias("status"))


def negation_status(inner: DataFrame) -> DataFrame:
    """Status of a negation from the statuses (goal, status) of its inner goal's attempts: proved only if none was proved and none hit the limit."""
    seen = inner.groupBy("goal").agg(F.bool_or(F.col("status") == "proved").alias("p"), F.bool_or(F.col("status") == "limit").alias("l"))
    return seen.select("goal", F.when(F.col("p"), "failed").when(F.col("l"), "limit").otherwise("proved").alias("status"))


def proof_steps(proved: DataFrame, rules: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, depth, goal, parent, kind, via): the steps under each root goal; kind is clause, fact, assumption or negation."""
    by = proved.select("goal", "via")
    at = roots.select(F.col("goal").alias("root"), "goal", F.lit(None).cast("string").alias("parent")).join(by, "goal")
    out = None
    for k in range(depth + 1):
        kind = F.when(F.col("via") == "fact", "fact").when(F.col("via") == "assumption", "assumption").otherwise("clause")
        here, seen = staged_and_seen(at.select("root", F.lit(k).alias("depth"), "goal", "parent", kind.alias("kind"), "via"), "proof-steps", n=F.count("*"))
        if not seen["n"] and out is not None:
            break
        out = here if out is None else out.unionByName(here)
        below = here.where("kind = 'clause'").select("root", F.col("goal").alias("parent"), F.col("via").alias("rule")).join(rules.select("rule", "goal", "negated"), "rule")
        out = out.unionByName(below.where("negated").select("root", F.lit(k + 1).alias("depth"), "goal", "parent", F.lit("negation").alias("kind"), F.lit(None).cast("string").alias("via")))
        at = below.where("not negated").select("root", "goal", "parent").distinct().join(by, "goal")
    return out.distinct()


def distinct_leaves(steps: DataFrame, kinds: tuple[str, ...] = ("fact", "assumption", "negation")) -> DataFrame:
    """(root, kind, goal, first_depth): each leaf of a proof once, with the depth at which it is met first."""
    return steps.where(F.col("kind").isin(*kinds)).groupBy("root", "kind", "goal").agg(F.min("depth").alias("first_depth"))


def superseded(statements: DataFrame, records: DataFrame, key: str, run_date: str | None) -> DataFrame:
    """statements with derived: whether they hold on the run date, which is before the date of the record that supersedes them.

    Without a run date no superseded statement is derived; statements without a record always are.
    """
    joined = statements.join(records.select(key, F.col("date").alias("__d")), key, "left")
    day = F.lit(run_date).try_cast("date") if run_date is not None else F.lit(None).cast("date")
    return joined.withColumn("derived", F.col("__d").isNull() | F.coalesce(day < F.col("__d").cast("date"), F.lit(False))).drop("__d")
