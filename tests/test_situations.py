"""Derivation by clauses of a context's own against the derivation that has them among its rules, and what it writes on the way."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ferrule.operators import contexts, situations
from ferrule.plans import derivation_queries
from ferrule.sources import tables

BODY = "array<struct<goal: string, negated: boolean>>"


def program(seed):
    """Clauses of contexts 0 to 4 and what they share; only b goals are assumed, only s goals have rules."""
    r = random.Random(seed)
    base, ruled = [f"b({k})" for k in range(6)], [f"s({k})" for k in range(4)]
    facts = [(r.choice(base[:4] + ["t(1)", "t(2)"]),) for _ in range(8)]
    rules = [(f"r{k}", r.choice(ruled), i, r.choice([*ruled, "t(1)", "t(2)", "t(3)"]), r.random() < 0.2) for k in range(7) for i in range(r.randrange(1, 3))]
    rules = [(n, {x[0]: x[1] for x in rules}[n], i, g, neg) for n, _, i, g, neg in rules]
    clauses = {(c, f"h({c},{r.randrange(2)})", tuple((r.choice(base + ruled + ["u(1)"]), r.random() < 0.3) for _ in range(r.randrange(1, 4)))) for c in range(5) for _ in range(4)}
    return facts, rules, sorted(clauses), [(c, r.choice(base)) for c in range(5) for _ in range(2)]


def frames(spark, facts, rules, clauses, premises):
    return (
        spark.createDataFrame(clauses, f"context int, head string, body {BODY}"), spark.createDataFrame(premises, "context int, goal string"),
        spark.createDataFrame(facts, "goal string"), spark.createDataFrame(rules, "rule string, head string, ordinal int, goal string, negated boolean"),
    )


@pytest.mark.parametrize("seed, depth, many", [(1, 3, 500_000), (2, 1, 500_000), (3, 2, 0)])
def test_clauses_of_contexts_give_what_they_give_among_the_rules(spark, seed, depth, many, monkeypatch):
    monkeypatch.setattr(situations, "BROADCAST_ROWS", many)
    clauses, premises, facts, rules = frames(spark, *program(seed))
    assert situations._apart(clauses, premises, facts, rules, None) is not None
    want = contexts.derived(clauses.select("context", F.col("head").alias("goal")), premises, facts, situations.as_rules(clauses, rules), depth)
    assert sorted(map(tuple, situations.outcomes(clauses, premises, facts, rules, depth).collect())) == sorted(map(tuple, want.outcomes().collect()))
    assert sorted(map(tuple, situations.leaves(clauses, premises, facts, rules, depth).collect())) == sorted(map(tuple, want.leaves().collect()))


def test_where_a_rule_leads_from_an_assumed_goal_contexts_are_valued_as_before(spark):
    rules = [("r", "s(1)", 0, "b(1)", False)]
    clauses, premises, facts, rules = frames(spark, [("t(1)",)], rules, [(1, "h(1)", [("s(1)", False), ("t(1)", False)]), (2, "h(2)", [("s(1)", False)])], [(1, "b(1)")])
    assert situations._apart(clauses, premises, facts, rules, None) is None
    assert sorted(map(tuple, situations.outcomes(clauses, premises, facts, rules, 3).collect())) == [(1, "h(1)", 1, "proved"), (2, "h(2)", 0, "failed")]
    assert sorted(map(tuple, situations.leaves(clauses, premises, facts, rules, 3).collect())) == [(1, "h(1)", "assumption", "b(1)"), (1, "h(1)", "fact", "t(1)")]


def test_gates_are_judged_as_among_the_rules(spark):
    said = lambda *goals: [(g, False) for g in goals]
    clauses = [("d", 1, "h(1)", said("a(1)", "b(1)")), ("d", 1, "h(2)", said("c(1)")), ("d", 2, "h(3)", said("a(1)")), ("d", 2, "h(3)", said("b(1)")), ("e", 1, "h(4)", said("s(1)"))]
    gates = [
        ("d", 1, 1, 1, True, "h(1)"), ("d", 1, 1, 2, True, "h(2)"), ("d", 1, 2, 1, True, "h(1)"), ("d", 1, 2, 2, False, "rule(1)"), ("d", 1, 2, 3, True, "h(2)"), ("d", 2, 1, 1, True, "h(3)"),
        ("d", 2, 1, 1, True, "h(3)"), ("e", 1, 1, 1, True, "h(4)"), ("e", 1, 2, 1, True, "h(9)"), ("f", 1, 1, 1, False, "rule(1)"), ("f", 2, 1, 1, True, None), ("g", 1, 3, 1, True, "h(8)"),
    ]
    gates = spark.createDataFrame(gates, "document string, sentence int, gate int, place int, use boolean, goal string")
    clauses = spark.createDataFrame(clauses, f"document string, sentence int, head string, body {BODY}")
    premises = spark.createDataFrame([("d", 1, "a(1)"), ("d", 2, "a(1)")], "document string, sentence int, goal string")
    facts = spark.createDataFrame([("b(1)",), ("b(1)",)], "goal string")
    rules = spark.createDataFrame([("x", "s(1)", 0, "deep(1)", False), ("y", "deep(1)", 0, "b(1)", False)], "rule string, head string, ordinal int, goal string, negated boolean")
    context = F.struct("document", "sentence").alias("context")
    for depth in (1, 2, 4):
        assert situations._apart(clauses.select(context, "head", "body"), premises.select(context, "goal"), facts, rules, gates.where("use and goal is not null").select("goal")) is not None
        want = contexts.derived_sentences(gates, premises, facts, situations.as_rules(clauses.select(context, "head", "body"), rules), depth)
        got = situations.sentences(gates, clauses, premises, facts, rules, depth)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="deep"):
        situations.sentences(gates, clauses, premises, facts, rules, 2, relations={"a", "b", "c", "h", "s", "rule"})


def staged_mb(spark) -> float:
    folder = Path(tables.shared_dir(spark).removeprefix("file://")) / "staged"
    return sum(p.stat().st_size for p in folder.rglob("*.parquet")) / 1e6


@pytest.mark.parametrize("query", ["kb_proof_support", "kb_sentence_derivation", "kb_proof_counts"])
def test_lines_are_written_once_on_the_way(spark, query):
    before = staged_mb(spark)
    assert getattr(derivation_queries, query)(spark, "/root/testdata/sf0.001").count()
    assert staged_mb(spark) - before < 0.25
