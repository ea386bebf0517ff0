"""Conditions, annotations and contexts of clauses on small fixtures."""

import pytest

from ferrule.operators import clauses

SCHEMA = "document string, sentence int, line int, ordinal int, predicate string, in_body boolean, world string, args array<string>"


def rows(spark, *said):
    return spark.createDataFrame(list(said), SCHEMA)


def test_events_of_a_body_meet_the_head_of_their_own_clause(spark):
    df = rows(
        spark,
        ("d", 1, 1, 0, "event", False, "actual", ["z", "do"]), ("d", 1, 1, 1, "event", True, "actual", ["x", "have"]), ("d", 1, 1, 2, "entity", True, "actual", ["e", "drug"]), ("d", 1, 1, 3, "event", True, "w", ["y", "have"]),
        ("d", 1, 2, 0, "event", False, "actual", ["f", "do"]), ("d", 1, 2, 1, "event", True, "actual", ["x", "have"]), ("d", 1, 2, 2, "event", True, "actual", ["f", "do"]),
        ("d", 1, 3, 0, "event", False, "actual", ["z", "do"]), ("d", 1, 3, 1, "event", True, "v", ["x", "have"]), ("d", 2, 4, 0, "event", False, "actual", ["z", "do"]), ("d", 2, 4, 1, "event", True, "actual", ["x", "have"]),
        ("d", 2, 5, 0, "grade", False, "actual", ["z", "high"]), ("d", 2, 5, 1, "event", True, "actual", ["x", "have"]), ("d", 2, 6, 0, "event", False, "actual", ["alone", "do"]),
    )
    edges = sorted((r.sentence, r.source[-1], r.target[-1], r.line, r.world) for r in clauses.condition_edges(df).collect())
    assert edges == [(1, "x", "f", 2, "actual"), (1, "x", "z", 1, "actual"), (1, "y", "z", 1, "w"), (2, "x", "z", 4, "actual")]
    merges = [(r.sentence, r.source[-1], r.target[-1], r.kept_line, r.kept_world, r.line, r.world) for r in clauses.condition_merges(df).collect()]
    assert merges == [(1, "x", "z", 1, "actual", 3, "v")]
    contexts = sorted((r.source, r.target, r.label, r.line) for r in clauses.context_edges(df).collect())
    assert contexts == [("context:d:actual", "event:d:f", "condition implies event", 2)] + [("context:d:actual", "event:d:z", "condition implies event", k) for k in (1, 3, 4)]


def test_an_annotation_has_one_node_and_none_is_lost(spark):
    df = rows(
        spark,
        ("d", 1, 1, 0, "entity", False, "a", ["both", "thing"]), ("d", 1, 1, 0, "event", False, "a", ["both", "do"]), ("d", 1, 1, 0, "value", False, "a", ["v", "3"]), ("d", 1, 2, 0, "grade", False, "a", ["both", "high"]),
        ("d", 1, 2, 0, "qualifier", False, "a", ["both", "often"]), ("d", 1, 2, 0, "grade", False, "a", ["v", "low"]), ("d", 1, 2, 0, "time", False, "a", ["nowhere", "daily"]), ("e", 1, 3, 0, "grade", True, "a", ["both", "high"]),
        ("d", 1, 4, 1, "grade", True, "a", ["both", "high"]), ("d", 1, 5, 1, "grade", True, "a", ["both", "high"]), ("d", 1, 5, 2, "grade", True, "not", ["both", "high"]),
    )
    nodes = clauses.declared(df)
    got = sorted((r.kind, r.source, r.label, r.found) for r in clauses.annotation_edges(df.where("not in_body"), nodes).collect())
    assert got == [("grade", "entity:d:both", "high", "declared"), ("grade", "value:d:v", "low", "declared"), ("qualifier", "event:d:both", "often", "declared"), ("time", "minted:d:nowhere", "daily", "minted")]
    body = sorted((r.source, r.world, r.line, r.times) for r in clauses.body_edges(df, nodes).collect())
    assert body == [("entity:d:both", "a", 4, 2), ("entity:d:both", "not", 5, 1), ("minted:e:both", "a", 3, 1)]


def test_property_referents_must_be_reached(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    clauses.refuse_unreached(spark.createDataFrame([("b",), ("c",)], "id string"), edges)
    with pytest.raises(ValueError, match="2 property referents that no edge reaches, first a"):
        clauses.refuse_unreached(spark.createDataFrame([("b",), ("a",), ("x",), ("a",)], "id string"), edges)


def test_conditions_of_clauses_that_lie_by_sentence_take_no_further_shuffle(spark):
    df = rows(spark, ("d", 1, 1, 0, "event", False, "actual", ["z", "do"]), ("d", 1, 1, 1, "event", True, "actual", ["x", "have"]), ("d", 1, 2, 0, "event", False, "actual", ["z", "do"]), ("d", 1, 2, 1, "event", True, "w", ["x", "have"])).repartition(3, "document", "sentence")
    for found in (clauses.condition_edges(df), clauses.condition_merges(df), clauses.context_edges(df).drop("target")):
        assert found.count() > 0
    assert clauses.condition_merges(df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
