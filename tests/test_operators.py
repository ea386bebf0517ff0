"""Operators and functions on small fixtures: edge cases, errors and brute force."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from ferrule.functions import arithmetic as ar
from ferrule.functions import quantities as qu
from ferrule.functions import strings as st
from ferrule.functions import terms as te
from ferrule.operators import answers, checks, graph, logic, prove, text, windows
from ferrule.plans.outcome import run
from ferrule.sources import text as sources
from ferrule.streaming import events as ev


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_integer_arithmetic(spark):
    for a, b in itertools.product([-13, -7, 0, 5, 12], [-5, -1, 3, 7]):
        x, y = F.lit(a).cast("long"), F.lit(b).cast("long")
        row = spark.range(1).select(ar.modulo(x, y), ar.remainder(x, y), ar.truncated(x, y), ar.floored(x, y), ar.greatest_divisor(x, y)).first()
        assert tuple(row) == (a % b, int(math.fmod(a, b)), int(a / b), a // b, math.gcd(a, b))
    big = F.lit(ar.LIMIT)
    assert one(spark, ar.truncated(big, F.lit(3).cast("long"))) == ar.LIMIT // 3
    assert one(spark, ar.integer_power(F.lit(2).cast("long"), F.lit(61))) == 2**61
    for refused in (ar.bounded(big + 1), ar.integer_power(F.lit(10).cast("long"), F.lit(30)), ar.shifted_left(big, 1), ar.integer_power(F.lit(2).cast("long"), F.lit(-1))):
        with pytest.raises(Exception, match="out of bounds"):
            one(spark, refused)


def test_what_a_stated_quantity_entails(spark):
    kinds, numbers = list(qu.COMPARISONS), range(0, 7)
    holds = {"eq": lambda c, x: x >= c, "exactly": lambda c, x: x == c, "geq": lambda c, x: x >= c, "greater": lambda c, x: x > c, "leq": lambda c, x: x <= c, "less": lambda c, x: x < c}
    points = [k / 2 for k in range(-10, 40)]
    rows = [(a, c, b, n) for a in kinds for c in numbers for b in kinds[:-1] for n in numbers]
    df = spark.createDataFrame(rows, "a string, c int, b string, n int").withColumn("got", qu.satisfies(F.col("a"), F.col("c"), F.col("b"), F.col("n")))
    for r in df.collect():
        want = r.a != "about" and all(holds[r.b](r.n, x) for x in points if holds[r.a](r.c, x))
        assert r.got == want, r
    assert one(spark, qu.satisfies_in_units(F.lit("exactly"), F.lit(2), F.lit("hour"), F.lit("leq"), F.lit(120), F.lit("minute")))
    assert one(spark, qu.quotient(*[F.lit(v).cast("long") for v in (1, 2, 0, 1)])) is None
    assert tuple(one(spark, qu.product(*[F.lit(v).cast("long") for v in (2, 3, -3, 4)]))) == (-1, 2)


def test_string_functions(spark):
    assert one(spark, st.occurrences(F.lit("aaa"), F.lit("aa"))) == [0, 1] and one(spark, st.occurrences(F.lit("a"), F.lit("ab"))) == []
    assert one(spark, st.code_points(F.lit("A💊é"))) == [65, 128138, 233]
    assert one(spark, st.coordinated(F.array(*map(F.lit, "abc")))) == "a, b, and c"
    assert [one(spark, st.singular(F.lit(w))) for w in ("studies", "classes", "doses", "bus", "is", "boxes")] == ["study", "class", "dose", "bus", "is", "box"]
    assert [one(spark, st.finite(F.lit(w))) for w in ("be", "have", "carry", "stay", "watch", "give")] == ["is", "has", "carries", "stays", "watches", "gives"]
    assert one(spark, st.phrase_in(F.array(*map(F.lit, "abc")), F.array(F.lit("b"), F.lit("c")))) and not one(spark, st.phrase_in(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))))
    labels = spark.createDataFrame([("a10",), ("a9",), ("b1",)], "x string")
    assert [r.x for r in labels.orderBy(st.padded_digits(F.col("x"))).collect()] == ["a9", "a10", "b1"]
    assert one(spark, te.quoted(F.lit("it's"))) == "'it\\'s'" and one(spark, te.quoted(F.lit("abc"))) == "abc"


def test_logic(spark):
    goal = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "x int, y string")
    seen = spark.createDataFrame([(1, 10), (1, 5), (2, None)], "x int, n int")
    assert sorted(r.x for r in logic.without(goal, seen.select("x")).collect()) == [3]
    assert sorted((r.x, r.n) for r in logic.ignore(goal, seen.where("n > 0"), [F.col("n")]).collect() if r.x < 3) == [(1, 5), (2, None)]
    assert sorted(r.x for r in logic.for_all(goal.select("x"), seen, F.col("n") > 1).collect()) == [1, 3]  # an unknown action fails
    with pytest.raises(ValueError):
        logic.conjunction(goal, spark.createDataFrame([(1,)], "z int"))
    need = spark.createDataFrame([(5,), (10,), (5,)], "n int")
    assert [r.x for r in logic.divide(seen, "x", "n", need).collect()] == [1]
    assert [(r.x, r.more) for r in logic.capped(goal, ["x"], 2).collect()] == [(1, True), (2, True)] and not logic.capped(goal, ["x"], 3).first().more


def test_outcomes(spark):
    rows = spark.range(10)
    assert run(rows, 10).kind == "answers" and run(rows.limit(0)).kind == "failure"
    capped = run(rows, 4)
    assert (capped.kind, capped.limit, len(capped.rows)) == ("limit", "answer-cap", 4)
    assert run(rows.select(F.raise_error(F.lit("no")))).kind == "error"
    assert run(rows, 10).kind == "answers"  # the session lives on
    for cap in (0, 100_001):
        with pytest.raises(ValueError):
            run(rows, cap)


def edges(spark, pairs):
    return spark.createDataFrame([(f"e{i}", "k", a, b) for i, (a, b) in enumerate(pairs)], "id string, kind string, source string, target string")


def test_graph(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("b", "d")])
    assert {r.node: r.depth for r in graph.within_steps(e, "a", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert [r.node for r in graph.shortest_path(e, "a", "d").orderBy("step").collect()] == ["a", "b", "d"]
    assert graph.shortest_path(e, "a", "y").count() == 0 and [r.node for r in graph.shortest_path(e, "a", "a").collect()] == ["a"]
    assert {r.node: r.component for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    nodes = spark.createDataFrame([(n, "k", f"node {i + 8}") for i, n in enumerate("abcd")], "id string, kind string, label string")
    kept, among = graph.neighbourhood(nodes, e, "a", 2, 3)
    assert sorted(r.node for r in kept.collect()) == ["a", "b", "c"] and among.count() == 3
    assert sorted((r.rule, r.id) for r in graph.violations(nodes, e).collect()) == [("missing end", "e4"), ("missing end", "e4")]
    loop = spark.createDataFrame([("1", "2", "-"), ("2", "1", "may")], "id string, parent string, operator string")
    with pytest.raises(ValueError):
        graph.scope_chains(loop)


def test_proofs(spark):
    facts = spark.createDataFrame([("f",), ("g",)], "goal string")
    rules = spark.createDataFrame(
        [("r1", "a", "f", False), ("r2", "b", "a", False), ("r2", "b", "g", False), ("r3", "c", "b", False), ("r4", "n", "f", True), ("r5", "m", "f", False), ("r5", "m", "zz", True), ("r6", "self", "self", False)],
        "rule string, head string, goal string, negated boolean",
    )
    got = {r.goal: (r.round, r.via) for r in prove.derive(facts, rules, 4).collect()}
    assert got == {"f": (0, "fact"), "g": (0, "fact"), "a": (1, "r1"), "m": (1, "r5"), "b": (2, "r2"), "c": (3, "r3")}
    goals = spark.createDataFrame([(x,) for x in ("a", "b", "c", "n", "self")], "goal string")
    status = {r.goal: r.status for r in prove.status(goals, facts, rules, 2).collect()}
    assert status == {"a": "proved", "b": "proved", "c": "limit", "n": "failed", "self": "failed"}
    assumed = prove.derive(facts, rules, 4, spark.createDataFrame([("a",)], "goal string"))
    assert {r.goal: r.via for r in assumed.collect()}["a"] == "assumption"
    # Without a premise the conclusion fails.
    assert "b" not in {r.goal for r in prove.derive(facts.where("goal <> 'g'"), rules, 4).collect()}
    with pytest.raises(ValueError):
        prove.derive(facts, rules.union(spark.createDataFrame([("r9", "q", "a", True)], rules.schema)), 2)
    steps = prove.proof_steps(prove.derive(facts, rules, 4), rules, spark.createDataFrame([("b",), ("m",)], "goal string"), 4)
    assert sorted((r.root, r.kind, r.goal, r.first_depth) for r in prove.distinct_leaves(steps).collect()) == [("b", "fact", "f", 2), ("b", "fact", "g", 1), ("m", "fact", "f", 1), ("m", "negation", "zz", 1)]
    said = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string")
    record = spark.createDataFrame([(1, "2022-12-29")], "k int, date string")
    for day, want in (("2022-12-28", [True, True]), ("2022-12-29", [False, True]), (None, [False, True]), ("2023-02-30", [False, True])):
        assert [r.derived for r in prove.superseded(said, record, "k", day).orderBy("k").collect()] == want


def test_negation_of_statuses(spark):
    rows = [("p", "proved"), ("p", "limit"), ("l", "limit"), ("l", "failed"), ("f", "failed")]
    assert {r.goal: r.status for r in prove.negation_status(spark.createDataFrame(rows, "goal string, status string")).collect()} == {"p": "failed", "l": "limit", "f": "proved"}


def test_text(spark):
    pages = spark.createDataFrame([(1, "Some  Text. With a passage: here"), (2, "none"), (3, None)], "p int, t string")
    wanted = spark.createDataFrame([(1, "a PASSAGE here"), (2, "text"), (3, ""), (4, "absent words")], "q int, s string")
    assert sorted((r.p, r.q, r.at) for r in text.located(pages, wanted, "t", "s", "p", "q", seed=4).collect()) == [(1, 1, 12), (1, 2, 4)]
    assert one(spark, text.longest_continuation(F.lit("xxabc"), F.lit("abcd"), 2)) == 3 and one(spark, text.longest_continuation(F.lit("x"), F.lit("abcd"), 2)) == 0
    assert one(spark, text.in_order(F.lit("a b c"), F.array(F.lit("a"), F.lit("c")))) and not one(spark, text.in_order(F.lit("a b c"), F.array(F.lit("c"), F.lit("a"))))
    spans = spark.createDataFrame([(1, "A 💊 dose.", [(2, 3, 7)])], "k int, t string, s array<struct<start:int,end:int,grp:int>>")
    assert [(r.grp, r.piece) for r in text.segments(spans, "k", "t", "s").orderBy("ord").collect()] == [(None, "A "), (7, "💊"), (None, " dose.")]


def test_boxes_against_brute_force(spark):
    import random

    rng = random.Random(1)
    boxes = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0.1, 2), rng.uniform(0.1, 1)) for i in range(80)]
    want = {(a[0], b[0]) for a, b in itertools.combinations(boxes, 2) if max(a[1], b[1]) - 0.2 < min(a[1] + a[3], b[1] + b[3]) + 0.2 and max(a[2], b[2]) - 0.2 < min(a[2] + a[4], b[2] + b[4]) + 0.2}
    got = checks.separation(spark.createDataFrame(boxes, "id int, x double, y double, w double, h double"), 0.2).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_answers_and_windows(spark):
    none = F.array().cast("array<struct<preposition:string,value:string>>")
    act = answers.action_text(F.lit("negative"), F.lit("be"), F.lit("late"), none, F.array(F.lit("often")))
    assert one(spark, act) == "often is not late"
    assert one(spark, answers.rule_text(F.array().cast("array<string>"), F.lit("staff"), F.lit("should"), F.array(F.lit("act")))) == "Staff should act."
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, None), (1, 4, None), (1, 5, "x")], "p int, o int, v string")
    assert [(r.shown, r.run) for r in windows.shown_once_per_run(rows, ["p"], ["o"], "v").orderBy("o").collect()] == [("x", 1), ("", 1), (None, 2), ("", 2), ("x", 3)]
    assert [r.o for r in answers.text_budget(rows.where("v is not null"), ["p"], ["o"], "v", 4).orderBy("o").collect()] == [1, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# region\tfile\n\nr1\tf\tp3\tA > B\tace(doc1)\nr2\tf\tp4\tA\tpending\n")
    rows = sources.coverage(spark, str(tmp_path / "c.tsv")).orderBy("region").collect()
    assert [(r.page, r.section, r.state, r.detail) for r in rows] == [(3, ["A", "B"], "ace", "doc1"), (4, ["A"], "pending", None)]
    (tmp_path / "bad.tsv").write_text("r1\tf\tp3\tA\twrong\n")
    with pytest.raises(Exception, match="unknown status"):
        sources.coverage(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "k.pl").write_text("% S1: one.\nfact_a(x,y).\n% S2: two.\nrule_b(X) :- fact_a(X,y), \\+ other(X).\n")
    got = sources.clause_sites(spark, str(tmp_path / "k.pl")).orderBy("line").collect()
    assert [(r.sentence, r.kind, r.predicate, r.arguments, r.body) for r in got] == [(1, "fact", "fact_a", "x,y", None), (2, "rule", "rule_b", "X", "fact_a(X,y), \\+ other(X)")]
    with pytest.raises(Exception, match="repeated key"):
        sources.unique_or_fail(spark.createDataFrame([("a",), ("a",)], "k string"), "k").collect()


def test_turn_events_and_streams(spark, tmp_path):
    (tmp_path / "t.ndjson").write_text('{"type":"call","conversation":1,"turn":1,"seq":1,"call":"q1"}\n{"type":"segment","conversation":1,"turn":1,"seq":2,"source":"kb","cited":["q1","q2"],"text":"x"}\n')
    assert [r.type for r in ev.read_turns(spark, str(tmp_path / "t.ndjson")).orderBy("seq").collect()] == ["call", "segment"]
    (tmp_path / "u.ndjson").write_text('{"type":"other"}\n')
    with pytest.raises(Exception, match="unknown event"):
        ev.read_turns(spark, str(tmp_path / "u.ndjson")).collect()
    segments = spark.createDataFrame([(1, 1, "kb", ["q1"]), (1, 2, "kb", ["q1", "q9"]), (1, 3, "web", []), (1, 4, "model", None)], "c int, segment int, source string, cited array<string>")
    ran = spark.createDataFrame([(1, "q1")], "c int, call string")
    assert [r.label for r in ev.audited(segments, ran, ["c"]).orderBy("segment").collect()] == ["kb", "unverified", "unverified", "model"]
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 7L as user_id, 'view' as event_type, 1.0D as value union all select timestamp'2024-01-01 00:20:00', 7L, 'view', 2.0D union all select timestamp'2024-01-01 09:00:00', 7L, 'view', 4.0D").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, user_id long, event_type string, value double").parquet(f"{tmp_path}/e")
    job = ev.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    job.awaitTermination(60)
    assert sorted((r.n, r.total) for r in spark.table("windows").collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in ev.session_counts(spark.read.parquet(f"{tmp_path}/e")).collect()) == [1, 2]


def test_division_brings_no_value_into_one_task_and_rows_are_spread_by_their_number(spark, monkeypatch):
    seen = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, "a"), (3, "b"), (3, "c")], "x int, n string")
    need = spark.createDataFrame([("a",), ("b",), ("a",)], "n string")
    found = logic.divide(seen, "x", "n", need)
    assert sorted(r.x for r in found.collect()) == [1, 3] and logic.divide(seen, "x", "n", need.limit(0)).collect() == []
    assert "BroadcastHashJoin [n#" in found._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(logic, "BROADCAST_ROWS", 1)
    assert sorted(r.x for r in logic.divide(seen, "x", "n", need).collect()) == [1, 3]
    from ferrule.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    rows = tables.spread(spark.range(95).coalesce(1))
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 95
