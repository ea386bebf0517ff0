"""Steps whose cost grew with more than their rows: what they read, shuffle and sort."""

import numpy as np

from ferrule.operators import clauses, concepts, graph, text, windows
from ferrule.plans import catalogue, network_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_evidence_reads_its_rows_once(spark, tmp_path):
    said = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("a", None, "z"), ("b", 1, "x"), ("b", 1, "x"), ("b", None, "w"), ("c", 1, "x"), (None, 1, "x"), (None, None, "x")]
    spark.createDataFrame(said, "document string, sentence int, target string").write.parquet(str(tmp_path / "rows"))
    cited = spark.createDataFrame([("a", 2), ("a", 2), ("a", 3), ("b", None), ("b", 1), ("d", None), (None, None), (None, 1)], "document string, sentence int")
    found = graph.evidence(spark.read.parquet(str(tmp_path / "rows")), cited)
    assert plan(found).count("FileScan parquet") == 1
    assert sorted(map(tuple, found.collect()), key=str) == [("a", 2, "y"), ("b", 1, "x"), ("b", None, "w")]


def test_edges_of_lines_are_those_of_the_star(spark):
    where = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{where}/lineitem.parquet").selectExpr("l_orderkey as document", "l_linenumber as sentence", "l_partkey as part", "l_suppkey as supplier", "l_returnflag as scope")
    made, star = graph.line_edges(lines), graph.star_edges(spark, where).where("document is not null")
    assert made.exceptAll(star.select(*made.columns)).isEmpty() and star.select(*made.columns).exceptAll(made).isEmpty()


def test_variants_take_one_shuffle_and_no_join(spark):
    found = catalogue.kb_variant_numbering(spark, "/root/testdata/sf0.001")
    assert plan(found).count("Exchange") == 1 and "Join" not in plan(found)
    rows = spark.createDataFrame([("d", "b", 2), ("d", "a", 3), ("d", "b", 1), ("d", None, 4), ("e", "a", 9), ("e", "a", 9)], "part string, variant string, place int")
    assert sorted(map(tuple, windows.variants(rows, ["part"], ["variant"], ["place"]).collect()), key=str) == [("d", "a", 2), ("d", "b", 1), ("d", None, 3), ("e", "a", 1)]


def test_focus_sets_name_what_is_distinct(spark):
    lines = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "a", "a"), (4, "c", None), (5, None, "c"), (6, None, None)], "line int, source string, target string")
    found = concepts.focus_sets(lines, spark.createDataFrame([(1, 7, 1), (1, 7, 1), (2, 7, 1), (4, 8, 1)], "line int, document int, sentence int"))
    for line in plan(found).splitlines():
        assert "Exchange" not in line or "key#" not in line
    own = lambda *ends: {(x and f"concept:{x}", x, y) for x in ends for y in ends}
    rules = {("rule:7:1", None, "a"), ("rule:7:1", None, "b"), ("rule:8:1", None, "c"), ("rule:8:1", None, None)}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == own("a", "b") | own("c", None) | rules and len(got) == len(set(got))


def test_edges_of_clauses_take_one_join_and_no_sorted_aggregate(spark):
    where = "/root/testdata/sf0.001"
    for query in (network_queries.kb_argument_edges, network_queries.kb_annotation_edges, network_queries.kb_body_edges):
        said = plan(query(spark, where))
        assert said.count("Join") == 1 and "SortAggregate" not in said and "ObjectHashAggregate" not in said


def test_a_name_is_looked_up_in_its_sentence_then_in_its_document(spark):
    declared = [("d", 1, "entity", "x"), ("d", 1, "value", "x"), ("d", 2, "entity", "x"), ("d", 3, "value", "y"), ("d", 4, "event", "z"), ("d", None, "entity", "w"), ("d", 6, "entity", "w")]
    literals = [(d, s, s, k, [n, "label"], False) for d, s, k, n in declared] + [("d", s, s, "argument", ["e", "1", n], False) for s, n in [(1, "x"), (2, "x"), (3, "y"), (4, "z"), (6, "w"), (9, "y"), (None, "y"), (1, None)]]
    df = spark.createDataFrame(literals, "document string, sentence int, line int, predicate string, args array<string>, in_body boolean")
    for nodes in (clauses.declarations(df), clauses.declared(df)):
        got = sorted(((r.sentence, r.target, r.found) for r in clauses.argument_edges(df, nodes).collect()), key=str)
        assert got == sorted(
            [(1, "entity:d:x", "sentence"), (1, "value:d:x", "sentence"), (2, "entity:d:x", "document"), (3, "value:d:y", "sentence"), (4, "minted:d:z", "minted"), (6, "entity:d:w", "document"), (9, "value:d:y", "document"), (None, "value:d:y", "document"), (1, None, "minted")],
            key=str,
        )


def test_windows_of_bytes_are_hashed_as_arrays():
    raw = np.frombuffer("abracadabra abracadabra, größer".encode(), np.uint8)
    for k in (1, 2, 3, 7, 16, 24, len(raw)):
        h = text._window_hashes(raw, k)
        same = {}
        for i in range(len(raw) - k + 1):
            assert same.setdefault(raw[i : i + k].tobytes(), h[i]) == h[i]
        assert len(h) == len(raw) - k + 1 and len(set(same.values())) == len(same)


def test_passages_are_found_over_steps_and_in_odd_texts(spark):
    far = "x" * ((1 << 20) - 7) + "The needle, größer: here." + "y" * 50
    pages = spark.createDataFrame([(1, far), (2, ""), (3, None), (4, " .:; "), (5, "Größer"), (5, "gr"), (6, "the needle")], "p int, t string")
    wanted = spark.createDataFrame([(1, "needle, größer HERE"), (2, "größer"), (3, ""), (4, None), (5, "g"), (6, "the needle, gr")], "q int, s string")
    at = (1 << 20) - 7
    got = sorted((r.p, r.q, r.at) for r in text.located(pages, wanted, "t", "s", "p", "q").collect())
    assert got == [(1, 1, at + 3), (1, 2, at + 10), (1, 5, at + 10), (1, 6, at), (5, 2, 0), (5, 5, 0), (5, 5, 0)]
    assert text.located(pages, wanted.where("q = 3"), "t", "s", "p", "q").count() == 0
