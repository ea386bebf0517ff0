"""Readers and sinks of provenance on small files, rules with variables, components with hubs, resolution of references."""

import hashlib
import io
import json
import random
import tarfile

import pytest
from ferrule.functions import arithmetic as ar
from ferrule.functions import readings as rd
from ferrule.functions import terms as te
from ferrule.operators import graph, resolve, windows
from ferrule.operators.rules import Literal, Rule, consequences
from ferrule.sources import provenance as pv
from pyspark.sql import functions as F


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_members_of_archives(spark, tmp_path):
    body = {"data/a.txt": b"one", "data/b.txt": b"two" * 1000}
    with tarfile.open(tmp_path / "bag.tar.gz", "w:gz") as tar:
        for name, content in body.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    got = pv.archive_members(spark, str(tmp_path))
    assert {r.member: bytes(r.content) for r in got.collect()} == body
    listed = [(hashlib.sha256(b"one").hexdigest(), "data/a.txt"), ("0", "data/b.txt"), ("0", "data/c.txt")]
    status = pv.verified_members(got, spark.createDataFrame(listed, "sha256 string, member string"))
    assert {r.member: r.status for r in status.collect()} == {"data/a.txt": "ok", "data/b.txt": "changed", "data/c.txt": "missing"}


def test_notes_and_labels(spark, tmp_path):
    notes = put(tmp_path, "n/notes.tsv", "# head\nd1\tr1\tkept\tdropped\nd2\tr2\tk\td\n")
    assert [tuple(r) for r in pv.projection_notes(spark, notes).orderBy("document").collect()] == [("d1", "r1", "kept", "dropped"), ("d2", "r2", "k", "d")]
    labels = put(tmp_path, "l/m.tsv", "version\t1\nlabel\td1\tapproved\nlabel\td2\tstale\n")
    assert {r.document: r.label for r in pv.release_labels(spark, labels).collect()} == {"d1": "approved", "d2": "stale"}
    for bad in ("label\td1\tgood\n", "label\td1\n", "label\td1\tstale\nlabel\td1\tstale\n"):
        with pytest.raises(Exception, match="label|repeated"):
            pv.release_labels(spark, put(tmp_path, f"bad{len(bad)}/m.tsv", bad)).collect()
    with pytest.raises(Exception, match="empty kept"):
        pv.projection_notes(spark, put(tmp_path, "bad/notes.tsv", "d1\tr1\t\tx\n")).collect()


def test_alignments(spark, tmp_path):
    texts = spark.createDataFrame([("d", "source", "A 💊 dose."), ("d", "ace", "give a dose")], "document string, side string, text string")
    good = "1\tsrc\t2\t💊 dose\n1\tace\t5\ta dose\n2\tsrc\t0\tA\n2\tace\t0\tgive\n"
    got = pv.alignments(spark, put(tmp_path, "a/d.tsv", good), texts).orderBy("grp", "side").collect()
    assert [(r.grp, r.side, r.start, r.end, r.text) for r in got] == [(1, "ace", 5, 11, "a dose"), (1, "source", 2, 8, "💊 dose"), (2, "ace", 0, 4, "give"), (2, "source", 0, 1, "A")]
    for bad, what in (("1\tsrc\t1\t💊\n1\tace\t0\tgive\n", "no such span"), ("1\tsrc\t0\tA\n", "one side"), ("1\tsrc\t0\tA 💊\n1\tace\t0\tgive\n2\tsrc\t2\t💊\n2\tace\t5\ta\n", "overlapping"), ("1\tx\t0\tA\n", "side of")):
        with pytest.raises(Exception, match=what):
            pv.alignments(spark, put(tmp_path, f"{abs(hash(bad))}/d.tsv", bad), texts).collect()


def test_extractions_and_vocabulary(spark, tmp_path):
    put(tmp_path, "x/a.txt", "head\nmore\n\n[r1 | p3 | First one]\nthe payload\n\n[r2 | p4 | Second]\nanother\nloose line\n")
    put(tmp_path, "x/b.txt", "head\n\n1. first\n2. second\n")
    got = sorted((r.path.split("/")[-1], r.ordinal, r.region, r.page, r.label, r.payload) for r in pv.extractions(spark, str(tmp_path / "x")).collect())
    assert got == [("a.txt", 1, "r1", 3, "First one", "the payload"), ("a.txt", 2, "r2", 4, "Second", "another"), ("b.txt", 1, None, None, None, "first"), ("b.txt", 2, None, None, None, "second")]
    words = pv.vocabulary(spark, put(tmp_path, "v/vocabulary.tsv", "qualifier\toften\t\nscope\tadult\tk1\nscope\tchild\nqualifier\t\n"))
    assert [r.word for r in pv.qualifiers(words).collect()] == ["often"] and [r.key for r in pv.scope_keys(words).collect()] == ["k1"]


def test_exported_queries_and_catalogue(spark, tmp_path):
    put(tmp_path, "q/one.pl", "% x\n'$guideline_query_projection'(goal((p(X),q(X,Y))),answers([answer(X,x),answer(Y,y)])).\n")
    put(tmp_path, "q/two.pl", "'$guideline_query_projection'(goal(r),answers([])).\n")
    got = {r.id: (r.goal, r.projected) for r in pv.exported_queries(spark, str(tmp_path / "q")).collect()}
    assert got == {"one": ("(p(X),q(X,Y))", ["X", "Y"]), "two": ("r", [])}
    entry = lambda k: {"id": k, "provenance": "exported", "goal": f"g({k})", "marksGoal": "m", "projection": ["X"]}
    path = put(tmp_path, "c/catalog.json", json.dumps({"catalogVersion": 4, "entries": [entry("a"), entry("b")]}))
    assert sorted(r.id for r in pv.question_catalog(spark, path, 4, ["a", "b"]).collect()) == ["a", "b"]
    for version, known in ((3, ["a", "b"]), (4, ["a"]), (4, ["a", "b", "c"])):
        with pytest.raises(Exception, match="catalogue"):
            pv.question_catalog(spark, path, version, known).collect()


def test_graphs_evidence_and_sinks(spark, tmp_path):
    node = lambda k: {"id": k, "kind": "entity", "label": k.upper(), "document": "d", "sentence": 1}
    edge = {"id": "e", "kind": "argument", "source": "a", "target": "b", "label": "argument 1", "document": "d", "sentence": 1, "line": 3, "predicate": "p", "scope": None, "inverse": None}
    path = put(tmp_path, "g/graph.json", json.dumps({"schemaVersion": 1, "nodes": [node("a"), node("b")], "edges": [edge], "scopes": []}, indent=2))
    nodes, edges, scopes = pv.graph_tables(spark, path)
    assert sorted(r.id for r in nodes.collect()) == ["a", "b"] and edges.first().line == 3 and scopes.count() == 0
    for k in ("d2", "d1"):
        put(tmp_path, f"e/{k}.json", json.dumps({"id": k, "label": k.upper(), "region": {"id": "r", "page": 2, "section": "s"}, "clauses": [{"line": 1, "text": "p(a)."}]}))
    index = pv.corpus_index(pv.evidence(spark, str(tmp_path / "e")))
    assert [(r.id, r.label, r.region, r.page) for r in index.collect()] == [("d1", "D1", "r", 2), ("d2", "D2", "r", 2)]
    out = f"file://{tmp_path}/out"
    written = pv.write_json(index.coalesce(1), out)
    listed = spark.createDataFrame(written.collect(), written.schema)
    assert listed.count() == 1 and {r.intact for r in pv.intact(spark, listed, out).collect()} == {True}
    assert {r.intact for r in pv.intact(spark, listed.withColumn("sha256", F.lit("0")), out).collect()} == {False}
    with pytest.raises(Exception, match="exists|already"):
        pv.write_json(index, out)


def test_documents_with_all_that_belongs_to_them(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "document string, x int")
    clauses = spark.createDataFrame([("a", 2, "q"), ("a", 1, "p")], "document string, line int, text string")
    notes, labels = spark.createDataFrame([("b", "k", "d")], "document string, kept string, dropped string"), spark.createDataFrame([("a", "stale")], "document string, label string")
    got = {r.document: ([tuple(c) for c in r.clauses] if r.clauses else None, r.projection and tuple(r.projection), r.label) for r in pv.assembled(docs, clauses, notes, labels).collect()}
    assert got == {"a": ([(1, "p"), (2, "q")], None, "stale"), "b": (None, ("k", "d"), None)}
    with pytest.raises(ValueError, match="labels of no document: z"):
        pv.assembled(docs, clauses, notes, spark.createDataFrame([("z", "stale")], "document string, label string"))


def test_rules_reach_a_fixpoint(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(35)} | {(k, k + 1) for k in range(100, 112)}
    closure = set(edges)
    while more := {(a, d) for a, b in closure for c, d in edges if b == c} - closure:
        closure |= more
    rules = [Rule(Literal("path", ("X", "Y")), (Literal("edge", ("X", "Y")),)), Rule(Literal("path", ("X", "Z")), (Literal("path", ("X", "Y")), Literal("edge", ("Y", "Z"))))]
    facts = {"edge": spark.createDataFrame(list(edges), "a0 long, a1 long"), "blocked": spark.createDataFrame([(101,)], "a0 long")}
    got = consequences(facts, rules)["path"].collect()
    assert {(r.a0, r.a1) for r in got} == closure and len(got) == len(closure) and max(r.round for r in got) >= 12
    loops = [*rules, Rule(Literal("loop", ("X",)), (Literal("path", ("X", "X")),)), Rule(Literal("free", ("X",)), (Literal("edge", ("X", "_")),), unless=(Literal("blocked", ("X",)),))]
    out = consequences(facts, loops)
    assert {r.a0 for r in out["loop"].collect()} == {a for a, b in closure if a == b} and {r.a0 for r in out["free"].collect()} == {a for a, _ in edges} - {101}
    twice = Rule(Literal("acyclic", ("X",)), (Literal("edge", ("X", "_")),), unless=(Literal("path", ("X", "X")),))
    far = Rule(Literal("rest", ("X",)), (Literal("path", ("X", "_")),), unless=(Literal("acyclic", ("X",)), Literal("never", ("X",))))
    never = Rule(Literal("never", ("X",)), (Literal("edge", ("X", "Y")), Literal("edge", ("Y", -1))))
    out = consequences(facts, [far, twice, *rules, never])
    starts = {a for a, _ in edges}
    acyclic = {a for a in starts if (a, a) not in closure}
    assert {r.a0 for r in out["acyclic"].collect()} == acyclic and {r.a0 for r in out["rest"].collect()} == starts - acyclic and "never" not in out
    edge = lambda *a: Literal("edge", a)
    with pytest.raises(ValueError, match="q negates p, which depends on q"):
        consequences(facts, [Rule(Literal("q", ("X",)), (edge("X", "_"),), unless=(Literal("p", ("X",)),)), Rule(Literal("p", ("X",)), (Literal("q", ("X",)),))])
    for bad, said in ((Rule(Literal("q", ("X",)), (Literal("egde", ("X", "_")),)), "unknown predicate: egde"), (Rule(Literal("q", ("X",)), (Literal("edge", ("X",)),)), "edge has 2 arguments"), (Rule(Literal("q", ("Z",)), (edge("X", "_"),)), "binds .'Z'.")):
        with pytest.raises(ValueError, match=said):
            consequences(facts, [*rules, bad])


@pytest.mark.parametrize("heavy", [1, 5, 1000])
def test_components_with_hubs_and_texts(spark, heavy):
    rng = random.Random(heavy)
    pairs = [("hub", f"n{k:03}") for k in range(40)] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(30)] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    root = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "source string, target string"), heavy=heavy).collect()}
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_numbering_and_resolution(spark):
    rows = spark.createDataFrame([(k * 7 % 50, f"x{k}") for k in range(50)], "v int, t string")
    assert all(r.place == r.v + 1 for r in windows.numbered(rows, F.col("v"), "place").collect())
    refs = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "a")], "document int, sentence int, name string")
    local = spark.createDataFrame([(1, 1, "a", "near")], "document int, sentence int, name string, node string")
    wide = spark.createDataFrame([(1, "a", "wide")], "document int, name string, node string")
    got = sorted((r.document, r.sentence, r.node, r.found) for r in resolve.by_scope(refs, local, wide, "new:").collect())
    assert got == [(1, 1, "near", "sentence"), (1, 2, "wide", "document"), (2, 1, "new:2:a", "minted")]


def test_terms_and_readings(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    text = F.lit("p(X,'It''s X',Y,\"Z\",X,_,_)")
    assert one(te.variables(text)) == ["X", "Y"] and one(te.copied(text, F.lit("7"))) == "p(_G7_0,'It''s X',_G7_1,\"Z\",_G7_0,_,_)"
    assert one(te.canonical_clause(F.lit("h(B,A)"), F.lit("b(A),c(B,C)"))) == one(te.canonical_clause(F.lit("h(Q,P)"), F.lit("b(P),c(Q,R)"))) == "h(V1,V0) :- b(V0),c(V1,V2)"
    assert one(te.same_term(F.lit("f(a)"), F.lit("f(a)"))) and not one(te.same_term(F.lit("f(X)"), F.lit("f(X)"))) and one(te.is_ground(F.lit("f('X')")))
    assert one(te.from_univ(te.univ(F.lit("a"), F.array().cast("array<string>")))) == "a" and one(te.chain(F.array().cast("array<string>"))) == "[]"
    assert [one(ar.toward_zero(F.lit(x))) for x in (-2.7, 2.7)] == [-2, 2] and [one(ar.to_integer(F.lit(x))) for x in (-2.5, 2.5)] == [-3, 3]
    assert one(ar.added(F.lit(1), F.lit(2), F.lit(4))) is None and one(ar.between(F.lit(3).cast("long"), F.lit(1).cast("long"))) == []
    assert one(rd.context_term(rd.real_day(F.lit("2022-12-29")))) == "date(20221229)" and one(rd.context_term(F.lit(None).cast("string"))) == "none"
    for bad in ("2022-02-30", "2022-1-1", "x"):
        with pytest.raises(Exception, match="not a real day"):
            one(rd.real_day(F.lit(bad)))
    assert one(rd.is_safe(F.lit("a\tb\n"))) and not one(rd.is_safe(F.lit("a‮b"))) and not one(rd.is_safe(F.lit("a\x01")))
