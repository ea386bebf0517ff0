"""Parents, ancestors, embedding and owned heads of many graphs in one run, against walks of each graph by itself."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.operators import forest, graph


def climb(up, x):
    seen, at = [x], x
    while up.get(at) is not None:
        at = up[at]
        if at in seen:
            return None
        seen.append(at)
    return seen


def test_roots_and_ancestors_equal_walks(spark, monkeypatch):
    r = random.Random(3)
    groups = {g: {k: (None if r.random() < 0.2 else r.randrange(12)) for k in range(12)} for g in range(25)}
    rows = [(g, k, p) for g, up in groups.items() for k, p in up.items()] + [(100, k, k + 1 if k < 1000 else None) for k in range(1, 1001)] + [(101, 1, 77)]
    df = spark.createDataFrame(rows, "g int, id int, parent int")
    want = {}
    for g, k, _ in rows:
        path = climb(groups[g], k) if g < 100 else [*range(k, 1001)] if g == 100 else [1, 77]
        want[g, k] = (None, None) if path is None else (path[-1], len(path) - 1)
    rounds, plain = [], forest.staged_and_seen
    monkeypatch.setattr(forest, "staged_and_seen", lambda df, label, **m: rounds.append(label) or plain(df, label, **m))
    got = {(x.g, x.id): (x.root, x.depth) for x in forest.roots(df.where("g >= 100"), ["g"]).collect()}
    assert got == {k: v for k, v in want.items() if k[0] >= 100} and rounds.count("forest-roots") <= 11
    assert {(x.g, x.id): (x.root, x.depth) for x in forest.roots(df, ["g"]).collect()} == want
    good = [g for g in groups if all(want[g, k][1] is not None for k in range(12))]
    trees = df.where(F.col("g").isin(*good, 101))
    up = {(x.g, x.id, x.ancestor, x.distance) for x in forest.ancestors(trees, ["g"]).collect()}
    assert up == {(g, k, a, d) for g in good for k in range(12) for d, a in enumerate(climb(groups[g], k)) if d} | {(101, 1, 77, 1)}
    with pytest.raises(ValueError, match="cycle"):
        forest.ancestors(df, ["g"])
    assert forest.ancestors(df.limit(0), ["g"]).collect() == []
    long = graph.scope_chains(df.where("g = 100 and id > 980").select("id", "parent", F.col("id").cast("string").alias("operator")))
    assert {(x.id, x.depth, x.chain[-1]) for x in long.collect()} == {(k, 1001 - k, "1000") for k in range(981, 1001)}


def parents_of(events, outer):
    def above(c):
        out = []
        while c in outer:
            c = outer[c]
            out.append(c)
        return out

    parent = {}
    for e in events:
        for p in events:
            if p is e or e["subject"] is None or p["subject"] == e["subject"]:
                continue
            same = p["context"] == e["context"] and e["subject"] in p["objects"]
            if same or p["context"] in above(e["context"]) and ({e["subject"], *e["objects"], *e["others"]} & set(p["objects"])):
                parent[e["event"]] = p["event"]
                break
    if any(climb(parent, x) is None for x in parent):
        return None
    return parent


def owned_by(event, parents, events, heads):
    main = {e for e in events if e not in parents}
    have = {event}
    while more := {c for c, p in parents.items() if p in have} - have:
        have |= more
    out = set()
    while True:
        ranged = {h["quantity"] for h in heads if h["ordinal"] in out and h["name"] == "interval"}
        new = {h["ordinal"] for h in heads if h["ordinal"] not in out and (h["low"] in have or h["name"] == "range" and h["low"] in ranged)}
        if not new:
            return out
        out |= new
        have |= {x for h in heads if h["ordinal"] in new for x in h["refs"] if x == event or x not in main}


def test_embedding_and_owned_heads_equal_walks(spark):
    r = random.Random(11)
    all_events, all_contexts, all_heads, want, own = [], [], [], set(), set()
    for g in range(60):
        n = r.randrange(1, 7)
        outer = {f"c{k}": r.choice(["actual", *[f"c{j}" for j in range(k)]]) for k in range(3)}
        things = [f"x{k}" for k in range(3)]
        events = [
            {"event": f"e{k}", "context": r.choice(["actual"] * 5 + list(outer)), "subject": r.choice([None, *things, *things]), "objects": [r.choice([*things, *things, *[f"e{j}" for j in range(n)]]) for _ in range(r.randrange(5))], "others": [r.choice(things) for _ in range(r.randrange(2))]}
            for k in range(n)
        ]
        found = parents_of(events, outer)
        want |= {(g, e["event"], None if found is None else found.get(e["event"]), found is None) for e in events}
        heads = []
        for k in range(12):
            name = r.choice(["entity", "property", "interval", "range"])
            refs = [r.choice([*things, *[e["event"] for e in events]]) for _ in range(r.randrange(3))]
            heads.append({"ordinal": k, "name": name, "low": r.choice([*things, *[e["event"] for e in events], "q1", "q2"]), "refs": refs, "quantity": r.choice(["q1", "q2"])})
        if found is not None:
            own |= {(g, e["event"], h) for e in events if e["event"] not in found for h in owned_by(e["event"], found, [e["event"] for e in events], heads)}
            all_heads += [(g, h["ordinal"], h["name"], h["low"], h["refs"], h["quantity"]) for h in heads]
        all_events += [(g, e["event"], k, e["context"], e["subject"], e["objects"], e["others"]) for k, e in enumerate(events)]
        all_contexts += [(g, c, o) for c, o in outer.items()]
    events = spark.createDataFrame(all_events, "g int, event string, ordinal int, context string, subject string, objects array<string>, others array<string>")
    contexts = spark.createDataFrame(all_contexts, "g int, context string, outer string")
    got = forest.embedded(events, contexts, ["g"])
    found = {(x.g, x.event, x.parent, x.circular) for x in got.collect()}
    assert sorted(found - want, key=repr)[:6] == sorted(want - found, key=repr)[:6] and len({w[3] for w in want}) == 2
    heads = spark.createDataFrame(all_heads, "g int, ordinal int, name string, low string, refs array<string>, quantity string").withColumn("ranged", F.col("name") == "range")
    mine = forest.owned(heads, got.where("not circular").select("g", "event", "parent"), ["g"], F.when(F.col("name") == "interval", F.col("quantity")))
    assert {tuple(x) for x in mine.collect()} == own


@pytest.mark.parametrize("small", [2, 10_000])
def test_small_groups_are_settled_in_one_step_and_large_ones_by_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(forest, "SMALL", small)
    rounds, plain = [], forest.staged_and_seen
    monkeypatch.setattr(forest, "staged_and_seen", lambda df, label, **m: rounds.append(label) or plain(df, label, **m))
    rows = [(1, "a", None), (1, "b", "a"), (1, "c", "b"), (2, "a", "b"), (2, "b", "a"), (2, "c", "a"), (3, "a", "z"), (4, "a", "a"), (None, "a", None), (None, "b", "a"), (None, "c", "a")]
    got = {tuple(x) for x in forest.roots(spark.createDataFrame(rows, "g int, id string, parent string"), ["g"]).collect()} - {(None, "a", "a", 0), (None, "b", "a", 1), (None, "c", "a", 1), (None, "b", "a", None)}
    assert {x for x in got if x[0]} == {(1, "a", "a", 0), (1, "b", "a", 1), (1, "c", "a", 2), (2, "a", None, None), (2, "b", None, None), (2, "c", None, None), (3, "a", "z", 1), (4, "a", None, None)}
    assert ("forest-roots" in rounds) == (small == 2)
    heads = [(g, n, low, refs) for g in (1, 2) for n, low, refs in [(1, "e1", ["x", "e2"]), (2, "x", ["y"]), (3, "y", ["x"]), (4, "e2", []), (5, "e3", ["y"]), (6, "q", [])]][: 9 if small == 2 else 12]
    events = [(g, e, p) for g in (1, 2) for e, p in [("e1", None), ("e2", None), ("e3", "e2")]]
    mine = forest.owned(spark.createDataFrame(heads, "g int, ordinal int, low string, refs array<string>"), spark.createDataFrame(events, "g int, event string, parent string"), ["g"])
    assert {tuple(x)[1:] for x in mine.where("g = 1").collect()} == {("e1", 1), ("e1", 2), ("e1", 3), ("e2", 4), ("e2", 5), ("e2", 3), ("e2", 2)}
