"""Frames, views, targets and starts against a walk over each frame's literals."""

import random

from ferrule.operators import frames as fr
from pyspark.sql import functions as F

NOUNS = ["patient", "drug", "opioid", "clinician", "plan", "risk"]
VERBS = ["take", "use", "offer", "talk"]
PREPS = ["for", "with", "of"]


def made(r):
    """(head literals, body items) of a random clause; a body item is (negated, literals)."""
    refs = [f"R{k}" for k in range(5)]

    def literal(n, side):
        kind = r.choice(["entity", "event", "arg", "arg", "pp", "pp", "pp", "property", "property", "operator"])
        context = r.choice(["actual", "actual", "actual", "B1"])
        x, y = r.choice(refs), r.choice(refs)
        return {
            "entity": ("entity", [context, x, r.choice(NOUNS)]), "event": ("event", [context, x, r.choice(VERBS)]), "arg": ("arg", [context, x, str(r.choice([1, 2, 2, 3])), y]), "pp": ("pp", [context, x, r.choice(PREPS), y]),
            "property": ("property", [context, x, r.choice(["dose", "use"])]), "operator": ("operator", ["actual", "B1", r.choice(["-", "may"])]),
        }[kind]

    body = []
    for _ in range(r.randrange(6, 18)):
        if r.random() < 0.15:
            body.append((True, [literal(0, "body") for _ in range(r.randrange(1, 3))]))
        else:
            body.append((False, [literal(0, "body")]))
    return literal(0, "head"), body


def text(lit):
    return f"{lit[0]}({', '.join(lit[1])})"


def walk(rows):
    """View of (side, line, negated, literal) rows in order."""
    nouns, props, events, boxes = {}, {}, {}, {}
    for side, _, _, (name, a) in rows:
        if side == "body" and name == "operator" and a[0] == "actual":
            boxes[a[1]] = a[2]
    for side, line, naf, (name, a) in rows:
        if name == "entity":
            nouns[a[1]] = a[2]
        elif name == "property":
            props[a[1]] = a[2]
        elif name == "event":
            at = list(events).index(a[1]) if a[1] in events else None
            events[a[1]] = {"side": side, "verb": a[2], "context": a[0], "negated": naf or side == "body" and boxes.get(a[0]) == "-", "args": {}, "pps": []}
            assert at is None or list(events).index(a[1]) == at
    for _, _, _, (name, a) in rows:
        if name == "arg" and a[1] in events:
            events[a[1]]["args"][int(a[2])] = a[3]
        if name == "pp" and a[1] in events:
            events[a[1]]["pps"].append((a[2], a[3]))
    return nouns, props, events


def test_frames_and_what_they_say(spark):
    r = random.Random(6)
    clauses, want_t, want_s = [], set(), set()
    complements = {("talk", "with"), ("offer", "of"), ("use", "of"), ("take", "with")}
    for sentence in range(50):
        heads, rows, body = [], [], made(r)[1]
        if sentence < 2:  # a property with a phrase, and a phrase to a concept after one to none
            said = [("event", ["actual", "R0", "use"]), ("pp", ["actual", "R0", "of", "R3"]), ("pp", ["actual", "R0", "for", "R2"]), ("pp", ["actual", "R0", "of", "R2"]), ("entity", ["actual", "R2", "opioid"]), ("entity", ["actual", "R3", "patient"])]
            body = [(False, [x]) for x in said + [("arg", ["actual", "R0", "2", "R1"]), ("property", ["actual", "R1", "dose"])] * (sentence == 0)]
        elif sentence < 4:  # starts: the drug of a plain event, first by the verb and then by its subject
            said = [("entity", ["actual", "R2", "drug"]), ("entity", ["actual", "R3", "patient"]), ("entity", ["actual", "R4", "plan"]), ("event", ["actual", "R0", "take"]), ("arg", ["actual", "R0", "2", "R4"]), ("event", ["actual", "R1", "use"]), ("arg", ["actual", "R1", "1", "R3"]), ("arg", ["actual", "R1", "2", "R2"])]
            body = [(sentence == 3 and x[0] == "event" and x[1][1] == "R1", [x]) for x in said]
        for naf, lits in body:
            rows += [("body", 0, naf, x) for x in lits]
        said = ", ".join(("\\+ " if naf else "") + (f"({', '.join(map(text, lits))})" if len(lits) > 1 else text(lits[0])) for naf, lits in body)
        for k in range(r.randrange(1, 4)):
            head = made(r)[0]
            heads.append(head)
            rows.append(("head", k + 1, False, head))
            renamed = {f"R{j}": f"Q{k}_{j}" for j in range(5)} | {"B1": f"Box{k}"}
            swap = lambda s, m=renamed: "".join(m.get(w, w) for w in __import__("re").split(r"(\b)", s))
            clauses.append(("d", sentence, k + 1, swap(text(head)), swap(said)))
        nouns, props, events = walk(rows)
        for ref, e in events.items():
            second = e["args"].get(2)
            hit = None
            if second is not None:
                if second in nouns:
                    hit = ("T1", nouns[second], None, None)
                elif second in props and (p := next((o for x, o in e["pps"] if x == "for" and o in nouns), None)):
                    hit = ("T2", nouns[p], props[second], "for")
            else:
                good = [(x, o) for x, o in e["pps"] if (e["verb"], x) in complements and o in nouns]
                p = next((q for q in good if nouns[q[1]] not in fr.NON_CONCEPTS), good[0] if good else None)
                hit = p and ("T3", nouns[p[1]], None, p[0])
            if hit:
                want_t.add((sentence, e["side"], e["verb"], *hit))
        plain = [e for e in events.values() if e["side"] == "body" and e["context"] == "actual" and not e["negated"]]
        ordered = [e for e in plain if nouns.get(e["args"].get(1)) in ("patient",)] + [e for e in plain if e["verb"] == "take"]
        seen = []
        for e in ordered:
            c = nouns.get(e["args"].get(2))
            if c is not None and c not in fr.NON_CONCEPTS and c not in seen:
                seen.append(c)
        want_s |= {(sentence, k + 1, c) for k, c in enumerate(seen)}
    df = spark.createDataFrame(clauses, "document string, sentence int, line int, head string, body string")
    frames = fr.framed(df)
    assert {(x.sentence, x.variant) for x in frames.collect()} == {(s, 1) for s in range(50)}
    view = fr.viewed(fr.literals(frames))
    got = fr.targets(view, spark.createDataFrame(sorted(complements), "verb string, prep string")).join(view.events.withColumnRenamed("ref", "event"), [*fr.FRAME, "event"])
    assert {(x.sentence, x.side, x.verb, x.rule, x.noun, x.property, x.prep) for x in got.collect()} == want_t and {w[3] for w in want_t} == {"T1", "T2", "T3"}
    assert {(x.sentence, x.place, x.concept) for x in fr.starts(view, ["patient"], ["take"]).collect()} == want_s and want_s


def test_frames_part_by_body_and_readings(spark):
    clauses = [("d", 1, 1, "event(actual,X,do)", "entity(actual,X,drug)"), ("d", 1, 2, "arg(actual,Y,1,Z)", "entity(actual,Y,drug)"), ("d", 1, 3, "event(actual,Y,do)", "entity(actual,Y,opioid)"), ("d", 2, 4, "event(actual,a,do)", "")]
    got = sorted((x.sentence, x.variant, x.line, x.head, x.body) for x in fr.framed(spark.createDataFrame(clauses, "document string, sentence int, line int, head string, body string")).collect())
    assert got == [(1, 1, 1, "event(actual,V0,do)", "entity(actual,V0,drug)"), (1, 1, 2, "arg(actual,V0,1,V1)", "entity(actual,V0,drug)"), (1, 2, 3, "event(actual,V0,do)", "entity(actual,V0,opioid)"), (2, 1, 4, "event(actual,a,do)", "")]
    rows = spark.createDataFrame(
        [("a-example", "b-example", False, ["x"], "y"), ("a", None, True, ["x"], "y"), ("a", None, False, ["x", "y"], "y"), ("a", None, False, ["y"], "y"), ("a", None, None, [], "y"), ("a", "b", False, ["x"], None), ("a", "b", False, [], "risk"), (None, None, False, [], None)],
        "actor string, second string, shared boolean, sources array<string>, target string",
    )
    c = F.col
    assert [x.b for x in rows.select(fr.bucket(c("actor"), c("second"), c("shared"), c("sources"), c("target")).alias("b")).collect()] == ["example", "shared", "line", "loop", "loop", "loop", "statement", "statement"]
    said = spark.createDataFrame([(["-", "should", "-"], ["often"], "takes", None, "with", "she takes it"), ([], [], "have", "dose", None, "x")], "chain array<string>, q array<string>, form string, prop string, prep string, text string")
    assert [x.r for x in said.select(fr.reading(c("chain"), c("q"), c("form"), c("prop"), c("prep")).alias("r")).collect()] == ["it is false that should not often takes with", "have dose"]
    assert [x.r for x in said.select(fr.stated_form(c("form"), F.array(F.lit("take"), c("form")), c("text")).alias("r")).collect()] == ["takes", None]
