"""Pairs of neighbouring rows and guards of bodies, against a walk from the left."""

import random

from ferrule.operators import patterns
from ferrule.operators import termtree as tt
from pyspark.sql import functions as F


def test_overlapping_pairs_are_taken_from_the_left(spark):
    r = random.Random(2)
    rows = [(g, k * 3, r.choice("aab")) for g in range(30) for k in range(r.randrange(0, 12))]
    want = {}
    for g in range(30):
        seq = [(k, v) for a, k, v in rows if a == g]
        i = 0
        while i < len(seq):
            if i + 1 < len(seq) and seq[i][1] == seq[i + 1][1]:
                want[g, seq[i][0]], want[g, seq[i + 1][0]] = 1, 2
                i += 2
            else:
                want[g, seq[i][0]] = None
                i += 1
    df = spark.createDataFrame(rows, "g int, k int, v string")
    got = patterns.paired(df, ["g"], "k", lambda n: n["v"] == F.col("v"))
    assert {(x.g, x.k): x.half for x in got.collect()} == want


def test_guards_are_set_aside(spark):
    bodies = [
        (1, "a(X), \\+ exclusion(k1), b(X), evaluation_date(D), satisfies(exactly, D, less, 20240101)"), (2, "evaluation_date(D), a(D), satisfies(exactly,D,less,1)"),
        (3, "evaluation_date(D), satisfies(exactly,E,less,1), \\+ (exclusion('k 2'))"), (4, "evaluation_date(D), evaluation_date(E), satisfies(exactly,E,less,2), \\+ (exclusion(k), a(X)), \\+ a(X)"), (5, "exclusion(k), x"),
    ]
    got = patterns.guard_split(tt.nodes(spark.createDataFrame(bodies, "term int, text string")), "exclusion", "evaluation_date", "satisfies")
    assert sorted((x.term, x.place, x.part, x.text) for x in got.collect()) == [
        (1, 1, "rest", "a(X)"), (1, 2, "scope", "k1"), (1, 3, "rest", "b(X)"), (1, 4, "supersession", "20240101"), (2, 1, "rest", "evaluation_date(D)"), (2, 2, "rest", "a(D)"), (2, 3, "rest", "satisfies(exactly,D,less,1)"),
        (3, 1, "rest", "evaluation_date(D)"), (3, 2, "rest", "satisfies(exactly,E,less,1)"), (3, 3, "scope", "'k 2'"), (4, 1, "rest", "evaluation_date(D)"), (4, 2, "supersession", "2"), (4, 4, "rest", "\\+ (exclusion(k), a(X))"),
        (4, 5, "rest", "\\+ a(X)"), (5, 1, "rest", "exclusion(k)"), (5, 2, "rest", "x"),
    ]
