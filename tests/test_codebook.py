"""Kinds of documents, classes of concepts, readings."""

import pytest
from pyspark.sql import functions as F

from ferrule.functions import readings as rd
from ferrule.operators import codebook


def test_document_kinds(spark):
    rows = [("r1", ["A", "Recommendation 12"], "ace", "d1"), ("r2", ["Implementation considerations", "x"], "ace", "d2"), ("r3", ["Recommendation"], "ace", "d3"), ("r4", ["Recommendation 1"], "pending", None), ("r5", ["other"], "ace", "d1")]
    df = spark.createDataFrame(rows, "region string, section array<string>, state string, detail string")
    assert {r.document: r.kind for r in codebook.document_kinds(df).collect()} == {"d1": "supporting", "d2": "implementation", "d3": "supporting"}
    assert {r.kind for r in codebook.document_kinds(df.where("region = 'r1'")).collect()} == {"recommendation"}


def test_a_codebook_must_fit(spark):
    concepts = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, label string")
    book = lambda *rows: spark.createDataFrame(list(rows), "id string, class string")
    assert sorted((r.id, r["class"]) for r in codebook.classified(concepts, book(("a", "x"), ("b", None)), ["x"]).collect()) == [("a", "x"), ("b", None)]
    for rows, said in (([("a", "x")], "without a class entry: 1 .b."), ([("a", "x"), ("b", "x"), ("c", "x"), ("d", None)], "naming no concept: 2 .c, d."), ([("a", "y"), ("b", None)], "not declared: 1 .a."), ([("a", "x"), ("a", None), ("b", None)], "several entries: 1 .a.")):
        with pytest.raises(ValueError, match=said):
            codebook.classified(concepts, book(*rows), ["x"])


def test_readings_for_people(spark):
    c = F.col
    df = spark.createDataFrame([("Every nurse that does use an opioid-taper-plan helps a patient", "every Nurse offers a co_use")], "a string, b string")
    assert df.select(rd.plain_words(c("a"), "nurse"), rd.plain_words(c("b"), "nurse")).first()[:] == ("Nurses who do use opioid taper plan helps a patient", "Nurses offers a co use")
    df = spark.createDataFrame([("d", 3, "ref(12)", "x"), ("d", 3, "none", "shown"), (None, 3, "ref(1)", "y")], "d string, s int, l string, t string")
    assert [r.v for r in df.select(rd.named_place(c("d"), c("s"), c("l"), c("t")).alias("v")).collect()] == ["d — sentence 3, ref 12", "shown", "y"]
    assert df.select(rd.node_label(F.lit("document"), F.lit("a-b")), rd.node_label(F.lit("entity"), F.lit("a-b__c"))).first()[:] == ("a-b", "a b c")
    items = spark.createDataFrame([(1, 0, 5), (1, 5, 0), (1, 5, 4), (1, 9, 3)], "g int, at int, n int").withColumn("low", F.lit(4)).withColumn("high", F.lit(6))
    assert [(r.at, r.place) for r in codebook.covering(items, ["g"], "at", "n", "low", "high").orderBy("at").collect()] == [(0, 1), (5, 2)]
