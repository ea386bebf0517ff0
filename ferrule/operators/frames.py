"""Frames of sentences: clauses that share a body up to renaming, the events, nouns and phrases they state, what these aim at and where they start.

clauses: (document, sentence, line, head, body), texts of terms. Literals have the form entity(context, referent, noun), property(context, referent, word),
event(context, referent, verb), arg(context, event, n, referent), pp(context, event, preposition, referent), operator(context, inner, op).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.functions import terms as te
from ferrule.operators import termtree as tt
from ferrule.operators.census import NON_CONCEPTS
from ferrule.sources.tables import staged

FRAME = ["document", "sentence", "variant"]


def framed(clauses: DataFrame) -> DataFrame:
    """(document, sentence, variant, line, head, body): clauses with variables renamed in the order of body and head, and the frame they belong to.

    Clauses of a sentence whose bodies are equal up to renaming are one frame; its variant is its number among the sentence's frames by first line.
    """
    # A sentence's clauses meet once: what follows goes by (document, sentence), or finer.
    rows = tt.renamed_clauses(clauses.select("document", "sentence", "line", "head", "body").dropna(subset=["document", "sentence", "body"])).repartition("document", "sentence")
    first = rows.withColumn("__first", F.min("line").over(Window.partitionBy("document", "sentence", "body")))
    variant = F.dense_rank().over(Window.partitionBy("document", "sentence").orderBy("__first", "body"))
    return first.withColumn("variant", variant).select(*FRAME, "line", "head", "body")


def literals(frames: DataFrame) -> DataFrame:
    """(document, sentence, variant, side, line, place, negated, name, arguments): the literals of frames, a body's once; those in a negated bracket are negated. place is where a literal stands in its text."""
    nth = F.row_number().over(Window.partitionBy(*FRAME).orderBy("line"))
    body = F.when((F.col("__nth") == 1) & (F.col("body") != ""), F.col("body"))
    sides = F.array(F.struct(F.lit("body").alias("side"), body.alias("text")), F.struct(F.lit("head").alias("side"), F.col("head").alias("text")))
    texts = frames.withColumn("__nth", nth).select(*FRAME, "line", F.explode(sides).alias("t")).select(F.struct(*FRAME, "t.side", "line").alias("term"), "t.text")
    return tt.literals(texts).select(*[f"term.{c}" for c in FRAME], "term.side", "term.line", "place", "negated", "name", "arguments")


def body_boxes(rows: DataFrame) -> DataFrame:
    """(frame, box, op): the operators that a body binds to its boxes, the last one of each."""
    found = rows.where("side = 'body' and name = 'operator'").where(_arg(0) == "actual")
    return found.groupBy(*FRAME, _arg(1).alias("box")).agg(F.max_by(_arg(2), "place").alias("op"))


def _arg(n: int) -> Column:
    return F.get("arguments", F.lit(n))


def _said(n: int) -> Column:
    return te.atom_text(_arg(n))


@dataclass(frozen=True)
class View:
    """nouns and properties: (frame, ref, word); events: (frame, ref, side, verb, context, negated, line, nth); arguments: (frame, event, n, ref); phrases: (frame, event, nth, prep, ref)."""

    nouns: DataFrame
    properties: DataFrame
    events: DataFrame
    arguments: DataFrame
    phrases: DataFrame


def viewed(rows: DataFrame) -> View:
    """The view of each frame's literals, bodies before heads, heads by line. A referent's last word counts, an event's last statement, an argument's last filling.

    A body's event stands under the operator of its box, if there is one; it is negated in a negated bracket or in a box of the operator -.
    """
    order = F.struct(F.when(F.col("side") == "body", 0).otherwise(1), "line", "place")
    rows = staged(rows.withColumn("nth", order), "frames-literals")
    word = lambda name: rows.where(F.col("name") == name).groupBy(*FRAME, _arg(1).alias("ref")).agg(F.max_by(_said(2), "nth").alias("word"))
    boxes = body_boxes(rows).select(*FRAME, F.col("box").alias("context"), "op")
    stated = rows.where("name = 'event'").select(*FRAME, _arg(1).alias("ref"), F.struct("side", _said(2).alias("verb"), _arg(0).alias("context"), "negated", "line").alias("e"), "nth")
    events = stated.groupBy(*FRAME, "ref").agg(F.max_by("e", "nth").alias("e"), F.min("nth").alias("nth")).select(*FRAME, "ref", "e.*", "nth").join(boxes, [*FRAME, "context"], "left")
    negated = F.col("negated") | F.coalesce((F.col("side") == "body") & (F.col("op") == "-"), F.lit(False))
    events = events.select(*FRAME, "ref", "side", "verb", "context", negated.alias("negated"), F.when(F.col("side") == "head", F.col("line")).alias("line"), "nth")
    known = events.select(*FRAME, F.col("ref").alias("event"))
    arguments = rows.where("name = 'arg'").groupBy(*FRAME, _arg(1).alias("event"), _arg(2).try_cast("int").alias("n")).agg(F.max_by(_arg(3), "nth").alias("ref")).join(known, [*FRAME, "event"], "left_semi")
    phrases = rows.where("name = 'pp'").select(*FRAME, _arg(1).alias("event"), "nth", _said(2).alias("prep"), _arg(3).alias("ref")).join(known, [*FRAME, "event"], "left_semi")
    return View(word("entity"), word("property"), events, arguments, phrases)


def concepts(nouns: DataFrame, word: str = "word") -> DataFrame:
    """nouns without those that never form a concept."""
    return nouns.where(~F.col(word).isin(*NON_CONCEPTS))


def targets(view: View, complements: DataFrame) -> DataFrame:
    """(frame, event, rule, ref, noun, property, prep): what each event aims at, where it aims at anything.

    T1: its second argument is a noun. T2: its second argument is a property and it has a phrase with `for`, the first to a noun. T3: it has no second argument and a phrase whose (verb, prep) is
    among complements; the first to a concept, or else the first to any noun. Rules are tried in this order.
    """
    second = view.arguments.where("n = 2").select(*FRAME, "event", F.col("ref").alias("second"))
    noun = view.nouns.select(*FRAME, F.col("ref").alias("second"), F.col("word").alias("noun"))
    prop = view.properties.select(*FRAME, F.col("ref").alias("second"), F.col("word").alias("property"))
    events = view.events.select(*FRAME, F.col("ref").alias("event"), "verb")
    named = view.phrases.join(view.nouns, [*FRAME, "ref"])
    first = lambda rows, *keys: rows.groupBy(*FRAME, "event").agg(F.min_by(F.struct("ref", "word", "prep"), F.struct(*keys, "nth")).alias("p"))
    purpose = first(named.where("prep = 'for'")).withColumnRenamed("p", "purpose")
    admitted = named.join(events, [*FRAME, "event"]).join(complements.select("verb", "prep").distinct(), ["verb", "prep"], "left_semi")
    complement = first(admitted, F.col("word").isin(*NON_CONCEPTS)).withColumnRenamed("p", "complement")
    rows = events.join(second, [*FRAME, "event"], "left").join(noun, [*FRAME, "second"], "left").join(prop, [*FRAME, "second"], "left").join(purpose, [*FRAME, "event"], "left").join(complement, [*FRAME, "event"], "left")
    has = F.col("second").isNotNull()
    rule = F.when(has & F.col("noun").isNotNull(), "T1").when(has & F.col("property").isNotNull() & F.col("purpose").isNotNull(), "T2").when(~has & F.col("complement").isNotNull(), "T3")
    pick = lambda t1, field: F.when(F.col("rule") == "T1", t1).when(F.col("rule") == "T2", F.col(f"purpose.{field}")).otherwise(F.col(f"complement.{field}"))
    found = rows.withColumn("rule", rule).where("rule is not null")
    return found.select(*FRAME, "event", "rule", pick(F.col("second"), "ref").alias("ref"), pick(F.col("noun"), "word").alias("noun"), F.when(F.col("rule") == "T2", F.col("property")).alias("property"), pick(F.lit(None).cast("string"), "prep").alias("prep"))


def starts(view: View, roles: list[str], verbs: list[str]) -> DataFrame:
    """(frame, place, concept): where a frame starts, each concept once.

    Second arguments of what the body states plainly in the actual world: first of events whose subject is one of roles, in order, then of events of the verbs.
    """
    named = view.arguments.where("n in (1, 2)").join(view.nouns, [*FRAME, "ref"])
    nouns = named.groupBy(*FRAME, "event").agg(*[F.max(F.when(F.col("n") == n, F.col("word"))).alias(name) for n, name in ((1, "subject"), (2, "concept"))])  # one word each
    plain = view.events.where("side = 'body' and context = 'actual' and not negated").select(*FRAME, F.col("ref").alias("event"), "verb", "nth")
    rows = plain.join(nouns.where("concept is not null"), [*FRAME, "event"]).where(~F.col("concept").isin(*NON_CONCEPTS))
    part = F.when(F.col("subject").isin(*roles), 1).when(F.col("verb").isin(*verbs), 2)
    first = rows.withColumn("part", part).where("part is not null").groupBy(*FRAME, "concept").agg(F.min(F.struct("part", "nth")).alias("at"))
    return first.select(*FRAME, F.row_number().over(Window.partitionBy(*FRAME).orderBy("at")).alias("place"), "concept")


def bucket(actor: Column, second: Column, shared: Column, sources: Column, target: Column) -> Column:
    """Where an occurrence goes: example, shared, line, loop or statement, in this order. sources is an array of nouns, target a noun or null."""
    example = F.coalesce(actor.endswith("-example") & second.endswith("-example"), F.lit(False))
    aims = F.coalesce(~target.isin(*NON_CONCEPTS), F.lit(False))
    return (
        F.when(example, "example").when(F.coalesce(shared, F.lit(False)), "shared").when(aims & F.exists(sources, lambda s: s != target), "line").when((F.size(sources) > 0) | aims, "loop").otherwise("statement")
    )


def reading(chain: Column, qualifiers: Column, form: Column, prop: Column, prep: Column) -> Column:
    """The words of a line: operators, outermost first (a negation in front is `it is false that`, one inside is `not`), qualifiers, the verb's form, property and preposition."""
    words = F.transform(chain, lambda op, k: F.when(op != "-", op).when(k == 0, "it is false that").otherwise("not"))
    return F.concat_ws(" ", F.array_join(F.array_compact(F.concat(words, qualifiers, F.array(form, prop, prep))), " "))


def stated_form(verb: Column, forms: Column, text: Column) -> Column:
    """The first of a verb's finite forms that stands in the text as a word of its own, null where none does."""
    return F.get(F.filter(forms, lambda f: F.regexp_like(text, F.concat(F.lit("(^|[^a-z-])"), f, F.lit("([^a-z-]|$)")))), F.lit(0))
