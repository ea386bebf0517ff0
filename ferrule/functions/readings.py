"""Readings of annotations: orders, offsets, anchored intervals, grades, qualifiers, preferences, run contexts, unsafe text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed readings of an annotation from its own end and from the other one.
ORDER = {"before": ("occurs before", "occurs after"), "after": ("occurs after", "occurs before")}
OFFSET = {
    "duration": ("duration", "duration of"),
    "after": ("after offset", "after offset for"),
    "before": ("before offset", "before offset for"),
    "within": ("distance", "distance for"),
}
ANCHORED = {"after": ("after", "before"), "before": ("before", "after"), "within": ("apart from", "apart from")}
#: Code points that no text may hold: controls but for tab, newline and return, and those that turn its direction.
UNSAFE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{202a}-\x{202e}\x{2066}-\x{2069}]"


def both_ends(key: Column, readings: dict[str, tuple[str, str]]) -> Column:
    """struct(near, far) of a reading, null where there is none."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("near"), F.lit("").alias("far")))
    for k, (near, far) in readings.items():
        out = out.when(key == k, F.struct(F.lit(near).alias("near"), F.lit(far).alias("far")))
    return out


def anchored(role: Column, bound: Column) -> Column:
    """struct(near, far) of an interval with an anchor: the bound before its words from either end."""
    found = both_ends(role, ANCHORED)
    near, far = (F.concat(bound, F.lit(" "), found[k]).alias(k) for k in ("near", "far"))
    return F.when(found.isNotNull(), F.struct(near, far))


def words(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def grade_reading(grades: Column, dimensions: tuple[str, ...]) -> Column:
    """Labels of (dimension, label) structs, those of the first dimension first whatever the order given, each once."""

    def of(dimension: str) -> Column:
        return F.transform(F.filter(grades, lambda g: g["dimension"] == dimension), lambda g: capital(words(g["label"])))

    listed = [of(d) for d in dimensions]
    return F.array_join(F.array_distinct(F.flatten(F.array(*listed))), ", ")


def qualifier_reading(names: Column) -> Column:
    return F.array_join(F.array_distinct(F.transform(names, words)), ", ")


def preference_reading(preferred: Column, alternative: Column) -> Column:
    return F.when(alternative.isNull(), words(preferred)).otherwise(F.concat(words(preferred), F.lit(" over "), words(alternative)))


def is_safe(text: Column) -> Column:
    return ~text.rlike(UNSAFE)


def positive_integers(values: Column) -> Column:
    """Those above 0, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x > 0)))


def real_day(text: Column) -> Column:
    """text where it is a day of the calendar written YYYY-MM-DD, else an error; null stays null, a run without a date."""
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull()
    return F.when(text.isNull() | good, text).otherwise(F.raise_error(F.concat(F.lit("not a real day: "), text)))


def context_term(day: Column) -> Column:
    """none, or date(YYYYMMDD)."""
    return F.when(day.isNull(), "none").otherwise(F.concat(F.lit("date("), F.replace(day, F.lit("-"), F.lit("")).cast("int").cast("string"), F.lit(")")))


def plain_words(text: Column, actor: str) -> Column:
    """Controlled wording for a reader: no article before a hyphenated noun, `every <actor>` as a plural, `that does` after it as `who do`, _ and - as spaces."""
    plural = actor[:1].upper() + actor[1:] + "s"
    out = F.regexp_replace(text, r"\b(?:a|an) ([A-Za-z0-9]+(?:-[A-Za-z0-9]+)+)\b", "$1")
    out = F.regexp_replace(out, rf"(?i)\bevery {actor} that does\b", f"{plural} who do")
    return F.regexp_replace(F.regexp_replace(out, rf"(?i)\bevery {actor}\b", plural), "[_-]+", " ")


def named_place(document: Column, sentence: Column, locator: Column, display: Column) -> Column:
    """'document — sentence n, ref k' where all three are known, else the text as displayed. locator is ref(k)."""
    k = F.nullif(F.regexp_extract(locator, r"^ref\(([0-9]+)\)$", 1), F.lit(""))
    return F.coalesce(F.concat(document, F.lit(" — sentence "), sentence.cast("string"), F.lit(", ref "), k), display)


def node_label(kind: Column, label: Column) -> Column:
    """A node's label for a reader: a document's as it is, others with _ and - as spaces."""
    return F.when(kind == "document", label).otherwise(F.regexp_replace(label, "[_-]+", " "))
