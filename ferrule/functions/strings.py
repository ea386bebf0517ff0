"""String builtins as Spark expressions: offsets, splitting, words, phrases, readable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(text: Column, part: Column) -> Column:
    """All 0-based offsets at which part stands in text, overlapping ones included."""
    last = F.length(text) - F.length(part)
    every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.substr(text, i + 1, F.length(part)) == part)


def split_and_strip(text: Column, separators: str, pad: str) -> Column:
    """Split at every one of the separator characters and strip pad characters from the pieces."""
    cls = "[" + "".join("\\" + c for c in separators) + "]"
    return F.transform(F.split(text, cls, -1), lambda x: F.btrim(x, F.lit(pad)))


def code_points(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def ascii_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+", -1), lambda w: w != "")


def singular(word: Column) -> Column:
    """A plain singular: -ies to -y, -sses and -xes without -es, another -s dropped from words of more than three letters but -ss and -us."""
    n = F.length(word)
    cut = lambda k: F.substr(word, F.lit(1), n - k)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & (word.endswith("sses") | word.endswith("xes")), cut(2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us"), cut(1))
        .otherwise(word)
    )


def phrase_in(hay: Column, needle: Column) -> Column:
    """Whether the word array needle stands in the word array hay as neighbours."""
    n = F.size(needle)
    at = F.when(F.size(hay) >= n, F.sequence(F.lit(1), F.size(hay) - n + 1)).otherwise(F.array().cast("array<int>"))
    return (n > 0) & F.exists(at, lambda i: F.slice(hay, i, n) == needle)


def coordinated(items: Column, word: str = "and") -> Column:
    """'', 'a', 'a and b', 'a, b, and c'."""
    n = F.size(items)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(items, F.lit(0)))
        .when(n == 2, F.array_join(items, f" {word} "))
        .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(f", {word} "), F.get(items, n - 1)))
    )


def finite(verb: Column) -> Column:
    """Third person of a verb."""
    return (
        F.when(verb == "be", "is").when(verb == "have", "has")
        .when(verb.rlike("(s|x|z|ch|sh|o)$"), F.concat(verb, F.lit("es")))
        .when(verb.rlike("[^aeiou]y$"), F.concat(F.substr(verb, F.lit(1), F.length(verb) - 1), F.lit("ies")))
        .otherwise(F.concat(verb, F.lit("s")))
    )


def lower_initial(text: Column) -> Column:
    return F.concat(F.lower(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def upper_initial(text: Column) -> Column:
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def folded(text: Column) -> Column:
    """ASCII fold for locating passages: lower case without white space, full stops, colons and semicolons."""
    return F.regexp_replace(F.lower(text), r"[\s.:;]+", "")


def padded_digits(text: Column, width: int = 12) -> Column:
    """Digit runs padded with zeros, so that ordering by the result orders numbers inside labels by value."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, width, "0")).otherwise(F.lower(r))), "")
