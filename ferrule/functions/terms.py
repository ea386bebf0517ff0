"""Standard order and type tests of terms held as (kind, num, text) columns.

kind is one of the names in RANK; num holds the value of numbers, text the canonical text of everything. Order:
variables, numbers by value (float before integer where equal), atoms, strings, compounds; then num, then text by code point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order of kinds.
RANK = {"variable": 0, "float": 1, "rational": 1, "integer": 1, "atom": 3, "string": 4, "list": 5, "compound": 5, "dict": 6}
_TIE = {"float": 0, "rational": 1, "integer": 2}


def _lookup(kind: Column, table: dict[str, int]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, value in table.items():
        out = out.when(kind == name, F.lit(value))
    return out


def order_key(kind: Column, num: Column, text: Column) -> Column:
    """A struct that sorts as terms do. Numbers are compared as doubles first and, where those are equal, by their exact value, so num should be a long or a decimal for integers."""
    exact = F.coalesce(num.try_cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))
    return F.struct(
        _lookup(kind, RANK).alias("rank"), F.coalesce(num.cast("double"), F.lit(0.0)).alias("num"), exact.alias("exact"), F.coalesce(_lookup(kind, _TIE), F.lit(0)).alias("tie"), F.coalesce(text, F.lit("")).alias("text")
    )


def compared(a: Column, b: Column) -> Column:
    """'<', '=' or '>' of two order keys."""
    return F.when(a < b, "<").when(a > b, ">").otherwise("=")


def is_number(kind: Column) -> Column:
    return kind.isin("integer", "float", "rational")


def is_atomic(kind: Column) -> Column:
    return ~kind.isin("compound", "list", "variable", "dict")


def is_callable(kind: Column) -> Column:
    return kind.isin("atom", "compound")


def quoted(text: Column) -> Column:
    """Text of an atom as it must be written: bare where it begins with a lower-case letter and goes on with word characters."""
    return F.when(text.rlike("^[a-z][a-zA-Z0-9_]*$"), text).otherwise(F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))


def call(name: str, *arguments: Column) -> Column:
    """name(arg, arg, ...) as text."""
    return F.concat(F.lit(f"{name}("), F.concat_ws(",", *arguments), F.lit(")"))


def is_atom(kind: Column) -> Column:
    return kind == "atom"


def is_integer(kind: Column) -> Column:
    return kind == "integer"


def is_float(kind: Column) -> Column:
    return kind == "float"


def is_string(kind: Column) -> Column:
    return kind == "string"


def is_bound(kind: Column) -> Column:
    return kind != "variable"


def is_list(kind: Column, text: Column) -> Column:
    """A proper list, the empty one included."""
    return (kind == "list") | ((kind == "atom") & (text == "[]"))


def is_compound(kind: Column, text: Column) -> Column:
    """A structure; a list is one unless it is empty."""
    return (kind == "compound") | ((kind == "list") & (text != "[]"))


def to_string(kind: Column) -> Column:
    """The kind of a text once it is a string; null for what is no text."""
    return F.when(kind.isin("atom", "string", "integer", "float", "rational"), F.lit("string"))


#: Tokens of a term's text: quoted atoms, strings, names and numbers, any other character.
TOKEN = r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|.)"""


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 1)


def _is_variable(token: Column) -> Column:
    return token.rlike("^[A-Z_]")


def variables(text: Column) -> Column:
    """Names of a term's variables in the order in which they are first met, each once; an anonymous one has no name."""
    return F.array_distinct(F.filter(tokens(text), lambda t: _is_variable(t) & (t != "_")))


def is_ground(text: Column) -> Column:
    return ~F.exists(tokens(text), _is_variable)


def renamed(text: Column, names: Column, name) -> Column:
    """text with each variable of names replaced by name(place), places from 0."""
    place = lambda t: F.array_position(names, t)
    return F.array_join(F.transform(tokens(text), lambda t: F.when(_is_variable(t) & (place(t) > 0), name((place(t) - 1).cast("string"))).otherwise(t)), "")


def copied(text: Column, salt: Column) -> Column:
    """The term with fresh variables, named by salt and place; equal ones stay equal."""
    return renamed(text, variables(text), lambda k: F.concat(F.lit("_G"), salt, F.lit("_"), k))


def canonical_clause(head: Column, body: Column) -> Column:
    """head :- body with variables V0, V1, ... in the order of the body, then the head: equal for clauses that differ by names only."""
    names = variables(F.concat(body, F.lit(" "), head))
    name = lambda k: F.concat(F.lit("V"), k)
    return F.concat(renamed(head, names, name), F.lit(" :- "), renamed(body, names, name))


def grounded(text: Column, prefix: str) -> Column:
    """The term with each variable replaced by a constant of its own, anonymous ones by one each, named by their place."""
    names = variables(text)
    named = lambda t: F.concat(F.lit(prefix), (F.array_position(names, t) - 1).cast("string"))
    free = lambda i: F.concat(F.lit(f"{prefix}_any"), i.cast("string"))
    return F.array_join(F.transform(tokens(text), lambda t, i: F.when(t == "_", free(i)).when(_is_variable(t), named(t)).otherwise(t)), "")


def normalised_constants(text: Column, pattern: str) -> Column:
    """The term with the constants that match pattern numbered s0, s1, ... in the order in which they are first met."""
    made = F.array_distinct(F.filter(tokens(text), lambda t: t.rlike(f"^(?:{pattern})$")))
    place = lambda t: F.array_position(made, t)
    return F.array_join(F.transform(tokens(text), lambda t: F.when(place(t) > 0, F.concat(F.lit("s"), (place(t) - 1).cast("string"))).otherwise(t)), "")


def same_term(a: Column, b: Column) -> Column:
    """Structural equality of ground terms; a term with a variable equals none."""
    return is_ground(a) & is_ground(b) & (a == b)


def univ(functor: Column, arguments: Column) -> Column:
    """[functor | arguments]."""
    return F.array_prepend(arguments, functor)


def from_univ(parts: Column) -> Column:
    """name(arguments) of [functor | arguments], a bare name where there are none."""
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ",")
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit("("), rest, F.lit(")")))


def argument(arguments: Column, n: Column) -> Column:
    """The n-th argument from 1, null beyond the last."""
    return F.get(arguments, n - 1)


def chain(items: Column) -> Column:
    """A list as nested cells: '[|]'(a,'[|]'(b,[]))."""
    return F.aggregate(F.reverse(items), F.lit("[]"), lambda rest, x: F.concat(F.lit("'[|]'("), x, F.lit(","), rest, F.lit(")")))


def is_atom_text(text: Column) -> Column:
    return text.rlike("^[a-z][A-Za-z0-9_-]*$") | text.rlike(r"^'(?:[^'\\]|\\.|'')*'$")


def atom_text(text: Column) -> Column:
    """What an atom says: a bare one itself, a quoted one without quotes and escapes; null for what is no atom."""
    value = F.trim(text)
    inner = F.regexp_replace(F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit("''"), F.lit("'")), r"\\([\\'])", "$1")
    return F.when(value.rlike("^[a-z][A-Za-z0-9_-]*$"), value).when((F.length(value) >= 2) & value.startswith("'") & value.endswith("'"), inner)
