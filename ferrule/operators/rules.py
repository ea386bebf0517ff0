"""Rules with variables over tables of facts: bodies are joins on shared variables, recursion adds what is new until nothing is."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.sources.tables import staged_and_seen


@dataclass(frozen=True)
class Literal:
    """name(arguments): a str beginning with an upper-case letter is a variable, '_' anything, another value a constant."""

    name: str
    arguments: tuple


@dataclass(frozen=True)
class Rule:
    head: Literal
    body: tuple[Literal, ...]
    unless: tuple[Literal, ...] = field(default=())


def _is_variable(x) -> bool:
    return isinstance(x, str) and x[:1].isupper()


def matched(facts: DataFrame, literal: Literal) -> DataFrame:
    """Facts (a0, a1, ...) that a literal matches, one column per variable: constants and repeated variables are filters."""
    first: dict[str, int] = {}
    out = facts
    for k, x in enumerate(literal.arguments):
        if _is_variable(x):
            if x in first:
                out = out.where(F.col(f"a{k}") == F.col(f"a{first[x]}"))
            first.setdefault(x, k)
        elif x != "_":
            out = out.where(F.col(f"a{k}") == F.lit(x))
    return out.select(*[F.col(f"a{k}").alias(x) for x, k in first.items()])


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    on = [c for c in right.columns if c in left.columns]
    if not on:
        raise ValueError(f"literals share no variable: {left.columns} and {right.columns}")
    return left.join(right, on, how)


def fired(rule: Rule, tables: Mapping[str, DataFrame], fresh: Mapping[str, DataFrame] | None = None) -> list[DataFrame]:
    """The rule's head for all facts, or, given the last round's, for those that use one of them: one plan per literal that does."""
    plans = []
    for k, literal in enumerate(rule.body):
        if fresh is not None and literal.name not in fresh:
            continue
        parts = [matched(fresh[x.name] if fresh is not None and j == k else tables[x.name], x) for j, x in enumerate(rule.body)]
        order = [parts.pop(k if fresh is not None else 0)]
        while parts:  # next always a literal that shares a variable
            seen = {c for p in order for c in p.columns}
            order.append(parts.pop(next((i for i, p in enumerate(parts) if seen & set(p.columns)), 0)))
        found = reduce(_joined, order)
        for x in rule.unless:
            found = _joined(found, matched(tables[x.name], x).distinct(), "left_anti")
        plans.append(found.select(*[(F.col(x) if _is_variable(x) else F.lit(x)).alias(f"a{i}") for i, x in enumerate(rule.head.arguments)]))
        if fresh is None:
            break
    return plans


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """Rules in the order in which they can be run: each negates only what the rules before its own group conclude. A cycle through a negation is refused by name."""
    heads = sorted({r.head.name for r in rules})
    needs = {h: {(x.name, negated) for r in rules if r.head.name == h for part, negated in ((r.body, False), (r.unless, True)) for x in part if x.name in heads} for h in heads}
    reach = {h: {q for q, _ in needs[h]} for h in heads}
    for _ in heads:
        reach = {h: reach[h] | {q for p in reach[h] for q in reach[p]} for h in heads}
    for h in heads:
        for q, negated in sorted(needs[h]):
            if negated and (q == h or h in reach[q]):
                raise ValueError(f"{h} negates {q}, which depends on {h}")
    level = dict.fromkeys(heads, 0)
    for _ in heads:  # no negation is on a cycle, so levels settle
        for h in heads:
            level[h] = max([level[h], *(level[q] + negated for q, negated in needs[h])])
    return [[r for r in rules if level[r.head.name] == k] for k in sorted(set(level.values()))]


def _refuse_misfits(facts: Mapping[str, DataFrame], rules: list[Rule]) -> None:
    """An error for literals of predicates that are neither given nor concluded, for those whose number of arguments is another, and for variables that no body binds."""
    arity = {p: len(t.columns) for p, t in facts.items()}
    for r in rules:
        if arity.setdefault(r.head.name, len(r.head.arguments)) != len(r.head.arguments):
            raise ValueError(f"{r.head.name} has {arity[r.head.name]} arguments")
    for r in rules:
        for x in (*r.body, *r.unless):
            if x.name not in arity:
                raise ValueError(f"unknown predicate: {x.name}")
            if arity[x.name] != len(x.arguments):
                raise ValueError(f"{x.name} has {arity[x.name]} arguments")
        free = {x for x in r.head.arguments if _is_variable(x)} - {x for b in r.body for x in b.arguments}
        if free or not r.body:
            raise ValueError(f"no body binds {sorted(free)} of {r.head.name}")


def consequences(facts: Mapping[str, DataFrame], rules: list[Rule]) -> dict[str, DataFrame]:
    """All facts that follow, by predicate, each with the round it was first found in: (a0, a1, ..., round), 0 for those given.

    facts: predicate to (a0, a1, ...). Rules may negate what other rules conclude: they are run in strata, so a negation looks at what is complete; rounds are counted
    in each stratum from 1. Every round joins the last round's new facts with the rest, so nothing is derived twice from the same facts, and a stratum ends when
    nothing is new. A predicate that is neither given nor concluded is an error, as are a cycle through a negation and a head variable that no body binds.
    """
    _refuse_misfits(facts, rules)
    tables = {p: t.distinct() for p, t in facts.items()}
    out = {p: t.withColumn("round", F.lit(0)) for p, t in tables.items()}
    for group in strata(rules):
        _settle(group, tables, out)
    return out


def _settle(rules: list[Rule], tables: dict[str, DataFrame], out: dict[str, DataFrame]) -> None:
    """Adds to tables, and with rounds to out, what the rules of one stratum conclude. A predicate without any fact has no table: nothing matches it."""
    rules = [Rule(r.head, r.body, tuple(x for x in r.unless if x.name in tables)) for r in rules]
    arity = {r.head.name: len(r.head.arguments) for r in rules}
    fresh: dict[str, DataFrame] | None = None
    known_before: set[str] = set()
    for k in count(1):
        new: dict[str, DataFrame] = {}
        for name in sorted(arity):
            usable = [r for r in rules if r.head.name == name and all(x.name in tables for x in r.body)]
            # A rule all of whose predicates have come to be known only now is run over everything.
            plans = [p for r in usable for p in fired(r, tables, fresh if fresh is not None and not any(x.name in fresh and x.name not in known_before for x in r.body) else None)]
            if not plans:
                continue
            found = reduce(DataFrame.unionByName, plans).distinct()
            if name in tables:
                found = found.join(tables[name], [f"a{i}" for i in range(arity[name])], "left_anti")
            found, seen = staged_and_seen(found, f"rules-{name}", n=F.count("*"))
            if seen["n"]:
                new[name] = found
        if not new:
            return
        known_before = set(tables)
        for name, found in new.items():
            tables[name] = tables[name].unionByName(found) if name in tables else found
            marked = found.withColumn("round", F.lit(k))
            out[name] = out[name].unionByName(marked) if name in out else marked
        fresh = new
