"""Helpers shared by the corpus operators: staged tables, words, runs of sorted rows, components, free column names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import graph
from ferrule.sources.tables import shared_dir, staged, staged_and_seen, table, unstage

__all__ = ["WORD", "BATCH_ROWS", "BROADCAST_ROWS", "bounded_batches", "components", "free_names", "looked_up", "runs", "shared_dir", "staged", "staged_and_seen", "table", "unstage"]

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a counted table that may be broadcast.
BROADCAST_ROWS = 500_000

#: Texts that a Python worker gets at once.
BATCH_ROWS = 500


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Each wanted name, with underscores before it until no column of df has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on no more than `rows` rows of this session go to a Python worker at once; a smaller number stays.

    A batch is held by the worker and by the executor, which writes it and reads its answer: 10,000 texts, Spark's number, are 30 MB and more each time.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def looked_up(rows: DataFrame, facts: DataFrame, key: Column, fact: str, spread: Column, hot: Column, counts: dict) -> DataFrame:
    """rows left-joined to staged facts by key, a text; fact names the facts' key, unique there. Facts' other columns are added.

    counts holds n, the number of facts, and hot, that of those with many rows. Few facts are broadcast whole. Of many, the hot ones are broadcast, and
    their rows take part in the shuffle under `spread`, a text that is no key and differs from row to row; so no task gathers a
    hot key. Where even the hot ones are too many, all are joined by a shuffle, which adaptive execution may split.
    """
    if counts["n"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), key == F.col(fact), "left").drop(fact)
    if not 0 < counts["hot"] <= BROADCAST_ROWS:
        return rows.join(facts, key == F.col(fact), "left").drop(fact)
    names = [c for c in facts.columns if c != fact]
    first = facts.where(hot).select(F.col(fact).alias("hot_key"), F.struct(*names).alias("hot_facts"))
    rest = facts.where(~hot).select(fact, F.struct(*names).alias("cold_facts"))
    dealt = rows.join(F.broadcast(first), key == F.col("hot_key"), "left")
    both = dealt.join(rest, F.when(F.col("hot_key").isNotNull(), spread).otherwise(key) == F.col(fact), "left").withColumn("hot_facts", F.coalesce("hot_facts", "cold_facts"))
    return both.select(*rows.columns, *[F.col(f"hot_facts.{n}").alias(n) for n in names])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list (a, b): rows (node, component)."""
    return graph.components(edges, "a", "b", label)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition as one batch for each run of equal keys (numbers or bytes); only the run at a batch's end is held over."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for v in values:
            changed[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            here = tuple(v[a] for v in values)
            if rest and here != last:
                yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                rest = []
            rest.append(batch.slice(a, b - a))
            last = here
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
