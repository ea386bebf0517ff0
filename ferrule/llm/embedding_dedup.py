"""Near-duplicate embeddings by spherical-cap filters from random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import components, staged, staged_and_seen, unstage

#: Independent product codes. Filters of one code share directions, so their misses go together; those of several codes do not.
TABLES = 5
#: Directions in each of a code's two halves, at least and at most; a filter is a pair of them, so a code of 512 has 512 ** 2 filters.
CODES = (512, 8192)
#: Members that a filter should have on average: codes grow with the rows, as the square root, until they hold it.
LOAD = 64
#: Filters of a code that a random vector exceeds on average, and the number that each vector is given at least.
EXPECTED, LEAST = 8, 6
#: Members of a filter that meet in one group; larger filters are compared block against block.
BLOCK = 1024
#: Rows of a checked table that may be broadcast.
BROADCAST_ROWS = 500_000


class ProductCode:
    """Filters of one dimension and table: a random rotation, two halves, `code` random directions in each half, and the cap height."""

    def __init__(self, dim: int, number: int, code: int):
        rng = np.random.default_rng([7919, dim, number])
        self.code, self.base = code, number * code * code
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cut = (dim + 1) // 2
        self.codes = []
        for size in (self.cut, dim - self.cut):
            c = rng.standard_normal((code, size))
            self.codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) if size else np.zeros((code, 0)))
        probe = rng.standard_normal((400, dim))
        left, right = self.halves(probe / np.linalg.norm(probe, axis=1, keepdims=True))
        # The EXPECTED best sums of a row lie among those of the EXPECTED best of each half.
        top = [np.add.outer(np.sort(a)[-EXPECTED:], np.sort(b)[-EXPECTED:]).ravel() for a, b in zip(left, right)]
        self.height = float(np.mean([np.sort(x)[-EXPECTED] for x in top]))

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.rotation.T
        return turned[:, : self.cut] @ self.codes[0].T, turned[:, self.cut :] @ self.codes[1].T

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row the sorted numbers of the filters whose cap holds it, LEAST of the nearest at least."""
        out = []
        for a, b in zip(*self.halves(unit)):
            i = np.flatnonzero(a >= self.height - b.max())
            j = np.flatnonzero(b >= self.height - a.max())
            x, y = np.nonzero(np.add.outer(a[i], b[j]) >= self.height)
            found = i[x] * self.code + j[y]
            if len(found) < LEAST:  # sums of the LEAST best of each half hold the LEAST best sums
                i, j = np.argpartition(-a, LEAST)[:LEAST], np.argpartition(-b, LEAST)[:LEAST]
                sums = np.add.outer(a[i], b[j]).ravel()
                best = np.argsort(-sums, kind="stable")[:LEAST]
                found = i[best // LEAST] * self.code + j[best % LEAST]
            out.append(np.sort(found + self.base).astype(np.int32))
        return out


@lru_cache(maxsize=8)
def product_codes(dim: int, code: int = CODES[0]) -> list[ProductCode]:
    return [ProductCode(dim, number, code) for number in range(TABLES)]


def code_for(rows: int) -> int:
    """Directions in each half for so many rows: the least power of two that holds the mean load."""
    code = CODES[0]
    while code < CODES[1] and rows * EXPECTED > LOAD * code * code:
        code *= 2
    return code


def filters_of(unit: np.ndarray, code: int = CODES[0]) -> list[np.ndarray]:
    """For each row the sorted numbers of its filters in all tables."""
    return [np.concatenate(parts) for parts in zip(*(c.decode(unit) for c in product_codes(unit.shape[1], code)))]


def _checked(rows: DataFrame, kind: str) -> DataFrame:
    """(vec_id, label, v array<kind>) to (vec_id, label, dim, same, vec); same and vec are null where a row cannot link.

    same is a digest of label and vector: rows with the same one are copies of each other.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("label", rows_label(rows)), ("dim", pa.int32()), ("same", pa.binary()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, same, vecs = [], [], []
            for i, y, v in zip(batch.column("vec_id"), batch.column("label"), batch.column("v")):
                x, good = v.values, False
                if i.is_valid and y.is_valid and x is not None and len(x) and not x.null_count:
                    x = np.asarray(x, kind)
                    good = bool(np.isfinite(x).all() and x.any())
                dims.append(len(x) if good else 0)
                vecs.append(x.tobytes() if good else None)
                same.append(xxhash.xxh3_128_digest(repr(y.as_py()).encode() + b"\0" + vecs[-1]) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(same, pa.binary()), pa.array(vecs, pa.binary())], schema=schema)

    return rows.mapInArrow(run, f"vec_id long, label {dict(rows.dtypes)['label']}, dim int, same binary, vec binary")


def rows_label(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["label"].dataType)


def _units(vecs: pa.Array, dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _with_filters(reps: DataFrame, kind: str, code: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                lists = filters_of(_units(part.column("vec"), int(dim), kind), code)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                filters = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([*part.columns, filters], [*part.schema.names, "filters"])

    schema = reps.withColumn("filters", F.array().cast("array<int>")).schema
    return reps.mapInArrow(run, schema)


def _least_common(before: list[np.ndarray], linked: np.ndarray) -> np.ndarray:
    """linked without the pairs that have a common filter before this one: each pair counts in its first common filter only."""
    every = np.unique(np.concatenate(before))
    if not len(every):
        return linked
    has = np.zeros((len(before), len(every)), np.float32)
    for k, f in enumerate(before):
        has[k, np.searchsorted(every, f)] = 1.0
    return linked & ((has @ has.T) < 0.5)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row reachable."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compared(groups: DataFrame, cosine: float, kind: str) -> DataFrame:
    """Rows sorted by (label, dim, filter, lo, hi) to (rep, links, hub): links first found here, and a link of the component."""
    schema = pa.schema([("rep", pa.binary()), ("links", pa.int64()), ("hub", pa.binary())])

    def compare(dim: int, across: bool, part: pa.RecordBatch) -> tuple[list, list, list]:
        unit = _units(part.column("vec"), dim, kind)
        linked = unit @ unit.T >= cosine
        np.fill_diagonal(linked, False)
        if across:  # members of two blocks: only pairs between them, each block has a group of its own
            block = np.asarray(part.column("block"))
            linked &= block[:, None] != block[None, :]
        rows = np.flatnonzero(linked.any(axis=1))
        if not len(rows):
            return [], [], []
        linked = linked[np.ix_(rows, rows)]
        rep, mult = part.column("rep").to_numpy(zero_copy_only=False)[rows], np.asarray(part.column("mult"))[rows]
        order = np.argsort(rep)
        linked, rep, mult, rows = linked[np.ix_(order, order)], rep[order], mult[order], rows[order]
        before = part.column("before")
        counted = _least_common([np.asarray(before[int(k)].values) for k in rows], linked)
        return rep.tolist(), (counted @ mult).tolist(), rep[_roots(linked)].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def finish(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest
            batch = table.combine_chunks().to_batches()
            if not batch:
                rest = None
                return
            batch = batch[0]
            g = np.asarray(batch.column("g"))
            edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            ends = np.r_[edges[1:], len(g)]
            out: tuple[list, list, list] = ([], [], [])
            for k, (a, b) in enumerate(zip(edges, ends)):
                if k == len(edges) - 1 and not last:
                    rest = pa.Table.from_batches([batch.slice(int(a))])
                    break
                if b - a > 1:
                    part = batch.slice(int(a), int(b - a))
                    for into, new in zip(out, compare(part.column("dim")[0].as_py(), part.column("lo")[0].as_py() != part.column("hi")[0].as_py(), part)):
                        into.extend(new)
            else:
                rest = None
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield from finish(table if rest is None else pa.concat_tables([rest, table]), False)
        if rest is not None:
            yield from finish(rest, True)

    return groups.mapInArrow(run, "rep binary, links long, hub binary")


def link_embeddings(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links are pairs of rows of one label with cosine >= `cosine` in double precision.

    Equal vectors of a label become one representative with a count, named by a digest. Each representative goes to all filters whose cap
    holds it (random product codes, list-decoded; the codes grow with the rows so that a filter keeps its load), filters are joined, and every
    pair in a filter is verified exactly; a pair counts in the first filter that both share. A filter with more members than BLOCK is
    compared block against block, so no group outgrows a task, and what leaves a group is a count per member and one link to its
    component, never the pairs. The search is probabilistic: README has the measured share of pairs at the threshold that share no filter.

    n_links counts other rows, copies included. Null, empty or zero vectors, those with null or non-finite components, and rows with a
    null label or id link with nothing: n_links 0, component_id = vec_id, kept (true for a null id). Vectors of different lengths do
    not link. Repeated rows are separate rows, and rows that repeat an id with another vector each have the links of their own vector. Other
    columns are ignored.
    """
    given = dict(rows.dtypes)[embedding] if embedding in rows.columns else ""
    kind = "float32" if given == "array<float>" else "float64"
    v = F.col(f"`{embedding}`") if kind == "float32" else F.col(f"`{embedding}`").cast("array<double>")
    base = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.alias("v"))
    checked = _checked(base, kind)
    classes = checked.where("same is not null").groupBy("label", "dim", F.col("same").alias("rep")).agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.any_value("vec").alias("vec"))
    distinct, seen = staged_and_seen(classes, "caps-classes", n=F.count("*"))
    reps = staged(_with_filters(distinct, kind, code_for(seen["n"])), "caps-representatives")
    placed = reps.select("label", "dim", F.explode("filters").alias("filter"))
    full = placed.groupBy("label", "dim", "filter").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK)
    full = full.select(F.col("label").alias("fl"), F.col("dim").alias("fd"), F.col("filter").alias("ff"), F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    full, seen = staged_and_seen(full, "caps-full", n=F.count("*"))
    wide = F.broadcast(full) if seen["n"] <= BROADCAST_ROWS else full
    members = (
        reps.select("label", "dim", F.posexplode("filters").alias("place", "filter"), "rep", "mult", "vec", "filters")
        .withColumn("before", F.slice("filters", F.lit(1), F.col("place")))  # filters are sorted; later ones are not needed to tell the first common one
        .join(wide, (F.col("label") == F.col("fl")) & (F.col("dim") == F.col("fd")) & (F.col("filter") == F.col("ff")), "left")
        .withColumn("block", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("blocks")), F.lit(0)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .select(F.xxhash64("label", "dim", "filter", "lo", "hi").alias("g"), "label", "dim", "filter", "lo", "hi", "block", "rep", "mult", "vec", "before")
    )
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = staged(_compared(members.repartition(partitions, "label", "dim", "filter", "lo", "hi").sortWithinPartitions("g", "label", "dim", "filter", "lo", "hi"), cosine, kind), "caps-links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    nodes = components(found.select(F.col("rep").alias("a"), F.col("hub").alias("b")), "caps-components")
    settled = distinct.select("rep", "least", "mult").join(totals, "rep", "left").join(nodes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = settled.groupBy("component").agg(F.min("least").alias("component_id"))
    settled = staged(settled.join(smallest, "component").select(F.col("rep").alias("same"), "mult", "links", "component_id"), "caps-settled")
    unstage(reps, full, found, distinct)
    out = checked.select("vec_id", "same").join(settled, "same", "left").select(
        "vec_id", F.coalesce(F.col("mult") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
