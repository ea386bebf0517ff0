"""Hard negatives by one-dimensional distance keys: rows stored sorted by (pivot, distance), scanned in growing annuli until the rest is too far."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import staged, staged_and_seen, unstage
from ferrule.operators.windows import numbered

#: Rows of the sorted store in a slab, and anchors in a chunk: a task scores one chunk against one slab at a time.
SLAB, CHUNK = 2048, 256
#: Pivots: one for so many rows, between these numbers, picked far apart from a sample of at most SAMPLE rows. They change what is scanned, never the result.
ROWS_A_PIVOT, PIVOTS, SAMPLE = 512, (4, 128), 2048
#: Scores and squared lengths are exact in doubles below this; above it longs are multiplied.
EXACT = 1 << 53
#: What no score reaches.
NONE = -(1 << 63)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of longs, shorter ones filled up with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    if (lengths == dim).all():
        return np.asarray(column.flatten()).reshape(len(column), dim)
    out = np.zeros((len(column), dim), np.int64)
    for k, x in enumerate(column):
        out[k, : len(x)] = np.asarray(x.values)
    return out


class Space:
    """Vectors with one more coordinate that gives all of them the squared length `top`, so that larger products mean smaller distances; an anchor's is 0."""

    def __init__(self, dim: int, top: int, sample: np.ndarray, pivots: int):
        self.dim, self.top, self.exact = dim, top, top < EXACT
        chosen = [0]
        near = self._between(sample, sample[:1])[:, 0]
        while len(chosen) < min(pivots, len(sample)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, self._between(sample, sample[chosen[-1:]])[:, 0])
        self.pivots = sample[chosen].astype(np.float64)
        self.slack = 1e-5 * math.sqrt(top) + 1e-9

    def _fill(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0.0))

    def _between(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        x, p = x.astype(np.float64), p.astype(np.float64)
        return np.sqrt(np.maximum(2 * (self.top - x @ p.T - np.outer(self._fill(x), self._fill(p))), 0.0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of stored rows to the pivots."""
        return self._between(x, self.pivots)

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + self.top - 2 * (x @ self.pivots.T), 0.0))

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.exact:
            return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a @ b.T


def _keyed(rows: DataFrame, space: Space) -> DataFrame:
    """rows with pivot, the nearest one, and dist, the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = space.of_rows(_matrix(batch.column("x"), space.dim))
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(d)), at])], [*batch.schema.names, "pivot", "dist"])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in rows.dtypes) + ", pivot int, dist double")


def _slabs(sorted_rows: DataFrame) -> DataFrame:
    """Rows of sorted partitions with slab, a number for each SLAB rows in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            slab = first + (n + np.arange(batch.num_rows)) // SLAB
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slab)], [*batch.schema.names, "slab"])

    return sorted_rows.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in sorted_rows.dtypes) + ", slab long")


def _spans(anchors: DataFrame, space: Space) -> DataFrame:
    """(chunk, pivot, inner, outer): the keys of a pivot that can hold what lies within reach of an anchor of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = space.of_anchors(_matrix(batch.column("x"), space.dim))
            r = np.asarray(batch.column("reach"))[:, None] + space.slack
            chunk = np.asarray(batch.column("chunk"))
            for c in np.unique(chunk):
                inner, outer = (d - r)[chunk == c].min(axis=0), (d + r)[chunk == c].max(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(inner), c)), pa.array(np.arange(len(inner), dtype=np.int32)), pa.array(inner), pa.array(outer)], ["chunk", "pivot", "inner", "outer"])

    found = anchors.select("chunk", "x", "reach").mapInArrow(run, "chunk long, pivot int, inner double, outer double")
    return found.groupBy("chunk", "pivot").agg(F.min("inner").alias("inner"), F.max("outer").alias("outer"))


def _best(scores: np.ndarray, ids: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
    """Keeps in held, by row, the k best (score, id) of what was held and this block; ties go to the smaller id."""
    m = scores.shape[1]
    cut = np.partition(scores, m - k, axis=1)[:, m - k] if m > k else np.full(len(scores), NONE)
    for row in range(len(scores)):
        s, i = held[row]
        least = max(int(cut[row]), int(s[-1]) if len(s) == k else NONE, NONE + 1)
        at = np.flatnonzero(scores[row] >= least)
        if len(at):
            s, i = np.concatenate([s, scores[row][at]]), np.concatenate([i, ids[at]])
            order = np.lexsort((i, -s))[:k]
            held[row] = s[order], i[order]


def _scored(tiles: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """Tiles sorted by (chunk, slab, side, id), anchors before rows, to (anchor, q, other, score): the k best of a task for each question of an anchor.

    Questions q of an anchor are its intervals of scores (lo, hi); a row answers if its label is the same, or is not the same, and it is not the anchor itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = slab = None
        parts: list[pa.RecordBatch] = []
        held: list = []
        asked: dict = {}

        def ready() -> None:
            nonlocal parts
            if not parts:
                return
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            parts = []
            if asked.get("chunk") == chunk:
                return
            counts = np.diff(np.asarray(t.column("lo").offsets))
            asked.update(chunk=chunk, ids=np.asarray(t.column("id")), x=_matrix(t.column("x"), space.dim), labels=np.asarray(t.column("label")), row=np.repeat(np.arange(t.num_rows), counts))
            asked.update(q=np.concatenate([np.arange(c) for c in counts]) if len(counts) else np.zeros(0, int), lo=np.asarray(t.column("lo").flatten()), hi=np.asarray(t.column("hi").flatten()))
            held[:] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked["row"])

        def out() -> Iterator[pa.RecordBatch]:
            if asked and any(len(s) for s, _ in held):
                n = [len(s) for s, _ in held]
                cols = [np.repeat(asked["ids"][asked["row"]], n), np.repeat(asked["q"], n).astype(np.int32), np.concatenate([i for _, i in held]), np.concatenate([s for s, _ in held])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "q", "other", "score"])
            asked.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [np.asarray(batch.column(c)) for c in ("chunk", "slab", "side")]
            edges = np.r_[0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in key], axis=0)) + 1, batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if key[0][a] != chunk:
                    yield from out()
                    chunk = key[0][a]
                if key[1][a] != slab:
                    parts, slab = [], key[1][a]
                part = batch.slice(int(a), int(b - a))
                if key[2][a] == 0:
                    parts.append(part)
                    continue
                ready()
                ids, labels = np.asarray(part.column("id")), np.asarray(part.column("label"))
                all_scores = space.scores(asked["x"], _matrix(part.column("x"), space.dim))
                fits = (asked["labels"][:, None] == labels[None, :]) == same
                fits &= asked["ids"][:, None] != ids[None, :]
                s = np.where(fits, all_scores, NONE)[asked["row"]]
                s[(s < asked["lo"][:, None]) | (s > asked["hi"][:, None])] = NONE
                _best(s, ids, held, k)
        yield from out()

    return tiles.mapInArrow(run, "anchor long, q int, other long, score long")


def _searched(anchors: DataFrame, store: DataFrame, directory: DataFrame, space: Space, same: bool, k: int, label: str) -> DataFrame:
    """(anchor, q, other, score, place): the k best answers to each question of the anchors (id, chunk, label, x, square, reach, lo, hi), place from 1.

    Each round scans the slabs whose keys meet an annulus of an open anchor's reach and were not scanned for its chunk before. An anchor is settled when all its questions
    have k answers no farther than its reach, or its reach covers the whole interval of scores; else the reach becomes the farthest distance that could still matter: known once k answers are, doubled until then.
    """
    partitions = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = 2.0 * math.sqrt(space.top) + 10 * space.slack  # nothing is farther
    scanned, best, live, old = None, None, anchors, []
    while True:
        spans = _spans(live, space)
        pairs = spans.join(directory, "pivot").where("inner <= last and outer >= first").select("chunk", "slab").distinct()
        if scanned is not None:
            pairs = pairs.join(scanned, ["chunk", "slab"], "left_anti")
        pairs, seen = staged_and_seen(pairs, f"{label}-tiles", n=F.count("*"))
        if seen["n"]:
            scanned = pairs if scanned is None else scanned.unionByName(pairs)
            none = F.array().cast("array<long>")
            asking = live.join(pairs, "chunk").select("chunk", "slab", F.lit(0).alias("side"), "id", "label", "x", "lo", "hi")
            asked = store.join(pairs, "slab").select("chunk", "slab", F.lit(1).alias("side"), "id", "label", "x", none.alias("lo"), none.alias("hi"))
            tiles = asking.unionByName(asked).repartition(partitions, "chunk", "slab").sortWithinPartitions("chunk", "slab", "side", "id")
            found = _scored(tiles, space, same, k)
            every = found if best is None else best.drop("place").unionByName(found)
            by = Window.partitionBy("anchor", "q").orderBy(F.desc("score"), "other")
            best = staged(every.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k), f"{label}-best")
        # A question's least score that matters: its k-th answer's, or else the interval's lower end.
        filled = best.groupBy("anchor", "q").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k) if best is not None else None
        open_ = live.select("id", "square", "reach", F.posexplode("lo").alias("q", "bound"))
        if filled is not None:
            open_ = open_.join(filled.select(F.col("anchor").alias("id"), "q", "kth"), ["id", "q"], "left").withColumn("bound", F.coalesce("kth", "bound"))
        far = F.when(F.col("bound") == NONE, F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("square") + F.lit(float(space.top)) - 2.0 * F.col("bound"))))
        needed = open_.groupBy("id").agg(F.max(far).alias("needed"), F.first("reach").alias("had")).where((F.col("needed") > F.col("had")) & (F.col("had") < end))
        wider = F.when(F.col("needed") < float("inf"), F.col("needed") + space.slack).otherwise(F.greatest(2 * F.col("had"), F.lit(end / 8)))
        left, seen = staged_and_seen(live.drop("reach").join(needed.select("id", F.least(wider, F.lit(end)).alias("reach")), "id"), f"{label}-open", n=F.count("*"))
        old.append(left)
        if not seen["n"]:
            unstage(*old)
            return best
        live = left


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives the best rows of another label whose score is between `least` and `most` hundredths of the positive's.

    anchor is a condition on rows. Entries x become floor(scale * x); scores are inner products of these, as longs; higher ones come first, ties by the smaller id. Positives
    are an anchor's first rows of its label, itself left out; negatives are of another label and satisfy least * positive <= 100 * negative <= most * positive. Fewer are returned where there are no more.

    One more coordinate gives all rows the same length (anchors have 0 there), so the squared distance of an anchor and a row is a constant minus twice the score. Rows are stored
    sorted by (nearest pivot, distance to it) in slabs of SLAB rows. An anchor looks at the slabs whose keys differ from its own distance to the pivot by no more
    than its reach, and widens the reach until the k best known are certain. Where distances are alike, as between random directions, that is all slabs: chunk against slab, and no group outgrows a task.

    Rows with a null id, label or vector or with null or non-finite components take no part. Rows that share an id count as one, that of the smallest label, then vector; equal vectors under several ids
    are several rows. Shorter vectors count as if filled up with zeros. Other columns are ignored. A vector whose squared length no long can hold ends the job.
    """
    spark = rows.sparkSession
    v = F.col(f"`{embedding}`").cast("array<double>")
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kind = dict(rows.dtypes)[label]
    base = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks")).where(good)
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        base = base.withColumn("label", F.xxhash64("label"))
    base = base.withColumn("x", F.transform("v", lambda c: F.floor(c * scale))).groupBy("id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "x", "asks")).alias("f")).select("id", "f.*")
    square = F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c * c)
    base, seen = staged_and_seen(base.withColumn("square", square), "negatives-rows", n=F.count("*"), dim=F.max(F.size("x")), top=F.max("square"), asks=F.count_if("asks"))
    if not seen["asks"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim, top = max(seen["dim"], 1), seen["top"]
    # A bounded sample, by hash: SAMPLE rows at most.
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow()
    points = _matrix(sample.column("x").combine_chunks(), dim)
    space = Space(dim, top, points, min(max(seen["n"] // ROWS_A_PIVOT, PIVOTS[0]), PIVOTS[1]))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(base, space)
    store = staged(_slabs(keyed.select("id", "label", "x", "pivot", "dist").repartitionByRange(partitions, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")), "negatives-store")
    directory = staged(store.groupBy("slab", "pivot").agg(F.min("dist").alias("first"), F.max("dist").alias("last")), "negatives-directory")
    asking = numbered(keyed.where("asks").drop("asks"), F.struct("pivot", "dist", "id"), "nth")
    first = asking.select("id", ((F.col("nth") - 1) / CHUNK).cast("long").alias("chunk"), "label", "x", "square", F.lit(0.0).alias("reach"))
    every = F.array(F.lit(NONE))
    first = staged(first.select("*", every.alias("lo"), F.array(F.lit((1 << 63) - 1)).alias("hi")), "negatives-anchors")
    near = _searched(first, store, directory, space, True, positives, "negatives-near")
    if near is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    p = F.col("score").cast("decimal(20,0)")
    low, high = F.ceil(p * least / 100).cast("long"), F.floor(p * most / 100).cast("long")
    bands = near.select("anchor", F.struct("place", F.when(low <= high, low).otherwise(F.lit((1 << 63) - 1)).alias("lo"), F.when(low <= high, high).otherwise(F.lit(NONE)).alias("hi"), F.col("other").alias("positive_id"), "score").alias("band"))
    bands = bands.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list("band")).alias("bands"))  # at most `positives` each
    lo, hi = F.transform("bands", lambda b: b["lo"]), F.transform("bands", lambda b: b["hi"])
    # The first reach goes to the middle of the widest interval.
    middle = F.array_min(F.transform(F.filter("bands", lambda b: b["lo"] <= b["hi"]), lambda b: b["lo"] / 2 + b["hi"] / 2))
    reach = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.col("square") + F.lit(float(top)) - 2.0 * middle)), F.lit(0.0))
    second = staged(first.select("id", "chunk", "label", "x", "square").join(bands, "id").select("id", "chunk", "label", "x", "square", reach.alias("reach"), lo.alias("lo"), hi.alias("hi"), "bands"), "negatives-bands")
    far = _searched(second.drop("bands"), store, directory, space, False, negatives, "negatives-far")
    unstage(base, first, store, directory)
    if far is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asked = second.select(F.col("id").alias("anchor"), F.posexplode("bands").alias("q", "band"))
    return far.join(asked, ["anchor", "q"]).select(
        F.col("anchor").alias("anchor_id"), "band.positive_id", F.col("place").alias("rank"), F.col("other").alias("negative_id"), F.col("band.score").alias("positive_score"), F.col("score").alias("negative_score")
    )


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as x
  from embeddings where label is not null and embedding is not null
    and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))
), s as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), p as (
  select * from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from (
  select p.anchor_id, p.other as positive_id, s.other as negative_id, p.score as positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
) where rank <= 3
"""
