"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import free_names, staged, staged_and_seen, unstage

_WORDS = re.compile(r"\w+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1
HITS = "array<struct<item_id:bigint,coverage:double,tiles:int>>"
#: Rows of a counted table that may be broadcast.
BROADCAST_ROWS = 500_000
#: Bits of the filter of benchmark seeds; where they fill up more seeds leave the tasks, and the result stays the same.
FILTER_BITS = 1 << 26
#: Items that one row of candidates holds on average, at most.
ITEMS_A_ROW = 256


def tokens(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


# Workers live on from stage to stage and keep this: common words serve, and a few MB a worker.
@lru_cache(maxsize=1 << 15)
def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def codes(text: str | None) -> np.ndarray:
    """A 64-bit value for each word."""
    words = tokens(text)
    return np.fromiter(map(_code, words), np.uint64, len(words))


def seeds(words: np.ndarray, n: int) -> np.ndarray:
    """A value for every window of n words."""
    if len(words) < n or n < 1:
        return np.zeros(0, np.int64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _rolling(ids: list[int], length: int) -> list[int]:
    """Karp-Rabin values of every window of that length."""
    if len(ids) < length:
        return []
    top, h = pow(_BASE, length - 1, _MOD), 0
    for x in ids[:length]:
        h = (h * _BASE + x + 2) % _MOD
    out = [h]
    for old, new in zip(ids, ids[length:]):
        h = ((h - (old + 2) * top) * _BASE + new + 2) % _MOD
        out.append(h)
    return out


def tile(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, doc start, length) of maximal non-overlapping matches, longest first.

    The search length starts at the item's own length and halves until matches of at least that length
    show up; runs of that length are found by Karp-Rabin values among unmarked positions, extended while both sides stay
    unmarked and equal, and marked from the longest down. Words not in the item are -1 and match nothing.
    """
    used_i, used_d = bytearray(len(item)), bytearray(len(doc))
    tiles: list[tuple[int, int, int]] = []
    search = max(least, len(item))
    while True:
        where: dict[int, list[int]] = {}
        for at, h in enumerate(_rolling(item, search)):
            if 1 not in used_i[at : at + search]:
                where.setdefault(h, []).append(at)
        found: list[tuple[int, int, int]] = []
        if where:
            for at, h in enumerate(_rolling(doc, search)):
                for i in where.get(h, ()):
                    if i and at and not used_i[i - 1] and not used_d[at - 1] and item[i - 1] == doc[at - 1]:
                        continue  # the match that starts one earlier holds this one
                    if 1 in used_d[at : at + search] or item[i : i + search] != doc[at : at + search]:
                        continue
                    n = search
                    while i + n < len(item) and at + n < len(doc) and item[i + n] == doc[at + n] and not used_i[i + n] and not used_d[at + n]:
                        n += 1
                    found.append((n, i, at))
        again = False
        for n, i, at in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if 1 in used_i[i : i + n] or 1 in used_d[at : at + n]:
                again = True  # what is left of it is looked for once more at this length
                continue
            used_i[i : i + n] = b"\1" * n
            used_d[at : at + n] = b"\1" * n
            tiles.append((i, at, n))
        if 0 not in used_i:
            return tiles
        if again:
            continue
        if search == least:
            return tiles
        search = max(least, search // 2)


def compared(item: str, doc: str, least: int, threshold: float) -> tuple[float, int]:
    """(coverage, tiles) of an item in a text; (0, 0) where the seeds of `least` words that they share cannot cover it to the threshold."""
    a, d = codes(item), codes(doc)
    if not len(a):
        return 0.0, 0
    least = min(least, len(a))
    shared = np.flatnonzero(np.isin(seeds(a, least), seeds(d, least)))
    reach = np.zeros(len(a), bool)
    for k in range(least):
        reach[shared + k] = True
    if reach.sum() < threshold * len(a):
        return 0.0, 0
    known = {int(x): k for k, x in enumerate(dict.fromkeys(a.tolist()))}
    # Only stretches of the text that hold the item's words can match; others become one barrier.
    ids, gap = [], False
    for x in d.tolist():
        k = known.get(x, -1)
        if k >= 0 or not gap:
            ids.append(k)
        gap = k < 0
    found = tile([known[x] for x in a.tolist()], ids, least)
    return sum(n for _, _, n in found) / len(a), len(found)


def _seeded_items(items: DataFrame, least: int, threshold: float) -> DataFrame:
    """(item, text) to (item, seed, places, need, width): an item's seeds, how often each stands in it, and how many places a hit must share.

    Tiles of at least `least` words that cover c words hold c / least seeds or more.
    """
    schema = pa.schema([("item", pa.binary()), ("seed", pa.int64()), ("places", pa.int64()), ("need", pa.int64()), ("width", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text")):
                words = codes(text.as_py())
                if not len(words):
                    continue
                width = min(least, len(words))
                found, places = np.unique(seeds(words, width), return_counts=True)
                covered = int(np.ceil(threshold * len(words) - 1e-9))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * n, pa.binary()), pa.array(found), pa.array(places), pa.array([max(1, -(-covered // width))] * n, pa.int64()), pa.array([width] * n, pa.int32())], schema=schema)

    return items.mapInArrow(run, "item binary, seed long, places long, need long, width int")


def _filter(seeded: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of the seeds' low bits set, as bytes. What reaches the driver is slices of the bits, whatever the number of seeds."""
    size = 1 << 16
    bit = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = seeded.select(F.shiftright(bit, 16).alias("slice"), bit.bitwiseAND(F.lit(size - 1)).cast("int").alias("bit")).distinct()
    out = np.zeros((FILTER_BITS // size, size // 8), np.uint8)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(np.asarray(batch.column("slice")).tolist(), np.asarray(batch.column("bit")).tolist()):
                held.setdefault(k, np.zeros(size, np.uint8))[b] = 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary())], ["slice", "bits"])

    dealt = rows.repartition(16, "slice").mapInArrow(packed, "slice long, bits binary")
    for row in dealt.toLocalIterator():
        out[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def find_hits(texts: DataFrame, items: DataFrame, least: int = 3, threshold: float = 0.6) -> DataFrame:
    """(key, text) and (item, text), keys and items binary, to (key, item, coverage, tiles) of the pairs at or above threshold.

    A text and an item are a candidate when they share a seed of `least` words, the shortest that a tile can be, so no tiling goes
    unseen. A hit must share a number of an item's seed places; so the seeds that stand in most texts, as many as fall short of that number together, are left out
    of the join, and a hit still shares another one. Texts leave the tasks as the seeds that the benchmark has,
    found through a filter of fixed size; equal texts are one. Candidates meet whole texts once more, and are tiled.
    """
    spark = texts.sparkSession
    seeded, seen = staged_and_seen(_seeded_items(items, least, threshold), "tiles-items", widths=F.collect_set("width"), n=F.count("*"))
    widths = sorted(seen["widths"])
    bits = spark.sparkContext.broadcast(_filter(seeded))

    def sown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            keep, lists = [], []
            for k, t in enumerate(batch.column("text")):
                words = codes(t.as_py())
                found = np.unique(np.concatenate([seeds(words, n) for n in widths])) if widths else np.zeros(0, np.int64)
                at = found & (FILTER_BITS - 1)
                found = found[known[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0]
                if len(found):
                    keep.append(k)
                    lists.append(found)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keep)), pa.array(lists, pa.list_(pa.int64()))], ["key", "seeds"])

    rows = texts.where("text is not null and text <> ''").select("key", "text")
    each = rows.mapInArrow(sown, "key binary, seeds array<bigint>").groupBy("key").agg(F.any_value("seeds").alias("seeds"))
    each = staged(each, "tiles-seeds")
    often = each.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("n"))
    ranked = seeded.join(often, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = F.sum("places").over(Window.partitionBy("item").orderBy(F.desc("n"), "seed").rowsBetween(Window.unboundedPreceding, 0))
    rare, seen = staged_and_seen(ranked.withColumn("upto", upto).where("upto >= need and n > 0").select("seed", "item"), "tiles-rare", n=F.count("*"))
    pairs = each.select("key", F.explode("seeds").alias("seed")).join(F.broadcast(rare) if seen["n"] <= BROADCAST_ROWS else rare, "seed").select("key", "item").distinct()
    rows_a_text = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-items.count() // ITEMS_A_ROW))))
    grouped = pairs.join(items.select("item", F.col("text").alias("passage")), "item").groupBy("key", rows_a_text.alias("slot")).agg(F.collect_list(F.struct("item", "passage")).alias("items"))
    grouped, seen = staged_and_seen(grouped, "tiles-candidates", n=F.count("*"))
    wanted = grouped.select("key").distinct()
    bodies = rows.join(F.broadcast(wanted) if seen["n"] <= BROADCAST_ROWS else wanted, "key", "left_semi").dropDuplicates(["key"])
    schema = pa.schema([("key", pa.binary()), ("item", pa.binary()), ("coverage", pa.float64()), ("tiles", pa.int32())])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "item": [], "coverage": [], "tiles": []}
            for key, text, some in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("items").to_pylist()):
                for x in some:
                    coverage, n = compared(x["passage"], text, least, threshold)
                    if n and coverage >= threshold:
                        for c, v in zip(out, (key, x["item"], coverage, n)):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    hits = staged(bodies.join(grouped, "key").select("key", "text", "items").mapInArrow(tiled, "key binary, item binary, coverage double, tiles int"), "tiles-hits")
    unstage(seeded, each, rare, grouped)
    return hits


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 3, threshold: float = 0.6,
) -> DataFrame:
    """docs with hits: array<struct<item_id, coverage, tiles>>, the benchmark items that a document contains.

    Greedy string tiling with Karp-Rabin search marks the longest matches of a document and an item that do not overlap, of at least
    `least` words, in any order; the share of the item's words under tiles is its coverage, and pairs at or above threshold are hits.
    Items of fewer words must stand whole. Words are lower-cased runs of letters, digits and underscores. Candidates
    come from a join of seeds (find_hits). Whole texts are read; equal texts and equal items are compared once.

    Null and empty texts have no hits; null or empty items match nothing; a null item id is kept as null; repeated rows
    are treated alike, repeated items each give a hit. No rows give no rows. A column of docs named hits is replaced; other columns, whatever their
    names, are carried along.
    """
    base = docs.drop("hits")
    key_name, hit_name = free_names(base, "key", "found")
    digest = lambda c: F.unhex(F.md5(c))
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("text is not null").withColumn("item", digest("text"))
    distinct = staged(items.groupBy("item").agg(F.any_value("text").alias("text")), "tiles-texts")
    body = F.col(f"`{text}`")
    hits = find_hits(docs.select(digest(body).alias("key"), body.alias("text")), distinct, least, threshold)
    each = hits.join(items.select("item", "item_id"), "item").groupBy(F.col("key").alias(key_name)).agg(F.array_sort(F.collect_list(F.struct("item_id", "coverage", "tiles"))).alias(hit_name))
    each, seen = staged_and_seen(each, "tiles-found", n=F.count("*"))
    unstage(hits, distinct)
    out = base.join(F.broadcast(each) if seen["n"] <= BROADCAST_ROWS else each, digest(body) == F.col(key_name), "left")
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.coalesce(F.col(hit_name), F.array()).cast(HITS).alias("hits"))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.transform(F.array_sort("hits"), lambda h: h["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["coverage"])), F.lit(0.0)).alias("coverage"),
    )
