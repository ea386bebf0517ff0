"""Near-duplicate documents by HyperMinHash registers, banded, estimated and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import components, runs, staged, staged_and_seen, unstage

#: 256 buckets, of which 42 bands of 6 registers use 252.
BUCKETS, BAND, BANDS = 256, 6, 42
USED = BAND * BANDS
#: Bits of the leading-zero count and of the mantissa in a register.
ZEROS, MANTISSA = 4, 4
#: Two registers of different minima agree when their counts do (sum of 4**-k = 1/3) and their mantissas do.
COLLISION = 1 / 3 / (1 << MANTISSA)
#: Representatives, and shingles of all their sets, that meet as one block of a group; larger groups are compared block against block.
BLOCK, SHINGLES_A_BLOCK = 2048, 1_000_000
#: Document ids up to this many are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For each register the order in which it looks for a bucket with something in it, itself first.
_PROBES = np.stack([np.r_[j, np.random.default_rng(1000 + j).permutation(np.delete(np.arange(BUCKETS), j))] for j in range(USED)])


class Shingler:
    """Sorted distinct 64-bit values of a text's word shingles. Words: ASCII lower case, runs without ASCII white space."""

    def __init__(self, words: int, room: int = 300_000):
        self.words, self.room = words, room
        self.known: dict[bytes, int] = {}

    def _code(self, word: bytes) -> int:
        if len(self.known) >= self.room:
            self.known.clear()
        code = self.known[word] = xxhash.xxh64_intdigest(word)
        return code

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        get, code = self.known.get, self._code
        h = np.fromiter((get(w) or code(w) for w in words), np.uint64, len(words))
        k = min(self.words, len(h))  # fewer words than a shingle has: the whole sequence is one
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = _mixed(out * _GOLD + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def registers(values: np.ndarray) -> np.ndarray:
    """USED bytes for a sorted set: per bucket the leading zeros and mantissa bits of its smallest value.

    The high bits of a value choose its bucket, so the first value of a bucket is its smallest. An empty
    bucket borrows from the first bucket with something in it along a fixed order of its own, so short documents
    have whole registers and two registers still agree with about the sets' Jaccard similarity.
    """
    bucket = (values >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    low = (values[first] << np.uint64(8)) >> np.uint64(11)  # 53 bits, exact as a double
    fraction, exponent = np.frexp(np.maximum(low, np.uint64(1)).astype(np.float64))
    zeros = np.minimum(53 - exponent, (1 << ZEROS) - 1)
    mantissa = ((fraction - 0.5) * (2 << MANTISSA)).astype(np.int64)
    regs = np.full(BUCKETS, -1, np.int64)
    regs[bucket[first]] = (zeros << MANTISSA) | mantissa
    full = regs >= 0
    at = np.arange(USED)
    empty = np.flatnonzero(~full[:USED])
    if len(empty):
        at[empty] = _PROBES[empty, full[_PROBES[empty]].argmax(axis=1)]
    return regs[at].astype(np.uint8)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(rows, USED) registers to (rows, BANDS) keys, a band's number mixed in."""
    parts = regs.reshape(len(regs), BANDS, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND):
        key = key * np.uint64(256) + parts[:, :, k]
    return _mixed(key).astype(np.int64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, corrected for registers that agree by collision."""
    return ((a == b).mean(axis=1) - COLLISION) / (1 - COLLISION)


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("regs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle)
        for batch in batches:
            n, same, regs = [], [], []
            for t in batch.column("text"):
                values = shingles(t.as_py())
                n.append(len(values))
                same.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                regs.append(registers(values).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(regs, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, body long, n long, same binary, regs binary")


def _banded(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.stack([np.frombuffer(r.as_py(), np.uint8) for r in batch.column("regs")])
                keys = band_keys(regs).ravel()
                bit = np.tile(np.int64(1) << np.arange(BANDS, dtype=np.int64), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bit), batch.column("rep").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], ["band", "bit", "rep"])

    return reps.select("rep", "regs").mapInArrow(run, "band long, bit long, rep binary")


def _floor(n: np.ndarray, wanted: float) -> np.ndarray:
    """Least estimate to go on with: five standard deviations below what is wanted, for sets of n shingles."""
    return wanted - 5 * np.sqrt(wanted * (1 - wanted) / np.minimum(n, USED)) - 0.02


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows of groups dealt into (hub, lo, hi): pairs of different components meet in one part, and no part has more than two blocks.

    In a group of more than BLOCK members the members of its largest component never meet each other: they form blocks of their own
    that meet only the blocks of the rest. So a large group that is nearly one component costs its size, not its square.
    """
    by_component = rows.groupBy("hub", "c").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    sizes = by_component.groupBy("hub").agg(F.sum("k").alias("all"), F.sum("w").alias("weight"), F.max(F.struct("k", "c", "w")).alias("top")).where((F.col("all") > BLOCK) | (F.col("weight") > SHINGLES_A_BLOCK))
    needed = lambda k, w: F.ceil(F.greatest(k / BLOCK, w / SHINGLES_A_BLOCK)).cast("int")
    sizes = sizes.select(
        F.col("hub").alias("bb"),
        F.col("top.c").alias("main"),
        needed(F.col("all") - F.col("top.k"), F.col("weight") - F.col("top.w")).alias("rest_blocks"),
        needed(F.col("top.k"), F.col("top.w")).alias("main_blocks"),
    )
    h, small = F.xxhash64("rep"), F.col("bb").isNull()
    block = F.when(F.col("is_main"), F.col("rest_blocks") + F.pmod(h, F.col("main_blocks"))).otherwise(F.pmod(h, F.col("rest_blocks")))
    last = F.col("rest_blocks") - 1 + F.when(F.col("is_main"), 0).otherwise(F.col("main_blocks"))
    dealt = (
        rows.join(sizes, F.col("hub") == F.col("bb"), "left")
        .withColumn("is_main", F.coalesce(F.col("c") == F.col("main"), F.lit(False)))
        .withColumn("block", F.when(small, 0).otherwise(block).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(small, 0).otherwise(last))))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .drop("bb", "main", "rest_blocks", "main_blocks", "is_main", "other")
    )
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(partitions, "hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi")


def _across(rows: DataFrame, percent: int, verify: bool) -> DataFrame:
    """Pairs of different components within each group, without listing them.

    rows: (hub, rep, bits, c, n, regs), with set too where verify. A pair is looked at where its first common band is one of the group's, which bits
    has set, if sizes and estimate allow the similarity. Without verify: (hub, rep) of those that have such a pair. With verify: links (a, b), one for each two
    components that a group joins.
    """
    wanted = percent / 100
    kind, names = (pa.binary(), ["a", "b"]) if verify else (pa.binary(), ["hub", "rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = [], []
        for group in runs(batches, "hub", "lo", "hi"):
            m = group.num_rows
            if m < 2:
                continue
            rep, n, block = group.column("rep").to_pylist(), np.asarray(group.column("n")), np.asarray(group.column("block"))
            _, c, sizes = np.unique(group.column("c").to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
            if len(sizes) < 2:
                continue
            regs = np.stack([np.frombuffer(r.as_py(), np.uint8) for r in group.column("regs")])
            hub, bits = group.column("hub")[0].as_py(), np.asarray(group.column("bits"))
            apart = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("set")] if verify else []
            largest, root, seen, order = int(sizes.argmax()), np.arange(len(sizes)), np.zeros(m, bool), np.arange(m)
            for i in np.flatnonzero(c != largest):
                ok = (root[c] != root[c[i]]) & ((c == largest) | (order > i)) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent)
                if apart:
                    ok &= block != block[i]
                j = np.flatnonzero(ok)
                if not len(j):
                    continue
                agree = regs[j] == regs[i]
                good = (agree.mean(axis=1) - COLLISION) / (1 - COLLISION) >= _floor(np.minimum(n[j], n[i]), wanted)
                j, agree = j[good], agree[good]
                common = agree.reshape(len(j), BANDS, BAND).all(axis=2)
                j = j[common.any(axis=1) & (bits[i] >> common.argmax(axis=1) & 1 > 0)]
                if not len(j):
                    continue
                if not verify:
                    seen[i] = True
                    seen[j] = True
                    continue
                lengths = np.array([len(sets[k]) for k in j])
                shared = np.add.reduceat(np.isin(np.concatenate([sets[k] for k in j]), sets[i]).astype(np.int64), np.r_[0, np.cumsum(lengths)[:-1]])
                for k in j[100 * shared >= percent * (lengths + len(sets[i]) - shared)]:
                    if root[c[k]] != root[c[i]]:
                        root[root == root[c[k]]] = root[c[i]]
                        first.append(rep[i])
                        second.append(rep[k])
            if not verify and seen.any():
                first.extend([hub] * int(seen.sum()))
                second.extend(rep[k] for k in np.flatnonzero(seen))
            if len(first) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(first, kind), pa.array(second, pa.binary())], names)
                first, second = [], []
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(first, kind), pa.array(second, pa.binary())], names)

    return _blocked(rows).mapInArrow(run, "a binary, b binary" if verify else "hub binary, rep binary")


def _promising(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose estimate is not five standard deviations below it."""
    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    sized = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    wanted = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.stack([np.frombuffer(r.as_py(), np.uint8) for r in batch.column(c)]) for c in ("ra", "rb"))
                least = np.minimum(np.asarray(batch.column("na")), np.asarray(batch.column("nb")))
                keep = estimated(ra, rb) >= _floor(least, wanted)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full sets. A hub's set is sent once; its partners' rows may be split."""
    a = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                inter = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                keep.append(100 * inter >= percent * (len(u) + len(v) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _sets(narrow: DataFrame, owners: DataFrame, shingle: int) -> DataFrame:
    """(rep, set) of the representatives in owners (rep, doc_id, body), made anew from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], ["rep", "set"])

    return narrow.join(owners, ["doc_id", "body"]).select("rep", "text").mapInArrow(run, "rep binary, set binary").dropDuplicates(["rep"])


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, body, first) for every row of docs.

    A document's set holds its distinct shingles of `shingle` words (all its words, where they are fewer); documents
    with 100 * intersection >= percent * union are linked, component_id is the smallest doc_id reachable over links, and kept says that it is
    the document's own. body is a hash of the text, so (doc_id, body) names a row of docs even where ids repeat; first marks the one
    such name of each component that stands for it.

    Equal sets become one representative, named by the digest of the set. Its HyperMinHash registers are cut into bands, and the bands that
    have the same smallest member, its at most 42, make one group. All members of a group meet that hub, then those that it is not linked to the member
    with most links and a third one by hash: they pass a size test and the collision-corrected estimate, and are confirmed on their full sets.
    Links make components; then within the group of its first common band every pair whose ends still lie in different components is put to the same
    tests, block against block inside tasks, and only what joins two components comes out. So a group of copies costs its size and not
    its square, while no link between components is passed over. A pair at 80 % shares no band with a probability near 3 in a million.

    Empty and null texts have 0 shingles and link with nothing. A row without doc_id links with nothing (component_id null, kept and
    first true). Rows that repeat a doc_id are documents of their own: each takes the links of its own set. No rows give no rows;
    other columns are ignored.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("body"))
    signed = staged(_signatures(narrow, shingle), "minhash-signatures")
    solid = signed.where(F.col("same").isNotNull() & F.col("doc_id").isNotNull())
    reps = solid.groupBy(F.col("same").alias("rep")).agg(F.min(F.struct("doc_id", "body")).alias("least"), F.any_value("n").alias("n"), F.any_value("regs").alias("regs"))
    reps = staged(reps, "minhash-representatives")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = _banded(reps).repartition(partitions, "band")  # one exchange, read by the aggregate and by the join
    shared = bands.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("k")).where("k > 1").select("band", "hub")
    mates = staged(bands.join(shared, "band").groupBy("hub", "rep").agg(F.bit_or("bit").alias("bits")), "minhash-mates")
    # Sets of the documents that share a band with another.
    nodes = mates.select("rep").distinct().join(reps.select("rep", "least.*"), "rep")
    nodes, seen = staged_and_seen(nodes, "minhash-nodes", n=F.count("*"))
    sets = staged(_sets(narrow.where("text is not null"), F.broadcast(nodes) if seen["n"] <= BROADCAST_IDS else nodes, shingle), "minhash-sets")

    def confirmed(pairs: DataFrame) -> tuple[DataFrame, int]:
        apart = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        tried = staged(_promising(apart, reps, percent), "minhash-candidates")
        found, seen = staged_and_seen(_verified(tried, sets, percent), "minhash-links", n=F.count("*"))
        unstage(tried)
        return found, seen["n"]

    def placed(of: DataFrame) -> DataFrame:
        known = of.withColumnRenamed("node", "rep").withColumnRenamed("component", "c")
        return mates.join(known, "rep", "left").select("hub", "rep", "bits", F.coalesce("c", "rep").alias("c"))

    links, _ = confirmed(mates.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    # Members that their hub is not linked to meet two more: the one with most links, and one by hash.
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("hub")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("hub")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("links"))
    here = mates.join(ends.withColumn("with_hub", F.lit(True)), ["rep", "hub"], "left").join(degree, "rep", "left")
    by_links, by_hash = F.struct(F.coalesce("links", F.lit(0)).alias("by"), "rep"), F.struct(F.xxhash64("rep").alias("by"), "rep")
    tops = here.groupBy("hub").agg(F.array(F.max(by_links), F.max(by_hash)).alias("tops")).select("hub", F.explode("tops.rep").alias("top"))
    apart = here.where("with_hub is null and rep <> hub").select("hub", "rep").join(tops, "hub").where("top <> hub")
    further, _ = confirmed(apart.select(F.col("rep").alias("a"), F.col("top").alias("b")))
    final = staged(components(links.unionByName(further), "minhash-components"), "minhash-placed")  # read many times below
    here = placed(final)
    mixed = here.groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("hub")
    apart = staged(here.join(mixed, "hub").join(reps.select("rep", "n", "regs"), "rep"), "minhash-apart")
    worth = _across(apart, percent, False).distinct()
    more, seen = staged_and_seen(_across(apart.join(worth, ["hub", "rep"]).join(sets, "rep"), percent, True), "minhash-links", n=F.count("*"))
    if seen["n"]:  # components of components: only what the last links touch is gone through again
        known = final.select(F.col("node").alias("rep"), F.col("component").alias("c"))
        ends = more.join(known, F.col("a") == F.col("rep"), "left").select(F.coalesce("c", "a").alias("a"), "b")
        ends = ends.join(known, F.col("b") == F.col("rep"), "left").select("a", F.coalesce("c", "b").alias("b"))
        merged = staged(components(ends, "minhash-components").select(F.col("node").alias("c"), F.col("component").alias("now")), "minhash-merged")
        lone = merged.join(final.select(F.col("component").alias("c")), "c", "left_anti").select(F.col("c").alias("node"), F.col("now").alias("component"))
        moved = final.withColumnRenamed("component", "c").join(merged, "c", "left").select("node", F.coalesce("now", "c").alias("component"))
        first_placed, final = final, staged(moved.unionByName(lone), "minhash-placed")
        unstage(first_placed, merged)
    unstage(mates, apart, more, nodes, sets, links, further)
    # A component's document is the least of its representatives' least ones.
    owner = reps.select("rep", "least").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "least", F.coalesce("component", "rep").alias("component"))
    least = owner.groupBy("component").agg(F.min("least").alias("least"))
    owner = owner.select(F.col("rep").alias("same"), "component").join(least, "component").drop("component")
    out = signed.join(owner, "same", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id")).alias("component_id"), "body", "least"
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    first = F.coalesce((F.col("doc_id") == F.col("least.doc_id")) & (F.col("body") == F.col("least.body")), F.lit(True))
    return out.withColumn("kept", kept).withColumn("first", first).select("doc_id", "n_shingles", "component_id", "kept", "body", "first")


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2).drop("body", "first")
